"""Token ids as Parquet list columns.

Layout: one row per document in ascending ``doc_id`` order over all files (nulls first; rows with one
id in the order of their texts' hashes), columns

* ``row`` long: file number << 33 | position in the file, so it ascends with the order of documents;
* ``doc_id`` long, ``n_tokens`` long: metadata, read without touching the ids;
* ``ids`` array<int>: the document's token ids, the end id last.

Ids are dictionary-encoded (a vocabulary fits one dictionary page; ``dictionary=False`` gives delta
encoding, DELTA_BINARY_PACKED of version-2 pages). Row groups and pages are of given sizes, and column
and offset indexes are written, so that a range of ``doc_id`` reads only the pages that hold it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scan import Slice, slices
from .store import of_worker, partitions, release

#: Words of a worker's table, and their ids for each of these; beyond either it starts anew.
MEMO_WORDS, MEMO_IDS = 1_000_000, 8
#: Longer words are encoded one by one.
MEMO_BYTES = 64
#: Bytes of texts for a file, at least; there are no fewer files than shuffle partitions while each has some text.
FILE_BYTES = 256 << 20


class HashTable:
    """Numbers of 64-bit keys in order of their insertion, looked up many at once; open addressing in arrays."""

    def __init__(self, most: int):
        self.bits = (2 * most - 1).bit_length()
        self.keys, self.numbers, self.size = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        place = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.numbers[place]
        rest = np.flatnonzero((self.keys[place] != keys) & (out >= 0))
        out[(self.keys[place] != keys) & (out >= 0)] = -1
        while len(rest):
            place[rest] = (place[rest] + 1) & ((1 << self.bits) - 1)
            number, same = self.numbers[place[rest]], self.keys[place[rest]] == keys[rest]
            out[rest[same]] = number[same]
            rest = rest[~same & (number >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not in it."""
        place, rest = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(rest):
            free = self.numbers[place[rest]] < 0
            at, first = np.unique(place[rest[free]], return_index=True)
            won = rest[free][first]
            self.keys[at], self.numbers[at] = keys[won], self.size + won
            rest = np.setdiff1d(rest, won, assume_unique=True)
            place[rest] = (place[rest] + 1) & ((1 << self.bits) - 1)
        self.size += len(keys)


class WordMemo:
    """Encodes whole texts by their words.

    The tokenizer must not let a token cross white space and must drop it, which is checked on a probe;
    then a text's ids are its words' ids one after another. Words are looked up by 64-bit hashes in a
    table, and only those that aren't known yet are encoded, many by one call, with a mark between
    them that is one id of its own. Where the tokenizer ignores the case of A-Z, so does the table. A
    tokenizer of another kind encodes text by text.
    """

    MARK = "\x01"

    def __init__(self, tokenizer_file: str, most: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.most = Tokenizer.from_file(tokenizer_file), most
        #: Special tokens are found in the text as it is written.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()
        mark = self._plain(self.MARK.encode())
        self.mark = int(mark[0]) if len(mark) == 1 else None
        probe = [b"A b'c  don't\n\t\xc3\xa91 2x <|x|>  . ,\x0b\x0c\r end", b"", b" x,y "]
        upper = "ABCDEFGHIJKLM NOP'QRSTUVWXYZ E\u0301A\u030a X1Y".encode()
        self.folds = np.array_equal(self._plain(upper), self._plain(upper.lower()))
        values, counts = self.by_words(probe)
        whole = [self._plain(x) for x in probe]
        self.whole_texts = self.mark is None or not np.array_equal(values, np.concatenate(whole)) or counts.tolist() != [len(x) for x in whole]

    def _clear(self) -> None:
        self.table = HashTable(self.most)
        #: Ids of all words end to end, and where each word's begin: arrays with room to grow.
        self.starts, self.lengths, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0

    @staticmethod
    def _with_room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def _plain(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _words(self, words: list[bytes]) -> list[np.ndarray]:
        """Each word's ids."""
        mark, out = self.MARK.encode(), [None] * len(words)
        plain = [k for k, w in enumerate(words) if mark not in w and len(w) <= MEMO_BYTES]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        joined = [(b" " + mark + b" ").join([words[k] for k in g]).decode() for g in groups]
        for g, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            for k, a, b in zip(g, cuts[:-1], cuts[1:], strict=True):
                out[k] = ids[a + 1 : b]
        return [self._plain(w) if x is None else x for w, x in zip(words, out, strict=True)]

    def by_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.folds and not any(x in t for t in texts for x in self.special):
            texts = [x.lower() for x in texts]
        part = Slice(texts)
        hashes = part.word_hashes()
        number = self.table.find(hashes)
        new, first = np.unique(hashes[number < 0], return_index=True)
        if self.table.size + len(new) > self.most or self.used > MEMO_IDS * self.most:
            self._clear()
            number[:] = -1
            new, first = np.unique(hashes, return_index=True)
            if len(new) > self.most:
                self.most = len(new)
                self._clear()
        if len(new):
            raw, at = part.buf.tobytes(), np.flatnonzero(number < 0)[first]
            found = self._words([raw[a:b] for a, b in zip(part.starts[at].tolist(), part.ends[at].tolist(), strict=True)])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            size, ids = self.table.size, self.used + int(lengths.sum())
            self.starts, self.lengths, self.ids = (self._with_room(a, n) for a, n in ((self.starts, size + len(new)), (self.lengths, size + len(new)), (self.ids, ids)))
            self.starts[size : size + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[size : size + len(new)] = lengths
            self.ids[self.used : ids] = np.concatenate(found)
            self.used = ids
            self.table.add(new)
            number = self.table.find(hashes)
        lengths = self.lengths[number].astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[number] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.ids[at], np.diff(np.concatenate([[0], ends])[part.first])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        if not self.whole_texts:
            return self.by_words(texts)
        found = [self._plain(x) for x in texts]
        return np.concatenate(found), np.array(list(map(len, found)), np.int64)


def _encoder(tokenizer_file: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = of_worker(("words", tokenizer_file), lambda: WordMemo(tokenizer_file))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # some documents at a time: bounded memory
                part = batch.slice(start, 512)
                texts = [x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                for i, j in slices(texts):
                    ids, counts = memo.encode(texts[i:j])
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                    some = part.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), pa.array(counts + 1), lists], ["row", "doc_id", "n_tokens", "ids"])
        release(keep_made=True)

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, *, dictionary: bool = True, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 1000) -> None:
    """Encode every whole text of ``docs(doc_id, text)`` and write the files; a null text is an empty one.

    The one shuffle deals texts, which are smaller than their ids, into ranges of ``doc_id``; rows that share
    one (or have none) are dealt on by their texts and then by where they come from, so many of them fill many
    files. The number of files follows the bytes of the texts. Other columns of ``docs`` are not looked at; an
    empty table gives empty files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = (
        docs.repartitionByRange(max(partitions(spark), -(-size // FILE_BYTES)), "doc_id", F.xxhash64("text"), F.monotonically_increasing_id())
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    )
    encoded = ordered.mapInArrow(_encoder(tokenizer_file, end_id), "row long, doc_id long, n_tokens long, ids array<int>")
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(dictionary).lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """Documents of the files; of a range of doc_id, or without their ids, only what is asked for is read."""
    df = spark.read.schema("row long, doc_id long, n_tokens long, ids array<int>").parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df if ids else df.drop("ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), memoryview(np.asarray(ids.values).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["row", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files.

    ``start`` is the number of ids before the document: a running sum in each file, plus the sum of the
    files before it, of which there is one row each.
    """
    file = F.shiftright("row", 33)
    totals = read_tokens(spark, path, ids=False).groupBy(file.alias("file")).agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = read_tokens(spark, path).mapInArrow(_crc, "row long, doc_id long, n_tokens long, ids_crc32 long").withColumn("file", file)
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("own", own).join(before, "file").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
