"""Quality rules: plain counts of a text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted, one over the trusted documents (label quality 1)
and one over all documents. A text's score is the mean over its n-grams of log(p_trusted / p_raw), so it
does not depend on length; it is kept if the score is ``threshold`` at least. Every document is judged by
the same fixed threshold; a text without n-grams scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Slice, mix, ngram_codes, slices
from .store import release

WIDTH = 3
BITS = 16
#: Natural log units a byte n-gram; ordinary prose of the raw corpus is within 0.1 of zero.
THRESHOLD = -0.25

#: N-grams of the raw corpus that are added to the trusted ones.
PRIOR = float(1 << 14)
#: Ids of trusted documents that are sent to all tasks at most (16 MB); more are joined with the documents.
SENT = 1 << 21

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _among(ids: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Whether each id is one of the sorted ``chosen``."""
    return chosen[np.minimum(np.searchsorted(chosen, ids), len(chosen) - 1)] == ids if len(chosen) else np.zeros(len(ids), bool)


def ngram_counts(docs: DataFrame, trusted: DataFrame, width: int = WIDTH, bits: int = BITS, sent: int = SENT) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all documents and of all trusted ones by bucket; 2**bits rows come to the driver.

    ``trusted`` has doc_id of the trusted documents. Up to ``sent`` of them are known to all tasks as sorted ids, so no
    text is shuffled; more are joined by hash, each text once. Each task sums its texts before its counts are shuffled.
    """
    size = 1 << bits
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ids.limit(sent + 1).count() <= sent:
        chosen = np.sort(ids.toArrow().column("doc_id").to_numpy())
        texts = texts.withColumn("good", F.lit(None).cast("boolean"))
    else:
        chosen = np.zeros(0, np.int64)
        texts = texts.join(ids.withColumn("good", F.lit(True)).hint("shuffle_hash"), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in _small(batches):
            ids = batch.column("doc_id")
            texts, joined = _texts(batch), batch.column("good")
            if joined.null_count:
                marks = _among(ids.fill_null(0).to_numpy(), chosen) & ids.is_valid().to_numpy(zero_copy_only=False)
            else:
                marks = joined.to_numpy(zero_copy_only=False)
            for i, j in slices(texts):
                codes, sizes = ngram_codes(Slice(texts[i:j]), width, bits)
                raw += np.bincount(codes, minlength=size)
                good += np.bincount(codes[np.repeat(marks[i:j], sizes)], minlength=size)
        at = np.flatnonzero(raw)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    found = texts.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).toPandas()
    raw, good = np.zeros(size), np.zeros(size)
    raw[found.iloc[:, 0]], good[found.iloc[:, 0]] = found.iloc[:, 1], found.iloc[:, 2]
    return raw, good


def log_ratios(raw: np.ndarray, good: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(p_trusted / p_raw) by bucket; ``prior`` n-grams spread like the raw corpus are added to the trusted ones.

    So what is as common among the trusted as in all documents is at 0 however few are trusted, and with
    none trusted all is.
    """
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((good + prior * p) / ((good.sum() + prior) * p)).astype(np.float32)


def dup_lines(text: bytes) -> int:
    r"""\n-split lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.split()]
    return len(lines) - len(set(lines))


def repeat_words(part: Slice, width: int = 3) -> np.ndarray:
    """By text: words that lie in windows of ``width`` words that the text has twice or more."""
    words = part.word_hashes()
    codes, at = part.windows(words, width)
    if not len(at):
        return np.zeros(part.n, np.int64)
    codes = codes ^ mix(part.doc[at].astype(np.uint64) + np.uint64(1))
    _, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    hit = at[counts[which] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[hit + k] = True
    return np.bincount(part.doc[covered], minlength=part.n)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: list[bytes], ratios: np.ndarray, width: int = WIDTH, bits: int = BITS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the mean log ratio of each text."""
    found: dict[str, list] = {k: [] for k in COUNTS}
    scores = []
    for i, j in slices(texts):
        part = Slice(texts[i:j])
        found["n_words"].append(part.n_words)
        found["word_chars"].append(part.count(~part.space & ((part.buf & 0xC0) != 0x80)))
        found["n_symbols"].append(part.count(_SYMBOLS[part.buf]))
        found["n_dup_lines"].append(np.array([dup_lines(x) for x in texts[i:j]], np.int64))
        found["n_repeat_words"].append(repeat_words(part))
        codes, sizes = ngram_codes(part, width, bits)
        total = np.concatenate([[0.0], np.cumsum(ratios[codes], dtype=np.float64)])
        ends = np.cumsum(sizes)
        scores.append((total[ends] - total[ends - sizes]) / np.maximum(sizes, 1))
    join = lambda x: np.concatenate(x) if x else np.zeros(0)
    return {k: join(v) for k, v in found.items()}, join(scores)


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The base rule: fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def keeps(text: Column, ratios: np.ndarray, threshold: float = THRESHOLD, width: int = WIDTH, bits: int = BITS) -> Column:
    """Whether a text passes the base rule and the threshold, by the ratios of ``log_ratios``. A null or empty text has no words and fails."""

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            counts, score = measure([(x or "").encode() for x in texts], ratios, width, bits)
            yield pd.Series(~failed(counts) & (score >= threshold), dtype=bool)
        release()

    return passes(text)


def judge(docs: DataFrame, trusted: DataFrame, *carry: str, threshold: float = THRESHOLD, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """The columns ``carry`` of every row, the counts, base_failed, score and kept.

    A null text is one without words, so it fails the base rule. Rows with one doc_id are judged each by its own text.
    """
    ratios = log_ratios(*ngram_counts(docs, trusted, width, bits))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in carry), *(f"{c} long" for c in COUNTS), "base_failed boolean, score double, kept boolean"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            counts, score = measure(_texts(batch, "_text"), ratios, width, bits)
            base = failed(counts)
            made = [pa.array(counts[c].astype(np.int64)) for c in COUNTS] + [pa.array(base), pa.array(score.astype(np.float64)), pa.array(~base & (score >= threshold))]
            yield pa.RecordBatch.from_arrays([batch.column(f"c{k}") for k in range(len(carry))] + made, [*carry, *COUNTS, "base_failed", "score", "kept"])

    return docs.select(F.col("text").cast("string").alias("_text"), *[docs[c].alias(f"c{k}") for k, c in enumerate(carry)]).mapInArrow(rows, schema)
