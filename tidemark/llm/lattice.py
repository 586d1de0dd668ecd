"""Language-model scores from the lattice of subwords of a text.

The pieces and their first scores are those of an existing vocabulary file, which is not changed: a
piece of rank r weighs 1 / (r + 10). Rounds of expectation over every distinct training word, by its
count, turn them into probabilities of this corpus's pieces; the end of a text is one more piece. A word,
with a space before it, is scored by the sum over all its segmentations, which a forward recursion in
logarithms gives. As no piece holds a space after its start, a text's probability is the product of its
words' and the end's: the marginal over all segmentations of the whole text with single spaces.

Counts are kept as tables of all distinct words. Each text is looked up in two ways with one result: words
frequent enough, HEAD_WORDS at most, in a dictionary on each executor, all others by a join. Pieces of the file
that are longer than MAX_PIECE bytes, or hold a space after their start, are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Slice, slices
from .store import keep

HEAD_WORDS = 100_000
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
ROUNDS = 2
#: Longest piece, in bytes.
MAX_PIECE = 24
#: Words of more bytes are scored one at a time, in stretches of BLOCK places, so memory follows the word's length only
#: by a few numbers a byte.
LONG, BLOCK = 256, 1 << 15
#: Places after which the recursion over a long word is scaled anew.
SCALED = 16
#: Counts of the first scores that are added to the expected counts.
PRIOR = 1000.0

_P = np.uint64(0x9DDFEA08EB382D69)
_CODES = np.random.Generator(np.random.PCG64(30)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


def vocabulary(model_file: str) -> dict[bytes, float]:
    """First probabilities of the pieces of a sentencepiece file; a byte piece adds to its byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    weights: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        if len(piece) <= MAX_PIECE and b" " not in piece[1:]:
            weights[piece] = weights.get(piece, 0.0) + 1.0 / (10.0 + (model.get_piece_size() if model.is_byte(i) else max(0.0, -model.get_score(i))))
    for b in range(256):
        weights.setdefault(bytes([b]), 1.0 / (10.0 + model.get_piece_size()))
    total = math.fsum(weights.values())
    return {k: v / total for k, v in weights.items()}


class Lattice:
    """Pieces in a hash table of arrays, so many words of one length are scored at once."""

    def __init__(self, pieces: list[bytes], probabilities: np.ndarray):
        self.logs = np.log(probabilities)
        self.longest = max(map(len, pieces))
        self.bits = max(4, (16 * len(pieces) - 1).bit_length())
        self.keys, self.ids, self.probes = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 1
        for length in range(1, self.longest + 1):
            own = [k for k, x in enumerate(pieces) if len(x) == length]
            rows = np.frombuffer(b"".join(pieces[k] for k in own), np.uint8).reshape(-1, length) if own else np.zeros((0, length), np.uint8)
            code = np.zeros(len(own), np.uint64)
            for j in range(length):
                code = code * _P + _CODES[rows[:, j]]
            for k, key, slot in zip(own, code, self._slot(code).tolist(), strict=True):
                probe = 1
                while self.ids[slot] >= 0:
                    slot, probe = (slot + 1) % (1 << self.bits), probe + 1
                self.keys[slot], self.ids[slot], self.probes = key, k, max(self.probes, probe)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes are pieces', and the pieces' numbers."""
        slot = self._slot(code)
        piece = np.where(self.keys[slot] == code, self.ids[slot], -1)
        rest = np.flatnonzero((piece < 0) & (self.ids[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            here = slot[rest]
            same = self.keys[here] == code[rest]
            piece[rest[same]] = self.ids[here[same]]
            rest = rest[~same & (self.ids[here] >= 0)]
        found = np.flatnonzero(piece >= 0)
        return found, piece[found]

    def _grouped(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, as rows of bytes after a space, and where they stand."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            length = int(lengths[group[0]]) + 1 if len(group) else 0
            size = max(1, min(1 << 14, (1 << 21) // (length * min(length, self.longest) or 1)))
            for i in range(0, len(group), size):
                at = group[i : i + size]
                yield at, np.frombuffer(b"".join([b" " + words[k] for k in at]), np.uint8).reshape(len(at), length)

    def _edges(self, rows: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces, logs) of the pieces in the words, by start and end."""
        edges, length = [], rows.shape[1]
        steps = _CODES[rows.T]
        for i in range(length):
            code = np.zeros(len(rows), np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                code = code * _P + steps[j - 1]
                found, piece = self.lookup(code)
                if len(found):
                    edges.append((i, j, found, piece, self.logs[piece]))
        return edges

    @staticmethod
    def _forward(edges: list, length: int, n: int) -> np.ndarray:
        """Logs of the probabilities of all segmentations up to each place: edges come by start, so a start's is complete."""
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for i, j, at, _, log in edges:
            alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + log)
        return alpha

    def _places(self, text: np.ndarray, a: int, b: int) -> tuple[list[int], list[int], np.ndarray]:
        """Of the pieces that begin at the places a to b of a word: how many begin up to each, their lengths and numbers."""
        n = len(text)
        steps, code = _CODES[text[a : b + self.longest]], np.zeros(b - a, np.uint64)
        starts, lengths, pieces = [], [], []
        for k in range(1, self.longest + 1):
            code = code[: max(n - a - k + 1, 0)]
            code = code * _P + steps[k - 1 : k - 1 + len(code)]
            found, piece = self.lookup(code)
            starts.append(found)
            lengths.append(np.full(len(found), k))
            pieces.append(piece)
        at = np.concatenate(starts)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(b - a + 1))
        return cuts.tolist(), np.concatenate(lengths)[order].tolist(), np.concatenate(pieces)[order]

    def _along(self, text: np.ndarray, ahead: bool) -> np.ndarray:
        """Logs of the probabilities of all segmentations up to each place of a long word, or from each place on.

        Probabilities themselves are added, as multiples of a scale that follows them.
        """
        n, reach, probabilities = len(text), self.longest, np.exp(self.logs)
        out = np.empty(n + 1)
        blocks = [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
        scale = 0.0
        edge = [1.0] + [0.0] * reach  # the places next to the block in the direction of the recursion
        if not ahead:
            out[n] = 0.0
        for a, b in blocks if ahead else reversed(blocks):
            cuts, lengths, pieces = self._places(text, a, b)
            p, m = probabilities[pieces].tolist(), b - a
            values = edge + [0.0] * m if ahead else [0.0] * m + edge
            scales = np.empty(m)
            for low in range(0, m, SCALED) if ahead else range((m - 1) // SCALED * SCALED, -1, -SCALED):
                high = min(low + SCALED, m)
                if ahead:
                    for i in range(low, high):
                        v = values[i]
                        for e in range(cuts[i], cuts[i + 1]):
                            values[i + lengths[e]] += v * p[e]
                else:
                    for i in range(high - 1, low - 1, -1):
                        v = 0.0
                        for e in range(cuts[i], cuts[i + 1]):
                            v += values[i + lengths[e]] * p[e]
                        values[i] = v
                scales[low:high] = scale
                if not ahead:
                    out[a + low : a + high] = np.log(np.maximum(values[low:high], 1e-300)) + scale
                # What the next places see is scaled; what is done keeps its own scale.
                some = range(high, high + reach + 1) if ahead else range(low, low + reach + 1)
                top = max(values[i] for i in some)
                for i in some:
                    values[i] /= top
                scale += math.log(top)
            if ahead:
                out[a:b] = np.log(np.maximum(values[:m], 1e-300)) + scales
                edge = values[m:]
            else:
                edge = values[: reach + 1]
        if ahead:
            out[n] = math.log(edge[0]) + scale
        return out

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, over all segmentations."""
        out = np.zeros(len(words))
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for at, rows in self._grouped([words[k] for k in short]):
            out[np.array(short)[at]] = self._forward(self._edges(rows), rows.shape[1], len(rows))[-1]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._along(np.frombuffer(b" " + w, np.uint8), True)[-1]
        return out

    def expect(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in the words' segmentations."""
        total = np.zeros(len(self.logs))
        short = np.array([k for k, w in enumerate(words) if len(w) <= LONG], np.int64)
        for at, rows in self._grouped([words[k] for k in short]):
            length, edges = rows.shape[1], self._edges(rows)
            alpha = self._forward(edges, length, len(rows))
            beta = np.full((length + 1, len(rows)), -np.inf)
            beta[length] = 0.0
            pieces, shares = [], []
            for i, j, own, piece, log in reversed(edges):
                ahead = log + beta[j, own]
                beta[i, own] = np.logaddexp(beta[i, own], ahead)
                pieces.append(piece)
                shares.append(np.exp(alpha[i, own] + ahead - alpha[length, own]) * counts[short[at[own]]])
            total += np.bincount(np.concatenate(pieces), np.concatenate(shares), len(total))
        for k, w in enumerate(words):
            if len(w) > LONG:
                text = np.frombuffer(b" " + w, np.uint8)
                alpha, beta = self._along(text, True), self._along(text, False)
                for a in range(0, len(text), BLOCK):
                    b = min(a + BLOCK, len(text))
                    cuts, lengths, pieces = self._places(text, a, b)
                    i = a + np.repeat(np.arange(b - a), np.diff(cuts))
                    share = np.exp(alpha[i] + self.logs[pieces] + beta[i + np.array(lengths, np.int64)] - alpha[-1]) * counts[k]
                    total += np.bincount(pieces, share, len(total))
        return total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, list[bytes]]]:
    """doc_id, whether it is held out, and words of each row."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for doc, text in zip(batch.column("doc_id"), texts, strict=True):
            doc = doc.as_py()
            yield doc, doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2, (text.as_py() or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and their counts in training documents; a null word for the documents' ends."""
    held: Counter = Counter()
    ends = 0

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        held.clear()
        return made

    for _, held_out, words in _rows(batches):
        if held_out:
            for w in words:
                held.setdefault(w, 0)
        else:
            held.update(words)
            ends += 1
        if len(held) > HELD_WORDS:
            yield out()
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"])


def _many(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts of several batches together: longer arrays are cheaper."""
    words: list[bytes] = []
    counts: list[np.ndarray] = []
    for batch in batches:
        words += batch.column("word").to_pylist()
        counts.append(batch.column("c").to_numpy())
        if len(words) >= rows:
            yield words, np.concatenate(counts)
            words, counts = [], []
    if words:
        yield words, np.concatenate(counts)


def train(words: DataFrame, ends: int, first: dict[bytes, float], rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, float]:
    """Pieces, their probabilities, and the end's. A row for each piece and task is summed, one for each piece comes to the driver."""
    pieces = list(first)
    prior = np.array([first[x] for x in pieces])
    now, total = prior, 0.0
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces, now), np.zeros(len(pieces))
            for words, counts in _many(batches):
                total += lattice.expect(words, counts.astype(float))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = PRIOR * prior
        counts[sums["piece"]] += np.round(sums["n"], 6)
        total = float(counts.sum()) + ends
        now = counts / total if total else prior
    return pieces, now, (ends / total if total and ends else 1.0 / (total + 1))


def scored(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``.

    Documents whose crc32 of doc_id modulo 7 is 2 are held out; one without doc_id is in training. A null
    text is an empty one, which has only its end. base_score is the sum of log10 of (c + 1) / (N + V + 1)
    over words and end, score the lattice's log10 probability. Without training documents N and V are 0.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = keep(texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    known = counted.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum(F.when(F.col("word").isNull(), F.col("c")))).first()
    n, v, ends = (x or 0 for x in known)
    words = counted.where("word is not null")
    pieces, probabilities, end = train(words, ends, vocabulary(model_file))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, probabilities)
        for own, counts in _many(batches):
            laid = Slice(own)
            codes, others = laid.word_hashes().view(np.int64), laid.word_hashes(np.arange(len(own))).view(np.int64)
            made = lattice.score(own) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(others), pa.array(counts), pa.array(made)], ["code", "other", "c", "log"])

    # From here on a word is two 64-bit hashes; in the dictionary of frequent words, which are few, it is one.
    words = keep(words.mapInArrow(score, "code long, other long, c long, log double"), "words")
    step = F.floor(F.log2(F.col("c") + 1) * 8)
    steps = sorted(((r[0], r[1]) for r in words.where("c > 0").groupBy(step.alias("s")).agg(F.count(F.lit(1))).collect()), reverse=True)
    least, size = math.inf, 0
    for s, number in steps:
        size += number
        if size > HEAD_WORDS:
            break
        least = s
    head = sorted((r.code, r.c, r.log) for r in words.where(step >= least).collect()) if least < math.inf else []
    down = math.log10(n + v + 1)
    codes = np.array([x[0] for x in head], np.int64)
    bases, logs = np.log10(np.array([x[1] for x in head], float) + 1) - down, np.array([x[2] for x in head], float)
    of_end = math.log10(ends + 1) - down, math.log10(end), int(ends > 0)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with what its frequent words and end give and the list of its other words."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(x or b"").lower() for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                ids = part.column("doc_id").to_pylist()
                for i, j in slices(texts):
                    own = Slice(texts[i:j])
                    found = own.word_hashes().view(np.int64)
                    place = np.minimum(np.searchsorted(codes, found), max(len(codes) - 1, 0))
                    known = codes[place] == found if len(codes) else np.zeros(len(found), bool)
                    some = np.flatnonzero(own.n_words)
                    sums = np.zeros((3, own.n))
                    if len(some):
                        for k, values in enumerate((bases, logs, np.ones(len(codes)))):
                            sums[k, some] = np.add.reduceat(np.where(known, values[place] if len(codes) else 0.0, 0.0), own.first[some])
                    rare = pa.StructArray.from_arrays([pa.array(found[~known]), pa.array(own.word_hashes(np.flatnonzero(~known)).view(np.int64))], ["code", "other"])
                    offsets = np.concatenate([[0], np.cumsum(~known)])[own.first]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i:j], pa.int64()), pa.array([d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d in ids[i:j]]), pa.array(own.n_words + 1), pa.array(sums[2].astype(np.int64) + of_end[2]), pa.array(sums[0] + of_end[0]), pa.array(sums[1] + of_end[1]), lists],
                        ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                    )

    made = texts.mapInArrow(parts, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<code:long,other:long>>")
    made = keep(made.withColumn("key", F.monotonically_increasing_id()), "parts")
    rare = made.select(F.col("key").alias("k"), F.explode("rare").alias("w")).join(words, (F.col("w.code") == F.col("code")) & (F.col("w.other") == F.col("other")))
    rare = rare.groupBy("k").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("more"),
        F.sum(F.log10(F.col("c") + 1.0) - F.lit(down)).alias("base2"),
        F.sum("log").alias("score2"),
    )
    out = made.drop("rare").join(rare, F.col("key") == F.col("k"), "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "more").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), add("base", "base2").alias("base_score"), add("score", "score2").alias("score"))
