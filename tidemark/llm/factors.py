"""Quality of documents by a factorisation machine over hashed words, statistics of the text's structure and metadata.

A document is a sparse vector x: its words in 2**BITS hashed buckets (logarithms of their counts, of length one
together), and one entry for each statistic, set at the bin that its value falls in. Its score is the logistic
function of b + sum w_i x_i + sum over pairs i < j of (v_i . v_j) x_i x_j, where each v_i has RANK numbers. The pairs
are never formed: for each rank, half of (sum v_i x_i)^2 - sum v_i^2 x_i^2, so the time is linear in the entries.

It is fitted on the driver, by Adam, on the vectors (not the texts) of LABELLED documents a label at most, those of
the least hashes of their ids; each counts for as many as its label has in all. Every document is scored by itself,
from its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import held_out as by_remainder
from .quality import dup_lines, repeat_words
from .scan import Slice, slices
from .store import release

BITS, RANK = 14, 8
#: Documents of each label that the machine is fitted on at most.
LABELLED = 2500
EPOCHS, BATCH, RATE, DECAY = 15, 32, 0.02, 1e-4
#: From this score on a document counts as good.
GOOD = 0.3

BINS = 24
METADATA = ("n_chars",)

_FLAGS = {"symbols": b"#*$%&|<>@^~=+_\\/[]{}", "digits": b"0123456789", "capitals": bytes(range(65, 91)), "marks": b".,;:!?", "lines": b"\n", "others": bytes(range(128, 256))}
_TABLES = {name: np.isin(np.arange(256), list(chars)) for name, chars in _FLAGS.items()}
STATISTICS = ("words", "length", *_FLAGS, "mark_ends", "dup_lines", "repeats", "twice")


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, then two bins for each doubling from 2**-10 to 1."""
    share = np.minimum(part / np.maximum(whole, 1), 1.0)
    return np.where(part > 0, np.clip(np.floor(2 * np.log2(np.maximum(share, 2.0**-10))) + 21, 1, BINS - 1), 0).astype(np.int64)


def _size_bin(size: np.ndarray) -> np.ndarray:
    """0 for nothing (or not known), then one bin for each doubling."""
    known = np.nan_to_num(np.asarray(size, np.float64), nan=0.0)
    return np.where(known > 0, np.clip(np.floor(np.log2(np.maximum(known, 1))) + 1, 1, BINS - 1), 0).astype(np.int64)


@dataclass
class Rows:
    """Sparse vectors of ``n`` documents: the entries of each stand together, in the order of documents."""

    n: int
    doc: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def of(self, which: np.ndarray) -> Rows:
        cut = np.searchsorted(self.doc, np.arange(self.n + 1))
        sizes = cut[which + 1] - cut[which]
        at = np.repeat(cut[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return Rows(len(which), np.repeat(np.arange(len(which)), sizes), self.column[at], self.value[at])


def _joined(parts: list[Rows]) -> Rows:
    ends = np.cumsum([0, *[x.n for x in parts]])
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return Rows(int(ends[-1]), cat([x.doc + k for x, k in zip(parts, ends, strict=False)], np.int64), cat([x.column for x in parts], np.int64), cat([x.value for x in parts], np.float64))


def width(bits: int = BITS, metadata: int = len(METADATA)) -> int:
    return (1 << bits) + (len(STATISTICS) + metadata) * BINS


def vectors(texts: list[bytes], metadata: list[np.ndarray], bits: int = BITS) -> Rows:
    """The vectors of some texts; ``metadata`` has an array of numbers for each column of that kind, not-a-number where null."""
    return _joined([_vectors(texts[i:j], [m[i:j] for m in metadata], bits) for i, j in slices(texts)])


def _vectors(texts: list[bytes], metadata: list[np.ndarray], bits: int) -> Rows:
    part = Slice(texts)
    words = part.word_hashes()
    bucket = (words >> np.uint64(64 - bits)).astype(np.int64)
    twice = part.doc[1:][(words[1:] == words[:-1]) & (part.doc[1:] == part.doc[:-1])]  # words after the same word
    code, count = np.unique(part.doc << bits | bucket, return_counts=True)
    doc, column, value = code >> bits, code & (1 << bits) - 1, np.log1p(count)
    value /= np.sqrt(np.bincount(doc, value * value, minlength=part.n))[doc]
    n_bytes, filled = np.diff(part.at) - 1, part.count(~part.space)
    ends = np.bincount(part.doc, _TABLES["marks"][part.buf[part.ends - 1]], minlength=part.n)
    bins = [_size_bin(part.n_words), _share_bin(part.n_words, filled)]
    bins += [_share_bin(part.count(table[part.buf]), n_bytes) for table in _TABLES.values()]
    bins += [_share_bin(ends, part.n_words), _share_bin(np.array([dup_lines(x) for x in texts]), part.count(part.buf == 10) + 1), _share_bin(repeat_words(part), part.n_words), _share_bin(np.bincount(twice, minlength=part.n), part.n_words)]
    bins += [_size_bin(x) for x in metadata]
    own = np.stack([(1 << bits) + k * BINS + x for k, x in enumerate(bins)], axis=1)
    doc, column = np.concatenate([doc, np.repeat(np.arange(part.n), len(bins))]), np.concatenate([column, own.ravel()])
    value = np.concatenate([value, np.full(own.size, len(bins) ** -0.5)])
    order = np.argsort(doc, kind="stable")
    return Rows(part.n, doc[order], column[order], value[order])


class Machine:
    """Bias, weights and factors of a factorisation machine of second order."""

    def __init__(self, columns: int, rank: int = RANK, seed: int = 13):
        self.b, self.w = 0.0, np.zeros(columns)
        self.v = np.random.Generator(np.random.PCG64(seed)).standard_normal((columns, rank)) * 0.05

    def _sums(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """By document and rank the sums of v x, and by document the whole sum before the logistic function."""
        sums, total = np.zeros((rows.n, self.v.shape[1])), np.full(rows.n, self.b)
        total += np.bincount(rows.doc, self.w[rows.column] * rows.value, minlength=rows.n)
        for k in range(self.v.shape[1]):
            x = self.v[rows.column, k] * rows.value
            sums[:, k] = np.bincount(rows.doc, x, minlength=rows.n)
            total += 0.5 * (sums[:, k] ** 2 - np.bincount(rows.doc, x * x, minlength=rows.n))
        return sums, total

    def score(self, rows: Rows) -> np.ndarray:
        """Probabilities of label 1."""
        return 0.5 + 0.5 * np.tanh(0.5 * self._sums(rows)[1])

    def loss(self, rows: Rows, labels: np.ndarray, weights: np.ndarray) -> float:
        total = self._sums(rows)[1]
        return float(((np.logaddexp(0, total) - labels * total) * weights).sum())

    def gradients(self, rows: Rows, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the weighted logistic loss: by the bias, and by the weights and factors of the columns that occur, which come first."""
        sums, total = self._sums(rows)
        d = (0.5 + 0.5 * np.tanh(0.5 * total) - labels) * weights
        there, where = np.unique(rows.column, return_inverse=True)
        dx = d[rows.doc] * rows.value
        dw = np.bincount(where, dx, minlength=len(there))
        dv = np.empty((len(there), sums.shape[1]))
        squares = np.bincount(where, dx * rows.value, minlength=len(there))
        for k in range(sums.shape[1]):
            dv[:, k] = np.bincount(where, dx * sums[rows.doc, k], minlength=len(there)) - squares * self.v[there, k]
        return float(d.sum()), there, dw, dv

    def fit(self, rows: Rows, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 17) -> None:
        """Adam over batches in random order, moments of a column moving only where it occurs; weights are scaled to a mean of one."""
        rng, weights = np.random.Generator(np.random.PCG64(seed)), weights / weights.mean()
        share = np.clip((labels * weights).sum() / weights.sum(), 1e-3, 1 - 1e-3)
        self.b = float(np.log(share / (1 - share)))
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), self.w, self.v)]
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(rows.n), max(1, -(-rows.n // batch))):
                db, there, dw, dv = self.gradients(rows.of(at), labels[at], weights[at] / len(at))
                now = rate * (1 - epoch / epochs)
                for (m, s), where, g, x in zip(moments, (slice(None), there, there), (np.array([db]), dw + decay * self.w[there], dv + decay * self.v[there]), (None, self.w, self.v), strict=True):
                    m[where] = 0.9 * m[where] + 0.1 * g
                    s[where] = 0.99 * s[where] + 0.01 * g * g
                    step = now * m[where] / (np.sqrt(s[where]) + 1e-8)
                    if x is None:
                        self.b -= float(step[0])
                    else:
                        x[where] -= step


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; no id is not."""
    return by_remainder(doc_id, 5, 0)


def _metadata(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [batch.column(f"m{k}").to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)]


def _columns(docs: DataFrame, metadata: tuple[str, ...]) -> list[Column]:
    """Id, text and metadata; what is not there is null."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[(F.col(x) if x in docs.columns else F.lit(None)).cast("double").alias(f"m{k}") for k, x in enumerate(metadata)]]


def sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED, metadata: tuple[str, ...] = METADATA, bits: int = BITS) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Vectors, labels and weights of ``most`` documents a label at most, those of the least hashes of their ids.

    ``labels(doc_id, quality)``: only 0 and 1 count, and of several labels of one document the least; of several
    rows of one document the least text is taken. Ids are joined, not texts; ``most`` bounds what comes to the driver.
    """
    given = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    counts = {r.label: r.n for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = []
    for label in sorted(counts):
        chosen += [(r.doc_id, label) for r in given.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()]
    if not chosen:
        return _joined([]), np.zeros(0), np.zeros(0)
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    rows = docs.select(*_columns(docs, metadata)).join(F.broadcast(ids), "doc_id")
    names = ["text", *[f"m{k}" for k in range(len(metadata))]]
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*names)).alias("r")).select("doc_id", "label", *[F.col(f"r.{x}").alias(x) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            found = vectors(texts, _metadata(batch, len(metadata)), bits)
            cut = pa.array(np.searchsorted(found.doc, np.arange(found.n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(found.column, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(found.value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "columns", "values"])

    table = rows.mapInArrow(run, "doc_id long, label int, columns array<int>, values array<float>").toArrow().sort_by("doc_id").combine_chunks()
    lists, y = table.column("columns").combine_chunks(), table.column("label").to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    found = Rows(len(y), np.repeat(np.arange(len(y)), sizes), lists.flatten().to_numpy().astype(np.int64), table.column("values").combine_chunks().flatten().to_numpy().astype(np.float64))
    taken = np.bincount(y, minlength=2)
    return found, y.astype(np.float64), np.array([counts.get(k, 0) for k in (0, 1)])[y] / np.maximum(taken, 1)[y]


def train(rows: Rows, labels: np.ndarray, weights: np.ndarray, bits: int = BITS, metadata: int = len(METADATA)) -> Machine:
    """A fitted machine; one of zero weights, so a score of a half for all, if nothing is labelled."""
    machine = Machine(width(bits, metadata))
    if rows.n:
        machine.fit(rows, labels, weights)
    else:
        machine.v[:] = 0
    return machine


def scored(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = METADATA, bits: int = BITS, good: float = GOOD) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs(doc_id, text)`` from its whole text and its metadata.

    A null text is an empty one, which has a score like any other; null or missing metadata have a bin of their own.
    Repeated rows are judged alike; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                score = machine.score(vectors(texts, _metadata(part, len(metadata)), bits))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= good).astype(np.int32))], ["doc_id", "score", "predicted"])
        release()

    return docs.select(*_columns(docs, metadata)).mapInArrow(run, "doc_id long, score double, predicted int")
