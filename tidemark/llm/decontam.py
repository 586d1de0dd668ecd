"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with runs of white space as one space. An item of n
characters may differ by k = n * rate edits. Cut into k + 1 pieces, it has one piece free of edits
wherever it occurs within k edits, so every occurrence shows as an exact piece hit. The stretch around a hit
is verified by Myers' bit-parallel distance. k is lowered where pieces would be shorter than MIN_PIECE.

Pieces are found by the hashes of their first MIN_PIECE characters (of the whole piece where an item is
shorter), rolled over a text's characters with numpy and looked up in a sorted array, then by those of whole pieces.
Stretches that hits of an item point to are joined where they overlap, so a text that repeats itself is read once. Items go to the executors as a broadcast, so one pass over the texts finds all of them. A worker needs some 12 bytes a character of the items; beyond BLOCK_CHARS
characters, a counted size, they are searched for in several passes.

Items are told apart by item_id and text: an item_id with several texts is found by any of them. Null and
empty items are in nothing, null and empty texts hold nothing, repeated documents give repeated results.
Columns other than doc_id, item_id and text are not looked at. Of equal distances the first end is taken.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import mix, power_tables
from .store import of_worker, release

RATE = 0.05
MIN_PIECE = 12
#: Characters of items in one pass.
BLOCK_CHARS = 64_000_000
#: Hits that are looked at together.
PAIRS = 1 << 18


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the characters times powers of a base, and the inverse powers."""
    power, inverse = power_tables(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9DDFEA08EB382D69) * power[: len(points)], dtype=np.uint64, out=total[1:])
    return total, inverse


def _windows(sums: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """64-bit hashes of the windows of ``width`` characters."""
    total, inverse = sums
    n = max(len(total) - width, 0)
    return mix((total[width:] - total[:n]) * inverse[:n])


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the whole pattern to a stretch of the text, and where the first such ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, at = score, j
            if not best:
                break
    return best, at


class Items:
    """The pieces of some items, by the hashes of their beginnings."""

    #: Bits of the filter that most windows fail.
    FILTER = 22

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_piece: int = MIN_PIECE):
        self.ids, self.texts, self.budgets = [], [], []
        owners, pieces, by_width = [], [], {}
        for item, raw in items:
            text = normal(raw)
            if text:
                k = max(0, min(int(len(text) * rate), len(text) // min_piece - 1))
                for p in range(k + 1):
                    a, b = len(text) * p // (k + 1), len(text) * (p + 1) // (k + 1)
                    by_width.setdefault(min(b - a, min_piece), []).append(len(pieces))
                    owners.append(len(self.ids))
                    pieces.append((a, b))
                self.ids.append(item)
                self.texts.append(text)
                self.budgets.append(k)
        self.owner_of, self.budget_of = np.array(owners, np.int64), np.array(self.budgets, np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.begins = np.array([a for a, _ in pieces], np.int64)
        self.lengths = np.array([b - a for a, b in pieces], np.int64)
        self.codes = np.zeros(len(pieces), np.uint64)
        for p, (a, b) in enumerate(pieces):
            self.codes[p] = _sums(_points(self.texts[owners[p]][a:b]))[0][-1]
        self.tables = []
        for width, some in sorted(by_width.items()):
            own = np.array(some, np.int64)
            codes = np.concatenate([_windows(_sums(_points(self.texts[owners[p]][pieces[p][0] : pieces[p][0] + width])), width) for p in some])
            order = np.argsort(codes, kind="stable")
            likely = np.zeros(1 << self.FILTER, bool)
            likely[(codes >> np.uint64(64 - self.FILTER)).astype(np.int64)] = True
            self.tables.append((width, codes[order], own[order], likely))

    def _hits(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, start) of the stretches of the text that exact hits of whole pieces point to, PAIRS hits at a time."""
        sums = _sums(_points(text))
        total, inverse = sums
        for width, codes, owners, likely in self.tables:
            found = _windows(sums, width)
            places = np.flatnonzero(likely[(found >> np.uint64(64 - self.FILTER)).astype(np.int64)])
            low, high = (np.searchsorted(codes, found[places], side) for side in ("left", "right"))
            places, low, counts = places[high > low], low[high > low], (high - low)[high > low]
            cut, at = np.cumsum(counts), 0
            while at < len(places):
                upto = max(int(np.searchsorted(cut, (cut[at - 1] if at else 0) + PAIRS, "right")), at + 1)
                n = counts[at:upto]
                place = np.repeat(places[at:upto], n)
                piece = owners[np.repeat(low[at:upto] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                end = place + self.lengths[piece]
                inside = end < len(total)
                place, piece, end = place[inside], piece[inside], end[inside]
                hit = (total[end] - total[place]) * inverse[place] == self.codes[piece]
                place, piece = place[hit], piece[hit]
                yield self.owner_of[piece], place - self.begins[piece] - self.budget_of[self.owner_of[piece]]
                at = upto

    def _spans(self, text: str) -> np.ndarray:
        """(item, first start, last start) of joined stretches: starts so near that their stretches overlap are one, so no part is read twice for an item."""
        low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)  # item and start in one number: starts are above -2 ** 30 and below 2 ** 40
        for item, start in self._hits(text):
            new = np.unique((item << 41) + start + (1 << 30))
            low, high = np.concatenate([low, new]), np.concatenate([high, new])
            order = np.argsort(low, kind="stable")
            low, high = low[order], high[order]
            item = low >> 41
            reach = np.maximum.accumulate(high) + self.sizes[item] + 2 * self.budget_of[item]
            first = np.ones(len(low), bool)
            first[1:] = (low[1:] > reach[:-1]) | (item[1:] != item[:-1])
            group = np.flatnonzero(first)
            if len(group):
                low, high = low[group], np.maximum.reduceat(high, group)
        start = lambda x: (x & (1 << 41) - 1) - (1 << 30)
        return np.stack([low >> 41, start(low), start(high)], axis=1)

    def search(self, raw: str | None) -> dict[int, tuple[int, int]]:
        """By item_id found, its least distance and where that ends in the normal text."""
        best: dict[int, tuple[int, int]] = {}
        if not self.texts or not raw:
            return best
        text = normal(raw)
        for item, first, last in self._spans(text).tolist():
            pattern, k, key, start = self.texts[item], self.budgets[item], self.ids[item], max(0, first)
            d, at = myers(pattern, text[start : last + 3 * k + len(pattern)])
            if d <= k and (key not in best or (d, start + at) < best[key]):
                best[key] = (d, start + at)
        return best


def _blocks(items: DataFrame) -> Iterator[Column]:
    """Conditions that deal the item_ids into parts of some BLOCK_CHARS characters, as a rule one."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for b in range(n):
        yield F.pmod(F.xxhash64("item_id"), F.lit(n)) == b if n > 1 else F.lit(True)


def _distinct(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()


def _searchers(items: DataFrame, rate: float, min_piece: int) -> Iterator:
    """For each part of the items a function that gives their ``Items`` in a task: sent as a broadcast of known size."""
    spark, items = items.sparkSession, _distinct(items)
    for where in _blocks(items):
        sent, name = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in items.where(where).collect())), uuid.uuid4().hex
        yield lambda sent=sent, name=name: of_worker(("items", name), lambda: Items(sent.value, rate, min_piece))


def occurrences(docs: DataFrame, items: DataFrame, rate: float = RATE, min_piece: int = MIN_PIECE) -> DataFrame:
    """(doc_id, item_id, distance, match_end) for each document and item found in it, at its least distance.

    ``match_end`` counts characters of the normal text. No shuffle: each task searches its own texts.
    """
    out = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for made in _searchers(items, rate, min_piece):

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            search = made().search
            for batch in batches:
                rows = [(d.as_py(), i, *x) for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for i, x in sorted(search(t.as_py()).items())]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "match_end"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, distance long, match_end long")
        out = found if out is None else out.union(found)
    return out


def _holds(made):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = made().search
        for texts in batches:
            yield pd.Series([bool(search(t)) for t in texts], dtype=bool)
        release(keep_made=True)

    return holds


def contaminated(text: Column, items: DataFrame, rate: float = RATE, min_piece: int = MIN_PIECE) -> Column:
    """Whether the text holds any item."""
    any_of = F.lit(False)
    for made in _searchers(items, rate, min_piece):
        any_of = any_of | _holds(made)(text)
    return any_of
