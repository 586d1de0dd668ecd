"""Periodic runs of words, by recompression.

The words of many whole texts are laid end to end as numbers, a number of its own after each text. Two rounds
alternate until no symbol is there twice: blocks a...a become one symbol of (a, length), and pairs ab, of an a of
the left and a b of the right half of the symbols, one symbol. Equal stretches are parsed alike but for their
edges, so the rounds' sequences are a run-length grammar on which the longest common extension of two places is
found going up while both places begin a symbol, and down again once the symbols differ.

A run of period q has at least max(24, 3q) words, so it holds two places of a grid of step max(q, 8), and the words
q and 2q behind them. Places whose words agree there are the candidates; their exact extensions to the right and left
are asked of the grammar, for all candidates of a text at a time. Nothing is sorted but symbols; there is no suffix array.

Memory follows one slice of texts, or one longer text; candidates are made ``TOGETHER`` at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import mix, slices
from .store import release

#: Least words of a run, and least number of its periods.
LEAST, TIMES = 24, 3
#: Steps of the grid where periods are shorter: a run of LEAST words holds STEP places before and 2 * STEP after one.
STEP = LEAST // TIMES
#: Bytes of texts with one grammar, and candidates that are looked at together.
SLICE_BYTES, TOGETHER = 1 << 20, 1 << 20


class Grammar:
    """The sequences of all rounds: for each, its symbols, their lengths in words, and where their parents and first and last children stand."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.sizes = [symbols.astype(np.int64)], [np.ones(len(symbols), np.int64)]
        self.parents: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.block: list[bool] = []
        self.lasts: list[np.ndarray] = []
        fresh, salt = int(symbols.max(initial=0)) + 1, 0
        # Once all symbols differ no two places agree; more rounds than needed do no harm.
        while salt % 4 or len(np.unique(self.symbols[-1])) < len(self.symbols[-1]):
            now = self.symbols[-1]
            starts = np.ones(len(now), bool)
            if salt % 2 == 0:
                starts[1:] = now[1:] != now[:-1]
                keys = self._blocks(starts)
            else:
                left = (mix(now.astype(np.uint64) + np.uint64(salt << 40)) >> np.uint64(63)).astype(bool)
                starts[1:] = ~(left[:-1] & ~left[1:])
                keys = self._pairs(starts)
            self.block.append(salt % 2 == 0)
            salt += 1
            self._add(starts, keys, fresh)
            fresh = max(fresh, int(self.symbols[-1].max()) + 1)

    def _blocks(self, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.flatnonzero(starts)
        return self.symbols[-1][first], np.diff(np.append(first, len(starts)))

    def _pairs(self, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.flatnonzero(starts)
        long = np.diff(np.append(first, len(starts))) > 1
        return self.symbols[-1][first], np.where(long, self.symbols[-1][np.minimum(first + 1, len(starts) - 1)] + 2, 1)

    def _add(self, starts: np.ndarray, keys: tuple[np.ndarray, np.ndarray], fresh: int) -> None:
        """The next sequence; symbols of one child (second key 1) stay as they are."""
        first, (a, b) = np.flatnonzero(starts), keys
        many = b > 1
        symbols = a.copy()
        if many.any():
            code = a[many] * (int(b.max()) + 1) + b[many]
            symbols[many] = fresh + np.unique(code, return_inverse=True)[1]
        self.parents.append((np.cumsum(starts) - 1).astype(np.int64))
        self.firsts.append(first)
        self.lasts.append(np.append(first[1:], len(starts)) - 1)
        self.symbols.append(symbols)
        self.sizes.append(np.add.reduceat(self.sizes[-1], first))

    def extensions(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from x and from y on (leftwards if ``back``, the places themselves included) are equal. Each y is to meet a number of its own in the way."""
        step = -1 if back else 1
        x, y, total = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        rising, top = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(len(self.parents)):
            if not len(rising):
                break
            edge = self.lasts[level] if back else self.firsts[level]
            self._walk(level, x, y, total, rising, step, edge)
            a, b = x[rising], y[rising]
            up = self.symbols[level][a] == self.symbols[level][b]
            parents = self.parents[level]
            up &= (edge[parents[a]] == a) & (edge[parents[b]] == b)
            top[rising] = level
            rising = rising[up]
            x[rising], y[rising] = parents[x[rising]], parents[y[rising]]
        top[rising] = len(self.parents)
        for level in range(len(self.parents), -1, -1):
            falling = np.flatnonzero(top == level)
            if not len(falling):
                continue
            self._walk(level, x, y, total, falling, step, None)
            if level:
                down = self.lasts[level - 1] if back else self.firsts[level - 1]
                x[falling], y[falling] = down[x[falling]], down[y[falling]]
                top[falling] = level - 1
        return total

    def _walk(self, level: int, x: np.ndarray, y: np.ndarray, total: np.ndarray, who: np.ndarray, step: int, edge: np.ndarray | None) -> None:
        """Go on while the symbols are equal, until (with ``edge``) both places are at the edge of a parent; equal blocks at once."""
        symbols, sizes = self.symbols[level], self.sizes[level]
        blocks = level < len(self.block) and self.block[level]
        if blocks:
            ends = self.lasts[level] if step > 0 else self.firsts[level]
        while len(who):
            a, b = x[who], y[who]
            go = symbols[a] == symbols[b]
            if edge is not None:
                parents = self.parents[level]
                go &= (edge[parents[a]] != a) | (edge[parents[b]] != b)
            who, a, b = who[go], a[go], b[go]
            if blocks:
                n = np.minimum(np.abs(ends[self.parents[level][a]] - a), np.abs(ends[self.parents[level][b]] - b)) + 1
            else:
                n = 1
            total[who] += n * sizes[a]
            x[who], y[who] = a + step * n, b + step * n


def candidates(symbols: np.ndarray, start: int, n: int, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grids of all periods of the n words from ``start`` on, where the words one and two periods behind agree."""
    most = n // TIMES
    periods = np.arange(1, most + 1)
    steps = np.maximum(periods, STEP)
    counts = np.maximum(n - 2 * periods - 1, -1) // steps + 1
    cut = np.cumsum(counts)
    at = 0
    while at < most:
        upto = max(int(np.searchsorted(cut, (cut[at - 1] if at else 0) + together, "right")), at + 1)
        q = np.repeat(periods[at:upto], counts[at:upto])
        k = np.arange(len(q)) - np.repeat(cut[at:upto] - counts[at:upto] - (cut[at - 1] if at else 0), counts[at:upto])
        place = start + k * np.maximum(q, STEP)
        word = symbols[place]
        hit = np.flatnonzero(word == symbols[place + q])
        hit = hit[word[hit] == symbols[place[hit] + 2 * q[hit]]]
        yield place[hit], q[hit]
        at = upto


def runs(grammar: Grammar, starts: np.ndarray, sizes: np.ndarray, together: int = TOGETHER) -> list[np.ndarray]:
    """Of each text, given its first place and its number of words, (start, length, period) of its runs, by start and then period."""
    found, waiting, held = [np.zeros((0, 4), np.int64)], [], 0

    def extend() -> None:
        if waiting:
            text, place, q = np.concatenate(waiting, axis=1)
            waiting.clear()
            before = grammar.extensions(place - 1, place + q - 1, back=True)
            length = before + grammar.extensions(place, place + q) + q
            run = (length >= LEAST) & (length >= TIMES * q)
            found.append(np.unique(np.stack([text, place - before - starts[text], length, q], axis=1)[run], axis=0))

    for k in np.flatnonzero(sizes >= LEAST).tolist():
        for place, q in candidates(grammar.symbols[0], int(starts[k]), int(sizes[k]), together):
            if len(place):
                waiting.append(np.stack([np.full(len(place), k), place, q]))
                held += len(place)
            if held >= together:
                extend()
                held = 0
    extend()
    rows = np.unique(np.concatenate(found), axis=0)
    # Of one stretch the least period counts: rows are sorted by text, start, length and period.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cut = np.searchsorted(rows[:, 0], np.arange(len(starts) + 1))
    return [rows[i:j, 1:] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Whether a word is in a run, after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; of equal ones the first, then that of the least period."""
    best = None
    for start, length, period in found.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def damage(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on a text repeats which period, by crc32 of its id: a tenth of the texts with words."""
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    start = g % n
    return None if rest else (start, 1 + (n - start) // (3 + g % 8))


def repeated(words: list[bytes], start: int, period: int) -> list[bytes]:
    """The words with each one from ``start`` on taken from the first ``period`` of these."""
    some = words[start : start + period]
    n = len(words) - start
    return words[:start] + (some * -(-n // period))[:n]


def collapsed(texts: list[list[bytes]]) -> list[tuple[np.ndarray, bytes]]:
    """Of each text's words: its runs, and the words that stay, with one space between."""
    table: dict[bytes, int] = {}
    for words in texts:
        for word in dict.fromkeys(words):
            table.setdefault(word, len(table))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes  # a number of its own stands before each text, and one after the last
    symbols = np.arange(len(table), len(table) + int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    for words, at in zip(texts, starts, strict=True):
        symbols[at : at + len(words)] = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    out = []
    for words, found in zip(texts, runs(Grammar(symbols), starts, sizes), strict=True):
        out.append((found, b" ".join(words if not len(found) else [words[k] for k in np.flatnonzero(~dropped(found, len(words)))])))
    return out


RUNS = "array<struct<start: long, length: long, period: long>>"


def _judged(docs: DataFrame, digest: bool, damages: bool) -> DataFrame:
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, " + ("runs_sha256 string, collapsed_sha256 string" if digest else f"runs {RUNS}, collapsed string")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]

    def rows(part: pa.RecordBatch) -> Iterator[dict]:
        ids, texts = part.column("doc_id").to_pylist(), [x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()]
        for i, j in slices(texts, SLICE_BYTES):
            split = []
            for doc, text in zip(ids[i:j], texts[i:j], strict=True):
                words = text.split()
                fault = damage(doc, len(words)) if damages else None
                split.append(repeated(words, *fault) if fault else words)
            for doc, (found, text) in zip(ids[i:j], collapsed(split), strict=True):
                best = strongest(found)
                row = dict(zip(names, (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2]), strict=False))
                if digest:
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found.tolist())
                    yield row | {"runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest()}
                else:
                    yield row | {"runs": [dict(zip(("start", "length", "period"), x, strict=True)) for x in found.tolist()], "collapsed": text.decode()}

    last = [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] if digest else [("runs", pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), ("collapsed", pa.string())]
    made = pa.schema([(x, pa.int64()) for x in names[:6]] + last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield pa.RecordBatch.from_pylist(list(rows(batch.slice(at, 512))), schema=made)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed) of every row of ``docs(doc_id, text)``.

    ``runs`` are all runs by start and then period; the four columns are those of the one with the greatest length /
    period, null without runs; ``collapsed`` has the words outside of runs and each run's first period. A null text is
    one without words. Each row is judged by itself, repeated rows and those without an id too; other columns are not read.
    """
    return _judged(docs, digest=False, damages=False)


def digests(docs: DataFrame, damages: bool = True) -> DataFrame:
    """As ``find``, with hashes of the runs and of the words that stay; first a tenth of the texts are made periodic by ``damage`` (never one without an id)."""
    return _judged(docs, digest=True, damages=damages)


#: Candidates on the grid, then the stretches of all places whose word is the one a period later.
SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, t),
a AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS bad, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM h),
p AS MATERIALIZED (SELECT doc_id, n, CASE WHEN bad THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM a),
w AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(list_transform(ws, lambda x: hash(x))) AS w FROM p WHERE n >= 24),
q AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, n, ws, q, unnest(range(0, n - 2 * q, greatest(q, 8))) AS i FROM (SELECT doc_id, n, ws, unnest(range(1, n // 3 + 1)) AS q FROM p WHERE n >= 24)) WHERE ws[i + 1] = ws[i + q + 1] AND ws[i + 1] = ws[i + 2 * q + 1]),
m AS (SELECT w.doc_id, q, w.i, w.i - row_number() OVER (PARTITION BY w.doc_id, q ORDER BY w.i) AS stretch FROM q JOIN w ON w.doc_id = q.doc_id JOIN w AS v ON v.doc_id = q.doc_id AND v.i = w.i + q WHERE v.w = w.w),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, stretch HAVING count(*) + q >= 24 AND count(*) >= 2 * q),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, max(length::DOUBLE / period) AS e FROM r GROUP BY doc_id),
o AS (SELECT doc_id, start, length, period FROM r JOIN b USING (doc_id) WHERE length::DOUBLE / period = e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, period) = 1),
d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT p.doc_id, CASE WHEN x.gone IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_filter(range(p.n), lambda i: NOT list_contains(x.gone, i)), lambda i: ws[i + 1]), ' ') END AS kept FROM p LEFT JOIN (SELECT doc_id, list(i) AS gone FROM d GROUP BY doc_id) x USING (doc_id))
SELECT c.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(kept) AS collapsed_sha256
FROM c LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)
"""
