"""Repair of the structure of conversations: faults of rows, and the cheapest edits that make the roles alternate.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. Each row is kept (K, 0), given the role that
the place needs (R, 3) or deleted (D, 4; a must for blank and duplicate rows), empty user or assistant rows are
inserted anywhere (I, 3), and a truncated row that stays costs 3 more. Of the cheapest edits those with the
ASCII-least letters are taken.

The edits are paths through a graph of rows and four states (nothing yet, after s, after u, after a). A path's
weight is one integer: its cost in the high digits, below them a slot of three octal digits for each row and one
for the end, which hold the letters (D 1, I 2, K 3, R 4) of the inserts before the row and of the row itself,
padded at the end with zeros. A row's slot ends with a letter other than I, so no slot is the start of another,
and comparing slots compares audits. The least sum of integers thus gives cost and audit at once; stretches of
rows are matrices of such sums, multiplied by halves.

Spark does the rest: rows are dealt by ranges of (conversation, turn, role), numbered, and gathered in stretches
of ``STRETCH`` rows as two letters a row (initial and fault); what one task has of a conversation is that string,
which is as long as the audit that the result holds. The texts are shuffled once, to be hashed in their order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, partitions

BLANKS = " \t\n\x0b\x0c\r"
#: Rows whose letters are gathered in one list.
STRETCH = 1024

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = "-DIKR"
#: Octal digits of a slot: two inserts at most and the row's own letter. No way between two states needs three inserts.
WIDTH = 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled row leads to, and the one that each initial leads to.
NEXT = (USER, USER, ASSISTANT, USER)
LEADS = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}

Matrix = tuple[tuple[int | None, ...], ...]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of what a seeded fault leaves of each row; null roles and texts are one space.

    By crc32 of ``conv_id:turn`` (a null is one space) modulo 20, a row is dropped (0), emptied (1), loses its
    ``.!?`` (2), comes twice (3) or gets the role user (4).
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def joined(rows: DataFrame, found: DataFrame, *names: str) -> DataFrame:
    """All of ``rows``, with what ``found`` has for their values of ``names``; nulls are equal."""
    found = found.withColumnsRenamed({x: f"_{x}" for x in names})
    return rows.join(found, reduce(and_, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in names]), "left").drop(*[f"_{x}" for x in names])


def marks(rows: DataFrame) -> DataFrame:
    """(conv_id, marks): two letters for each row, in the order of turn (nulls first), role and text.

    The first is the role's initial (s, u, a, or o for any other and for an empty role), the second the first
    fault: b blank, d duplicate (its role and text were seen before), t truncated, k none. Identical rows may be
    dealt to several tasks: any order of them is the same.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"), "text")
    # Only where rows of one turn and role have different texts does the text take part in the order.
    tied = keep(narrow.groupBy("conv_id", "turn", "role").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least != most").select("conv_id", "turn", "role"), "tied").withColumn("tied", F.lit(True))
    narrow = joined(narrow, tied, "conv_id", "turn", "role").withColumn("tie", F.when(F.col("tied"), F.col("text"))).drop("text").withColumn("any", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "tie", "any"]
    ordered = narrow.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ordered = keep(ordered.select("conv_id", "role", "digest", "initial", "fault", F.monotonically_increasing_id().alias("at")), "ordered")
    first = ordered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    fault = F.when((F.col("fault") != "b") & (F.col("at") > F.col("first")), "d").otherwise(F.col("fault"))
    found = joined(ordered, first, "conv_id", "role", "digest").select("conv_id", "at", F.concat("initial", fault).alias("mark"))
    parts = found.groupBy("conv_id", F.shiftright("at", STRETCH.bit_length() - 1).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "mark"))).alias("rows"))
    parts = parts.select("conv_id", F.struct("at", F.array_join(F.col("rows.mark"), "").alias("marks")).alias("part"))
    return parts.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("part"))["marks"], "").alias("marks"))


def _slot(inserts: int, letter: str) -> int:
    word = "I" * inserts + letter
    return int("".join(str(LETTERS.index(x)) for x in word.ljust(WIDTH, "-")), 8)


@lru_cache(maxsize=64)
def row(initial: str, fault: str) -> Matrix:
    """The least weight of each way from state to state over one row, inserts before it included."""
    best: list[list[int | None]] = [[None] * 4 for _ in range(4)]

    def offer(start: int, end: int, cost: int, slot: int) -> None:
        weight = cost << 3 * WIDTH | slot
        now = best[start][end]
        best[start][end] = weight if now is None else min(now, weight)

    for start in range(4):
        state = start
        for inserts in range(WIDTH):
            cost = INSERT * inserts
            offer(start, state, cost + DELETE, _slot(inserts, "D"))
            if fault not in "bd":
                stays = cost + (TRUNCATED if fault == "t" else 0)
                offer(start, NEXT[state], stays + REROLE, _slot(inserts, "R"))
                if (initial, state) in LEADS:
                    offer(start, LEADS[initial, state], stays, _slot(inserts, "K"))
            state = NEXT[state]
    return tuple(map(tuple, best))


def times(a: Matrix, n: int, b: Matrix, m: int) -> Matrix:
    """The least sums over n rows and then m: the first's letters move up by the second's, the second's cost by the first's."""
    low = 3 * WIDTH * m
    up = 3 * WIDTH * n
    a = tuple(tuple(None if v is None else v << low for v in r) for r in a)
    b = tuple(tuple(None if v is None else (c := v >> low) << low + up | v - (c << low) for v in r) for r in b)
    return tuple(tuple(min((x[y] + b[y][z] for y in range(4) if x[y] is not None and b[y][z] is not None), default=None) for z in range(4)) for x in a)


@lru_cache(maxsize=4096)
def short(marks: str) -> Matrix:
    return product(marks)


def product(marks: str) -> Matrix:
    """The least weights from state to state over all rows."""
    n = len(marks) // 2
    if n == 1:
        return row(*marks)
    half = 1 << (n - 1).bit_length() - 1
    of = short if half <= 16 else product
    return times(of(marks[: 2 * half]), half, of(marks[2 * half :]), n - half)


def cheapest(marks: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, of equal costs the ASCII-least letters."""
    if not marks:
        return 0, ""
    n = len(marks) // 2
    digits = 3 * WIDTH
    from_start = product(marks)[NOTHING]
    sums = []
    for state, weight in enumerate(from_start):
        for inserts in range(WIDTH):
            if weight is not None and state in (NOTHING, ASSISTANT):
                cost, letters = weight >> digits * n, weight & (1 << digits * n) - 1
                sums.append(cost + INSERT * inserts << digits * (n + 1) | letters << digits | _slot(inserts, ""))
            state = NEXT[state]
    least = min(sums)
    letters = format(least & (1 << digits * (n + 1)) - 1, "o").zfill(WIDTH * (n + 1))
    return least >> digits * (n + 1), letters.translate({48 + k: x if k else "" for k, x in enumerate(LETTERS)})


def summary(marks: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost and audit of a conversation's rows."""
    initials, faults = marks[0::2], marks[1::2]
    legal = sum(len(re.findall(f"(?={pair})", initials)) for pair in ("su", "ua", "au"))
    return faults.count("b"), faults.count("d"), faults.count("t"), max(len(initials) - 1, 0) - legal, *cheapest(marks)


def decided(found: DataFrame) -> DataFrame:
    """The counts, cost and audit of each row of ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[summary(x) for x in batch.column("marks").to_pylist()], strict=True)) or [[]] * 6
            made = [pa.array(x, pa.int64()) for x in columns[:5]] + [pa.array(columns[5], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return found.mapInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, str | None]]:
    """From rows in order, each conversation led by one of kind 0 with its audit as text: that row with (role, text) of what its edits leave, and with nulls at its end."""
    head = None

    def made() -> str:
        nonlocal state
        state = NEXT[state]
        return "user" if state == USER else "assistant"

    def take(row: dict) -> Iterator[tuple[str, str]]:
        nonlocal state
        for letter in next(slots).group():
            if letter == "I":
                yield made(), ""
            elif letter == "R":
                yield made(), row["text"]
            elif letter == "K":
                state = LEADS[row["role"][:1], state]
                yield row["role"], row["text"]

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if head is not None:
                    yield from ((head, *line) for line in take({}))
                    yield head, None, None
                head, state, slots = row, NOTHING, re.finditer("I*([DKR]|$)", row["text"])
            else:
                yield from ((head, *line) for line in take(row))
    if head is not None:
        yield from ((head, *line) for line in take({}))
        yield head, None, None


def _in_order(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's head and then its rows, in one task after the other: the one shuffle of the texts."""
    heads = heads.withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit("")})
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").drop("turn")


def _filled(made: Iterator[dict], schema: pa.Schema, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(made, rows)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``original``: the faults of its ``rows`` and the cheapest repair.

    A null conv_id is a conversation of its own. Rows of one turn go by role, then by text, so repeated rows
    follow each other. Without rows: zeros, an empty audit and the hash of an empty text. A null turn takes part
    in the order (first) and not in the gaps. A very long conversation passes through the last task row by row.
    """
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    judged, ids = decided(marks(rows)), original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = joined(joined(ids, turns, "conv_id"), judged, "conv_id")
    heads = heads.select("conv_id", F.coalesce("audit", F.lit("")).alias("text"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in NUMBERS])
    schema = pa.schema([("conv_id", pa.int64()), *[(x, pa.int64()) for x in NUMBERS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, between = hashlib.sha256(), ""
        for head, role, text in edited(batches):
            if role is None:
                yield head | {"audit": head["text"], "repaired_sha256": total.hexdigest()}
                total, between = hashlib.sha256(), ""
            else:
                total.update(f"{between}{role}:{text}".encode())
                between = "\n"

    return _in_order(heads, rows).mapInArrow(lambda batches: _filled(hashed(batches), schema), f"conv_id long, {', '.join(f'{x} long' for x in NUMBERS)}, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the conversations after their edits, places from 0. Nulls, ties and repeats as in ``repaired``."""
    heads = decided(marks(rows)).select("conv_id", F.col("audit").alias("text"))
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place = 0
        for head, role, text in edited(batches):
            if role is None:
                place = 0
            else:
                yield {"conv_id": head["conv_id"], "place": place, "role": role, "text": text}
                place += 1

    return _in_order(heads, rows).mapInArrow(lambda batches: _filled(placed(batches), schema), "conv_id long, place long, role string, text string")


#: Weights as strings: cost in ten digits, then the letters. Edges between the states 0 to 3 by initial and fault.
SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
  lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM g),
step AS (SELECT unnest([0, 1, 2, 3]) AS x),
ins AS (SELECT x, x AS y, 0 AS n, '' AS w FROM step UNION ALL SELECT x, CASE x WHEN 2 THEN 3 ELSE 2 END, 1, 'I' FROM step UNION ALL SELECT x, CASE x WHEN 2 THEN 2 ELSE 3 END, 2, 'II' FROM step),
e AS MATERIALIZED (SELECT x, y AS z, 3 * n + 4 AS cost, w || 'D' AS w, NULL::VARCHAR AS c, 'D' AS kind FROM ins
  UNION ALL SELECT x, CASE y WHEN 2 THEN 3 ELSE 2 END, 3 * n + 3, w || 'R', NULL::VARCHAR, 'R' FROM ins
  UNION ALL SELECT x, q.z, 3 * n, w || 'K', q.c, 'K' FROM ins JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS q(y, c, z) USING (y)),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS x, '0000000000' AS v FROM r
  UNION ALL SELECT p.conv_id, p.i + 1, e.z, min(lpad((left(p.v, 10)::INT + e.cost + CASE WHEN r.fault = 't' AND e.kind <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 10, '0') || substr(p.v, 11) || e.w)
  FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN e ON e.x = p.x AND (e.kind = 'D' OR (r.fault IN ('k', 't') AND (e.kind = 'R' OR e.c = r.c))) GROUP BY p.conv_id, p.i + 1, e.z),
n AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id),
b AS (SELECT p.conv_id, min(lpad((left(p.v, 10)::INT + 3 * ins.n)::VARCHAR, 10, '0') || substr(p.v, 11) || ins.w) AS v FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i JOIN ins ON ins.x = p.x AND ins.y IN (0, 3) GROUP BY p.conv_id),
l AS (SELECT conv_id, substr(v, 11) AS audit, unnest(range(1, length(v) - 9)) AS j FROM b),
z AS (SELECT l.conv_id, l.j, l.audit[l.j] AS w, r.role, r.text FROM l LEFT JOIN r ON l.audit[l.j] <> 'I' AND r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = 1 + length(replace(left(l.audit, l.j - 1), 'I', '')) WHERE l.audit[l.j] NOT IN ('D', '')),
s AS (SELECT *, bool_or(w = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS led, row_number() OVER (PARTITION BY conv_id ORDER BY j) AS place FROM z),
h AS (SELECT conv_id, string_agg(CASE WHEN w = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN w = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS repaired FROM s GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(left(v, 10)::BIGINT, 0) AS cost, coalesce(substr(v, 11), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id
"""
