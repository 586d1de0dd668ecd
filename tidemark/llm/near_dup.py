"""Near duplicates: universal hash minima, banding, signature and full-set verification, components.

Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of word shingles.

1. One pass over the texts makes each set's 128-bit fingerprint, its signature of MINIMA minima of
   universal hashes (low bytes kept) and its band keys. Copies with equal sets form a class; from here on
   only the class's least doc_id takes part.
2. Within a bucket (band key) each member is paired with the least member only; components of those
   pairs are families. A link between two sets lies in one family unless no band agrees, which has a
   chance of MISSED at most (4e-6 for 85 %, 1.3e-5 for 80 %).
3. Families of up to BLOCK members are each verified in memory: signatures first, then full sets.
   Larger ones are dealt into blocks: first every member against its buckets' least members, by which copies of
   one original come together; then, of what is still apart, chunk against chunk, all pairs of members
   of different components. Nothing is capped: the pairs that no block looks at are known to be in one
   component. A block emits the links that join its components, fewer than it has members.
4. Components of all verified links.

Large groups are split by a hash of the member, so no task holds more than two chunks of a family; joins
of members with their group are such that adaptive execution can split them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scan import mix, shingle_sets
from .store import join_groups, keep, partitions, release

WIDTH = 5
MINIMA = 224
#: The chance at most that a pair at exactly the limit shares no band.
MISSED = 2e-5
#: Members of a chunk.
BLOCK = 128
#: How far below the limit an estimate from signatures may be, at 224 minima over 6 standard deviations.
MARGIN = 0.15

_rng = np.random.Generator(np.random.PCG64(85))
_A = (_rng.integers(0, 2**31, MINIMA, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.int64).astype(np.uint32)
_KEY = (_rng.integers(1, 2**62, 7, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """By set, the least value of each universal hash (a * x + b modulo 2**32); sets mustn't be empty."""
    joined = np.concatenate(sets)
    x = (joined ^ (joined >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(_A, _B, strict=True)], axis=1)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: as many rows as MISSED allows, 7 at most."""
    for rows in range(len(_KEY), 1, -1):
        bands = MINIMA // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    return MINIMA, 1


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    words = found[:, : bands * rows].reshape(len(found), bands, rows).astype(np.uint64)
    return mix((words * _KEY[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _fingerprint(codes: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = np.bitwise_xor.reduce(mix(codes + np.uint64(1))), np.sum(mix(codes ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(shingle_sets([(x or b"").lower() for x in part.column("text").cast(pa.large_binary()).to_pylist()], WIDTH))
            some = [k for k, x in enumerate(sets) if len(x)]
            signature, bands = [None] * len(sets), [None] * len(sets)
            if some:
                found = minima([sets[k] for k in some])
                low, keys = found.astype(np.uint8), band_keys(found, *shape)
                for i, k in enumerate(some):
                    signature[k], bands[k] = low[i].tobytes(), keys[i]
            prints = [_fingerprint(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"],
            )
    release()


class _Joined:
    """Union-find over a block's members."""

    def __init__(self, groups: list[int]):
        first: dict[int, int] = {}
        self.to = [first.setdefault(g, i) for i, g in enumerate(groups)]

    def find(self, i: int) -> int:
        while self.to[i] != i:
            self.to[i] = i = self.to[self.to[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.to[self.find(j)] = self.find(i)


def verify(ids: list[int], groups: list[int], sides: list[int], texts: list[bytes | None], signatures: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join what isn't joined yet, of all pairs of members (of different sides, if there are two)."""
    n, joined, sets = len(ids), _Joined(groups), {}
    marks = np.frombuffer(b"".join(signatures), np.uint8).reshape(n, -1)
    side = np.array(sides)
    two = side.min() != side.max()
    likely = []
    for i in range(n - 1):
        same = (marks[i + 1 :] == marks[i]).sum(axis=1)
        ok = same >= (percent / 100 - MARGIN) * marks.shape[1]
        if two:
            ok &= side[i + 1 :] != side[i]
        likely += [(-int(same[k]), i, i + 1 + int(k)) for k in np.flatnonzero(ok)]
    for _, i, j in sorted(likely):
        if joined.find(i) != joined.find(j):
            for k in (i, j):
                if k not in sets:
                    sets[k] = next(shingle_sets([(texts[k] or b"").lower()], WIDTH))
            small, large = len(sets[i]), len(sets[j])
            if 100 * min(small, large) < percent * max(small, large):
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (small + large - shared):
                joined.join(i, j)
                yield ids[i], ids[j]


#: Bits of the filter that texts pass before they are shuffled: 2 MB, so it may be broadcast.
FILTER_BITS = 1 << 24


def _among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose key is among ``ids(id)``, and a few more: a filter of fixed size, so most others aren't shuffled."""
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = ids.select(code("id").alias("code")).groupBy(F.bitmap_bucket_number("code").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("_bits"))
    place = F.bitmap_bit_position(code(key)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = rows.withColumn("_here", F.bitmap_bucket_number(code(key)))
    found = here.join(F.broadcast(bits), F.col("_here") == F.col("_bucket"))
    return found.where(F.getbit(byte, place % 8) == 1).select(*rows.columns)


def _members(ids: DataFrame, profiles: DataFrame, docs: DataFrame) -> DataFrame:
    """(t, signature, text) of the documents of ``ids(id)``: whole texts are shuffled once, and read from here on."""
    texts = _among(docs.select(F.col("doc_id").cast("long").alias("t"), F.col("text").cast("string").alias("text")), "t", ids)
    marks = profiles.select(F.col("doc_id").alias("s"), "signature").join(ids, F.col("s") == F.col("id"), "left_semi")
    return keep(marks.join(texts, F.col("s") == F.col("t")).select("t", "signature", "text"), "texts")


def _verified(blocks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of blocks(block, side, id, comp), by ``_members``; each block's rows come together in one task."""
    rows = blocks.join(texts, F.col("id") == F.col("t")).select("block", "side", "id", "comp", "signature", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            links = list(verify([r[2] for r in held], [r[3] for r in held], [r[1] for r in held], [r[5] for r in held], [r[4] for r in held], percent)) if len(held) > 1 else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [batch.column(c) for c in ("block", "side", "id", "comp", "signature")] + [batch.column("text").cast(pa.large_binary())]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in columns)
                if held and held[0][0] != row[0]:
                    yield flush()
                held.append(row)
        yield flush()
        release()

    return rows.repartition(partitions(blocks.sparkSession), "block").sortWithinPartitions("block").mapInArrow(run, "u long, v long")


def _chunks(n, member):
    """The chunk of a member of a group of n, and the number of chunks."""
    count = F.ceil(n / BLOCK)
    return F.pmod(F.xxhash64(member), count), count


def links(firsts: DataFrame, profiles: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Verified links between classes, enough to make their components. ``firsts``: the classes' rows of ``profiles``."""
    keys = firsts.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    least = keys.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = keep(join_groups(keys, least, F.col("key") == F.col("k")).where("id != hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct(), "pairs")
    families = keep(components(pairs), "families")
    sizes = families.groupBy(F.col("root").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    members = keep(join_groups(families, sizes, F.col("root") == F.col("family")).select(F.col("node").alias("id"), "family", "n"), "sized")
    texts = _members(members.select("id"), profiles, docs)
    small = members.where(F.col("n") <= BLOCK).select(F.xxhash64("family").alias("block"), F.lit(0).alias("side"), "id", F.col("id").alias("comp"))
    found = keep(_verified(small, texts, percent), "links")
    large = members.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return found

    # Members against the least members of their buckets, so many at a time.
    spokes = pairs.join(large.select(F.col("id").alias("i"), "family"), F.col("u") == F.col("i")).select("u", "v")
    by_hub = spokes.groupBy(F.col("v").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    dealt = join_groups(spokes, by_hub, F.col("v") == F.col("h"))
    chunk, _ = _chunks(F.col("n"), F.col("u"))
    dealt = dealt.select("u", F.col("v").alias("hub"), F.xxhash64("v", chunk).alias("block"))
    first = dealt.select("block", F.lit(1).alias("side"), F.col("u").alias("id"), F.col("u").alias("comp")).union(dealt.select("block", F.lit(0), F.col("hub"), F.col("hub")).distinct())
    spoken = keep(_verified(first, texts, percent), "spokes")
    found = found.union(spoken)

    # What is still apart: chunks of all but the family's main component against all chunks.
    parts = components(spoken).select(F.col("node"), F.col("root").alias("comp"))
    apart = large.join(parts, F.col("id") == F.col("node"), "left").select("id", "family", F.coalesce("comp", "id").alias("comp"))
    counts = apart.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), "comp"))
    of_family = counts.groupBy(F.col("family").alias("f")).agg(best.alias("best"), F.sum("c").alias("all"))
    rest = F.col("all") + F.col("best")["c"]
    counts = join_groups(counts, of_family, F.col("family") == F.col("f")).where(rest > 0)
    main = F.col("comp") == F.col("best")["comp"]
    of_part = counts.select(F.col("family").alias("cf"), F.col("comp").alias("cc"), main.alias("main"), F.when(main, F.col("c")).otherwise(rest).alias("n"))
    marked = join_groups(apart, of_part, (F.col("family") == F.col("cf")) & (F.col("comp") == F.col("cc"))).select("id", "family", "comp", "main", "n")
    chunk, _ = _chunks(F.col("n"), F.col("id"))
    marked = keep(marked.select("id", "family", "comp", "main", chunk.alias("chunk")), "chunks")
    kinds = marked.select("family", "main", "chunk").distinct()
    other = kinds.select(F.col("family").alias("f"), F.col("main").alias("main2"), F.col("chunk").alias("chunk2"))
    turns = kinds.where("not main").join(other, F.col("family") == F.col("f")).where("main2 or chunk2 >= chunk").drop("f", "main")
    turns = turns.withColumn("block", F.xxhash64("family", "chunk", "main2", "chunk2"))
    one_chunk = ~F.col("main2") & (F.col("chunk") == F.col("chunk2"))
    sides = turns.select("block", "family", F.lit(False).alias("tm"), F.col("chunk").alias("tc"), F.lit(0).alias("side")).union(turns.where(~one_chunk).select("block", "family", "main2", "chunk2", F.lit(1)))
    sides = sides.withColumnRenamed("family", "tf")
    last = sides.join(marked, (F.col("tf") == F.col("family")) & (F.col("tm") == F.col("main")) & (F.col("tc") == F.col("chunk"))).select("block", "side", "id", "comp")
    return found.union(keep(_verified(last, texts, percent), "last"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``.

    Letters A-Z count as lower-case. A text of fewer than five words is one shingle; a null or empty one
    is linked with nothing. Rows with one doc_id count as one document with all their sets. A row without
    doc_id is linked with nothing, has no component_id and is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = banding(percent)
    profiles = keep(docs.mapInArrow(lambda batches: _profile(batches, shape), "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"), "profiles")
    usable = profiles.where("n_shingles > 0 and doc_id is not null")
    if not usable.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows would meet each other in joins by id
        usable, docs = usable.dropDuplicates(["doc_id", "set_a", "set_b"]), docs.distinct()
    classes = usable.groupBy(F.col("set_a").alias("a"), F.col("set_b").alias("b")).agg(F.min("doc_id").alias("class"))
    members = keep(join_groups(usable.select("doc_id", "set_a", "set_b"), classes, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b"))).select("doc_id", "class").distinct(), "members")
    firsts = usable.join(members.select(F.col("class").alias("c")).distinct(), F.col("doc_id") == F.col("c"), "left_semi")
    # A doc_id with several sets ties their classes together.
    ties = members.where("doc_id != class").select(F.col("doc_id").alias("u"), F.col("class").alias("v"))
    roots = components(links(firsts, usable, docs.where("doc_id is not null"), percent).union(ties))
    roots = roots.select(F.col("node"), F.col("root"))
    out = profiles.select("doc_id", "n_shingles").join(roots, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id, and of repeated rows one.

    Rows are repeated if they agree in doc_id and text. Only rows whose doc_id occurs more than once, or is null, are
    looked at for that.
    """
    gone = keep(near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    left = docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    again = keep(left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again")), "again")
    if again.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(F.col("_again"))
    names = [F.col(c) for c in docs.columns]
    digest = F.xxhash64("text", F.lit(1)), F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    # Rows of one doc_id and text are thinned out by each task before they are shuffled.
    some = left.join(again, same, "left_semi").groupBy("doc_id", *digest).agg(F.first(F.struct(*names)).alias("_row"))
    return left.join(again, same, "left_anti").union(some.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
