"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: each source gets a share of all words by its weight, but ``most`` times its own words at most;
what is above is shared again by weight. The level of that water-filling comes from one pass over the
sources in order of the level at which each is full, not from rounds.

Copies: a source's documents are laid out by size; document ``i`` (from 1) ends at ``i * e`` on a line,
with ``e`` = target / words of the source, its expected copies. With one random offset ``u`` of the source,
a document is emitted once per integer between ``(i - 1) * e + u`` and ``i * e + u``. Laying them out by
size makes each run of like-sized documents give its share, so the words taken come near the target.

No task gets a whole source or a hot id: one shuffle deals all rows into ranges of source, size class, remainder of
``doc_id``, size, ``doc_id`` and, of rows that agree in these, of text and place. They are written so, and a
row's place is its place in its file plus the source's rows in earlier files, of which one row each is summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, partitions

#: Remainders of doc_id within each size class: a prime, so that sources that are laid out by a period of
#: doc_id still fall into all of them.
REMAINDERS = 61


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _order(docs: DataFrame) -> list[Column]:
    """The layout of a source's rows: four size classes for each doubling of the words, then remainders of the id."""
    bits = F.concat(F.bin("_size"), F.lit("00"))
    digit = lambda i: (F.substring(bits, i, 1) == "1").cast("int")
    size_class = (F.length(bits) * 4 + digit(2) * 2 + digit(3)).cast("int")
    return [size_class, F.coalesce(F.pmod("_id", F.lit(REMAINDERS)), F.lit(-1)).cast("int"), F.col("_size"), F.col("_id")]


def source_targets(per_source: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(_source, _size, _target) from one row per source with _source and _size.

    Weights repeat along the sources in code point order, null last. The windows run over the sources,
    one narrow row each.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    df = per_source.withColumn("_weight", weight).withColumn("_full", F.col("_size") * float(most)).withColumn("_total", F.sum("_size").over(Window.partitionBy()))
    by_level = Window.orderBy(F.col("_full") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = F.coalesce(F.sum("_full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("_level", (F.col("_total") - before) / rest)
    level = F.max("_level").over(Window.partitionBy())
    return df.select("_source", "_size", F.least(F.col("_full"), level * F.col("_weight")).alias("_target"))


def with_copies(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 1) -> DataFrame:
    """``docs`` (with _id, _source, _size) with _source_size, _target and _copies, as (rows of docs) ++ those three.

    Rows that agree in source, size and id are interchangeable. A source without words has target 0 and no copies.
    """
    spark, names = docs.sparkSession, docs.columns
    order = [F.col("_source"), *_order(docs)]
    dealt = docs.repartitionByRange(partitions(spark), *order, F.xxhash64(*[c for c in names if c not in ("_id", "_source", "_size")] or ["_id"]), F.monotonically_increasing_id())
    # The number of a file in the upper bits and the place in it in the lower ones.
    placed = keep(dealt.sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_row")), "mixed")
    runs = placed.groupBy("_source", F.shiftright("_row", 33).alias("_file")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), F.sum("_size").alias("_words"))
    runs = keep(runs, "runs")
    targets = source_targets(runs.groupBy("_source").agg(F.sum("_words").alias("_size")), weights, most).withColumnsRenamed({"_source": "_s", "_size": "_source_size"})
    earlier = Window.partitionBy("_source").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(targets, F.col("_source").eqNullSafe(F.col("_s")))
    key = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n"))
    digest = F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary"))
    offset = F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536.0  # of few bits: sums with it are exact
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    runs = keep(runs.select(key.alias("_key"), F.col("_file").alias("_in"), "_first", "_before", "_source_size", "_target", rate.alias("_rate"), offset.alias("_offset")), "places")
    rows = placed.join(runs, (key == F.col("_key")) & (F.shiftright("_row", 33) == F.col("_in")))
    place = F.col("_before") + F.col("_row") - F.col("_first") + 1
    end = lambda i: F.floor(i.cast("double") * F.col("_rate") + F.col("_offset"))
    return rows.select(*names, "_source_size", "_target", (end(place) - end(place - 1)).cast("int").alias("_copies"))


def prepared(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), word_count(F.col("text")).alias("_size"), *more)


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 1) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    A null text has size 0 and is taken like others of its size; a null source is a source of its own, after all others. Repeated
    rows count one by one, and rows of one source, size and doc_id are interchangeable. Without rows, or words, nothing is taken.
    """
    names = docs.columns
    out = with_copies(prepared(docs, F.struct(*[docs[c] for c in names]).alias("_row_of_docs")), weights, most, seed)
    return out.where("_copies > 0").withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col("_row_of_docs")[c].alias(c) for c in names])
