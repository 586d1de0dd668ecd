"""Term weights of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import keep

#: Terms whose frequencies are sent to all tasks at most; more are joined by shuffling all counts once more.
SENT = 1 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf): runs of a-z of the lower-cased text. Texts are shuffled, which are smaller than their terms as rows."""
    terms = docs.repartition("doc_id").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, sent: int = SENT) -> DataFrame:
    """(doc_id, term, weight): tf * ln(N / df); terms of all documents weigh 0."""
    counts = term_counts(docs)
    df = keep(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    n = docs.agg(F.countDistinct("doc_id").alias("n"))
    few = df.limit(sent + 1).count() <= sent
    return counts.join(F.broadcast(df) if few else df, "term").join(F.broadcast(n)).select("doc_id", "term", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("weight"))


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    """(term, weight): of the largest summed weights above 0, ties by term."""
    return weights.groupBy("term").agg(F.sum("weight").alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "term").limit(k)


def top_documents(weights: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(doc_id, score): of the largest sums over the terms, ties by id."""
    return weights.join(F.broadcast(terms.select("term")), "term").groupBy("doc_id").agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
