"""Term weights of the documents, and texts taken apart and put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from ..sources import files
from ..sources.kept import new_path
from ..sources.snapshots import Snapshots
from ..streaming import replay
from .registry import query
from .tables import r6, read, stream

TFIDF_SQL = """tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT doc_id, tf.term, tf * ln((SELECT count(DISTINCT doc_id) FROM documents) / df) AS weight FROM tf JOIN df ON tf.term = df.term),
top AS (SELECT term, sum(weight) AS weight FROM w GROUP BY 1 HAVING sum(weight) > 0 ORDER BY 2 DESC, 1 LIMIT 10)"""


def weights(spark, sf_dir):
    return X.tfidf(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {TFIDF_SQL} SELECT doc_id, term, round(weight, 6) + 0.0::DOUBLE AS weight FROM w")
def tfidf_build(spark, sf_dir):
    return weights(spark, sf_dir).select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query(f"WITH {TFIDF_SQL} SELECT term, round(weight, 4) AS weight FROM top")
def tfidf_top(spark, sf_dir):
    """The ten weightiest terms of the corpus."""
    return X.top_terms(weights(spark, sf_dir), 10).select("term", F.round("weight", 4).alias("weight"))


@query(f"WITH {TFIDF_SQL} SELECT w.doc_id, round(sum(w.weight), 4) AS score FROM w JOIN top ON w.term = top.term GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def tfidf_titles(spark, sf_dir):
    """The three documents with most of the ten weightiest terms."""
    w = weights(spark, sf_dir)
    return X.top_documents(w, X.top_terms(w, 10), 3).select("doc_id", F.round("score", 4).alias("score"))


@query("SELECT page_id, split_part(regexp_replace(regexp_replace(html, ' lang=\"[^\"]*\"', ''), '<title>', '$area$', 'g'), '$', 1) || '<svg no=\"' || page_id || '\">' || regexp_replace(html, ' lang=\"[^\"]*\"', '', 'g') AS svg FROM pages")
def svg_strip(spark, sf_dir):
    """Markup without an attribute, put after a template's head."""
    html = F.regexp_replace("html", ' lang="[^"]*"', "")
    head = F.split(F.regexp_replace(html, "<title>", "\\$area\\$"), "\\$")[0]
    return read(spark, sf_dir, "pages").select("page_id", F.concat(head, F.lit('<svg no="'), F.col("page_id").cast("string"), F.lit('">'), html).alias("svg"))


@query("SELECT event_id AS t, event_type AS label, value AS x FROM events WHERE event_id < 1000 UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id >= 1000")
def union_batches(spark, sf_dir):
    rows = stream(spark, sf_dir).select("t", "label", "x")
    return rows.where("t < 1000").unionByName(rows.where("t >= 1000"))


@query("SELECT doc_id AS t FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    return rows.where("quality = 1").select(F.col("doc_id").alias("t")).subtract(rows.where("toxic = 1").select("doc_id"))


@query("SELECT doc_id AS t FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_intersect(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    return rows.where("quality = 1").select(F.col("doc_id").alias("t")).intersect(rows.where("toxic = 1").select("doc_id"))


@query("SELECT event_id AS t, value AS x, event_type AS label FROM events")
def snapshot_roundtrip(spark, sf_dir):
    """The stream from a snapshot that was just written."""
    snapshots = Snapshots(spark)
    name = snapshots.save({"stream": stream(spark, sf_dir)})
    return snapshots.load(name)["stream"]


@query("SELECT event_id AS t, value AS x, event_type AS label FROM events")
def csv_roundtrip(spark, sf_dir):
    """The stream written as CSV and read by its schema."""
    path = new_path(spark, "csv")
    rows = stream(spark, sf_dir)
    files.write_csv(rows, path)
    return files.scan_csv(spark, path, rows.schema)


@query("SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS term_idx, label AS term FROM (SELECT DISTINCT event_type AS label FROM events)")
def terms_roundtrip(spark, sf_dir):
    """A vocabulary written as a JSON list and read with the places of its terms."""
    path = new_path(spark, "terms")
    terms = stream(spark, sf_dir).agg(F.to_json(F.array_sort(F.collect_set("label"))).alias("value"))
    terms.coalesce(1).write.text(path)
    return files.scan_terms(spark, path)


@query("SELECT event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS batch, count(*) AS n, min(event_id) AS first, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_replay(spark, sf_dir):
    """The stream replayed in four batches, a file a trigger, and what each brought."""
    rows, folder, out = stream(spark, sf_dir), new_path(spark, "batches"), new_path(spark, "replayed")
    n = rows.agg(F.max("t")).first()[0] + 1
    replay.write_batches(rows, folder, [(-(-n * k // 4), -(-n * (k + 1) // 4)) for k in range(4)])
    replay.replay(replay.read_batches(spark, folder, rows.schema), new_path(spark, "offsets"), lambda batch, number: batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(out))
    found = spark.read.parquet(out)
    return found.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.round(F.sum("x"), 4).alias("total"))
