"""The operators over their whole tables, as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, factors, html_text, language, lattice, mixing, near_dup, periodic, quality, secrets, token_files, urls
from .store import keep, new_path, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=1)
    return token_files.token_index(spark, path)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(keep(mixing.prepared(table(spark, sf_dir, "documents")), "sizes"))
    return mixed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT) AS weight FROM s),
l AS (SELECT *, source_size * 3.0::DOUBLE AS full_, sum(source_size) OVER ()::BIGINT AS total FROM w),
v AS (SELECT *, (total - coalesce(sum(full_) OVER (ORDER BY full_ / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY full_ / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT source, source_size, least(full_, max(level) OVER () * weight) AS target FROM v),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(md5(coalesce('s' || d.source, 'n') || ':1'), 1, 4))::BIGINT / 65536.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 4 + (substr(bin(size) || '00', 2, 1) = '1')::INT * 2 + (substr(bin(size) || '00', 3, 1) = '1')::INT, coalesce(((doc_id % 61) + 61) % 61, -1), size, doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(i::DOUBLE * rate + u) - floor((i - 1)::DOUBLE * rate + u))::BIGINT * size)::BIGINT AS taken FROM c
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    found = quality.judge(table(spark, sf_dir, "documents"), trusted, "doc_id")
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept")


#: The counts by lists and windows, and the ratios of hashed byte n-grams by one row a byte; for the parameters of ``quality``.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM d),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM c),
t AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM t WHERE w3 IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(3) AS r(k)) GROUP BY doc_id),
g AS (SELECT doc_id, (code % 4294967296)::UBIGINT * 2654435761::UBIGINT % 4294967296::UBIGINT // 65536 AS bucket
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(bs) - 1), lambda i: (bs[i] * 16777619 + bs[i + 1]) * 16777619 + bs[i + 2])) AS code FROM c)),
b AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM g GROUP BY bucket),
p AS (SELECT bucket, good, (raw + 1) / (sum(raw) OVER () + 65536) AS p, sum(good) OVER () AS all_good FROM b),
s AS (SELECT doc_id, avg(ln((good + 16384 * p) / ((all_good + 16384) * p))) AS score FROM g JOIN p USING (bucket) GROUP BY doc_id),
n AS (SELECT c.doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(score, 0) AS score
  FROM c LEFT JOIN rep ON c.doc_id = rep.doc_id LEFT JOIN s ON c.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND score >= -0.25 AS kept FROM n
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    network = language.train(language.sample(docs.where(~held)))
    return language.identify(docs, network).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: All pairs of documents that share a shingle, and what is reachable by links.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 4], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN r ON w.doc_id = r.a GROUP BY w.doc_id, n.n
"""


def op11_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = factors.held_out(F.col("doc_id"))
    machine = factors.train(*factors.sample(docs.where(~held), labels.where(~held)))
    return factors.scored(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repaired(rows, conversations.damaged(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_lattice": op6_lattice,
    "op7_html": op7_html,
    "op8_urls": op8_urls,
    "op9_decontamination": op9_decontamination,
    "op10_near_dup": op10_near_dup,
    "op11_factors": op11_factors,
    "op12_periodic": op12_periodic,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op4_quality": OP4_SQL, "op8_urls": urls.SQL, "op10_near_dup": OP10_SQL, "op12_periodic": periodic.SQL, "op13_conversations": conversations.SQL}
