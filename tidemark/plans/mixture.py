"""Mixture components with fixed moments: the classes of the points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import hypothesis as H
from ..operators import incremental as I
from ..operators import mixture as M
from ..operators import prepare as P
from ..operators import quantiles as Q
from .registry import query
from .tables import CHUNK, POINTS_SQL, axes, points, r6, read, stream

COMP_SQL = f"""{POINTS_SQL}, mo AS (SELECT label, count(*) AS n, avg(x) AS m1, avg(y) AS m2, covar_samp(x, x) AS s11, covar_samp(x, y) AS s12, covar_samp(y, y) AS s22 FROM points GROUP BY 1),
comp AS (SELECT *, s11 * s22 - s12 * s12 AS det, ln(s11 * s22 - s12 * s12) AS log_det, ln(n / sum(n) OVER ()) AS log_weight FROM mo WHERE n >= 3),
sc AS (SELECT t, x, y, p.label, c.label AS component, (s22 * (x - m1) * (x - m1) - 2 * s12 * (x - m1) * (y - m2) + s11 * (y - m2) * (y - m2)) / det AS maha, log_det, log_weight FROM points p, comp c)"""
BEST_SQL = f"{COMP_SQL}, best AS (SELECT * FROM (SELECT *, maha + log_det - log_weight AS score, row_number() OVER (PARTITION BY t ORDER BY maha + log_det - log_weight, component) AS r FROM sc) WHERE r = 1)"


def comps(spark, sf_dir):
    return M.components(points(spark, sf_dir))


@query(f"WITH {COMP_SQL} SELECT label, n, round(m1, 6) + 0.0::DOUBLE AS m1, round(m2, 6) + 0.0::DOUBLE AS m2, round(s11, 6) AS s11, round(s12, 6) + 0.0::DOUBLE AS s12, round(s22, 6) AS s22, round(log_det, 6) AS log_det FROM comp")
def mean_cov(spark, sf_dir):
    found = M.moments(points(spark, sf_dir))
    plane = {"m1": F.col("mu")[0], "m2": F.col("mu")[1], "s11": F.col("s")[0], "s12": F.col("s")[1], "s22": F.col("s")[3], "log_det": F.col("log_det")}
    return found.select("label", "n", *[r6(c).alias(name) for name, c in plane.items()])


@query(f"WITH {COMP_SQL} SELECT t, round(-(maha + log_det + 2 * ln(2 * pi())) / 2, 6) + 0.0::DOUBLE AS value FROM sc WHERE label = component")
def gauss_logpdf(spark, sf_dir):
    return M.own_scores(points(spark, sf_dir), comps(spark, sf_dir), value="log_density").select("t", r6(F.col("value")).alias("value"))


@query(f"WITH {COMP_SQL} SELECT t, round(maha, 6) + 0.0::DOUBLE AS value FROM sc WHERE label = component")
def mahalanobis(spark, sf_dir):
    return M.own_scores(points(spark, sf_dir), comps(spark, sf_dir), value="mahalanobis").select("t", r6(F.col("value")).alias("value"))


@query(f"WITH {BEST_SQL} SELECT t, component, round(score, 6) + 0.0::DOUBLE AS score FROM best")
def gmm_assign(spark, sf_dir):
    return M.assign(points(spark, sf_dir), comps(spark, sf_dir)).select("t", "component", r6(F.col("score")).alias("score"))


@query(f"WITH {BEST_SQL} SELECT component, round(max(score) + (max(score) - min(score)) / 100, 6) + 0.0::DOUBLE AS relax, round(quantile_cont(score, 0.9), 6) + 0.0::DOUBLE AS strict FROM best GROUP BY 1")
def component_thres(spark, sf_dir):
    found = M.thresholds(M.assign(points(spark, sf_dir), comps(spark, sf_dir)), many=True)
    return found.select("component", r6(F.col("relax")).alias("relax"), r6(F.col("strict")).alias("strict"))


@query(f"WITH {BEST_SQL}, th AS (SELECT component AS c, quantile_cont(score, 0.95) AS th FROM best GROUP BY 1) SELECT t, component FROM best JOIN th ON component = c WHERE score > th")
def uncertain_rows(spark, sf_dir):
    assigned = M.assign(points(spark, sf_dir), comps(spark, sf_dir))
    limits = M.thresholds(assigned, many=False)
    return assigned.join(limits, "component").where("score > relax").select("t", "component")


@query(
    "WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT sum(n) // count(*) * CASE WHEN count(*) >= 5 THEN 0.75 ELSE 0.5 END AS share FROM c) SELECT label, n, n >= least(100, share) AS keep FROM c, k"
)
def component_prune(spark, sf_dir):
    return M.prune(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label")))


@query(f"WITH {BEST_SQL} SELECT component, list(t ORDER BY t) AS idx FROM best GROUP BY 1")
def component_idx(spark, sf_dir):
    assigned = M.assign(points(spark, sf_dir), comps(spark, sf_dir))
    return assigned.groupBy("component").agg(F.array_sort(F.collect_list("t")).alias("idx"))


@query(f"WITH {COMP_SQL} SELECT t, component, round(exp(z) / sum(exp(z)) OVER (PARTITION BY t), 6) AS p FROM (SELECT t, component, log_weight - (maha + log_det + 2 * ln(2 * pi())) / 2 AS z FROM sc)")
def softmax(spark, sf_dir):
    """Each point's posterior of each component."""
    found = M.all_scores(points(spark, sf_dir), comps(spark, sf_dir), value="posterior")
    return found.select("t", F.col("label").alias("component"), r6(F.col("value")).alias("p"))


@query(
    f"WITH m AS (SELECT key, t FROM (SELECT event_id AS t FROM events) JOIN (SELECT event_id // 300 AS key, event_id AS t FROM events WHERE event_id < 600 UNION ALL SELECT 7, event_id FROM events WHERE event_id BETWEEN 450 AND 700) USING (t)), j AS (SELECT coalesce(key::VARCHAR, 'none') AS key FROM events LEFT JOIN m ON event_id = t) SELECT key, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM j GROUP BY 1"
)
def gaussian_pct(spark, sf_dir):
    """The rows' shares in three sets of rows, of which two overlap, and in none."""
    rows = stream(spark, sf_dir)
    t = F.col("t")
    sets = rows.where(t < 600).select(F.floor(t / 300).alias("key"), "t").union(rows.where(t.between(450, 700)).select(F.lit(7).cast("long"), "t"))
    return M.shares(rows.select("t"), sets).select("key", r6(F.col("share")).alias("share"))


HALVES_SQL = f"""{POINTS_SQL}, mo AS (SELECT label + CASE WHEN t % 2 = 0 THEN 0 ELSE 10 END AS label, count(*) AS n, avg(x) AS m1, avg(y) AS m2, covar_samp(x, x) AS s11, covar_samp(x, y) AS s12, covar_samp(y, y) AS s22 FROM points WHERE label < 5 GROUP BY 1),
sc AS (SELECT t, c.label AS component, (s22 * (x - m1) * (x - m1) - 2 * s12 * (x - m1) * (y - m2) + s11 * (y - m2) * (y - m2)) / (s11 * s22 - s12 * s12) + ln(s11 * s22 - s12 * s12) AS score FROM points p, mo c WHERE n >= 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score, component) AS r FROM sc) WHERE r = 1)"""


def _halves(spark, sf_dir):
    rows = points(spark, sf_dir)
    old, new = rows.where("label < 5 and t % 2 = 0"), rows.where("label < 5 and t % 2 = 1")
    return rows, M.components(old).unionByName(M.components(new.withColumn("label", F.col("label") + 10)))


@query(f"WITH {HALVES_SQL} SELECT label AS component, n FROM mo WHERE n >= 3")
def component_union(spark, sf_dir):
    """Components of both halves, the later ones' labels moved past the first ones'."""
    return _halves(spark, sf_dir)[1].select(F.col("label").alias("component"), "n")


@query(f"WITH {HALVES_SQL}, th AS (SELECT component AS c, quantile_cont(score, 0.99) AS th FROM best GROUP BY 1) SELECT component, count(*) AS n, count(*) FILTER (WHERE score > th) AS uncertain, round(count(*) / (SELECT count(*) FILTER (WHERE score <= th) FROM best JOIN th ON component = c), 6) AS weight FROM best JOIN th ON component = c GROUP BY 1")
def gmm_merge(spark, sf_dir):
    """All rows assigned to the union of two mixtures, without weights."""
    rows, both = _halves(spark, sf_dir)
    assigned = M.assign(rows, both, weighted=False)
    limits = assigned.groupBy("component").agg(F.percentile("score", F.lit(0.99)).alias("limit"))
    counts = assigned.join(limits, "component").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") > F.col("limit")).cast("long")).alias("uncertain"))
    return P.with_stats(counts, F.sum(F.col("n") - F.col("uncertain")).alias("sure")).select("component", "n", "uncertain", r6(F.col("n") / F.col("sure")).alias("weight"))


@query(
    f"""WITH RECURSIVE {BEST_SQL}, c AS (SELECT label AS old, component + 100 AS new, count(*) AS n FROM best GROUP BY 1, 2), s AS (SELECT old, new, row_number() OVER (ORDER BY n DESC, old, new) AS i FROM c),
r AS (SELECT 0::BIGINT AS i, []::INT[] AS olds, []::INT[] AS news UNION ALL SELECT s.i, CASE WHEN free THEN list_append(olds, old) ELSE olds END, CASE WHEN free THEN list_append(news, new) ELSE news END FROM (SELECT r.*, s.old, s.new, s.i AS i2, NOT list_contains(olds, old) AND NOT list_contains(news, new) AS free FROM r JOIN s ON s.i = r.i + 1) s),
e AS (SELECT olds, news FROM r ORDER BY i DESC LIMIT 1) SELECT unnest(news) AS new, unnest(olds) AS old FROM e""".replace("SELECT s.i, CASE", "SELECT s.i2, CASE")
)
def component_match(spark, sf_dir):
    """Which class each component of a new fit stands for: the pair of most rows first."""
    assigned = M.assign(points(spark, sf_dir), comps(spark, sf_dir)).select("t", (F.col("component") + 100).alias("new"))
    counts = assigned.join(points(spark, sf_dir).select("t", F.col("label").alias("old")), "t").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))
    return M.matched(counts)


@query(f"WITH {POINTS_SQL} SELECT label, share, round(quantile_cont(x, share), 6) + 0.0::DOUBLE AS quantile FROM (SELECT label, x, unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS share FROM points) GROUP BY 1, 2".replace("quantile_cont(x, share)", "CASE share WHEN 0.05 THEN quantile_cont(x, 0.05) WHEN 0.5 THEN quantile_cont(x, 0.5) ELSE quantile_cont(x, 0.95) END"))
def refined_quantiles(spark, sf_dir):
    """Quantiles of each class by histogram passes, down to brackets of eight values."""
    return Q.exact_quantiles(points(spark, sf_dir), "label", "x", [0.05, 0.5, 0.95], most=8, bins=4).select("label", "share", r6(F.col("quantile")).alias("quantile"))


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def label_freq(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT event_type AS label FROM events")
def distinct_labels(spark, sf_dir):
    return stream(spark, sf_dir).select("label").distinct()


@query(f"SELECT chunk_id, label FROM (SELECT event_id // {CHUNK} AS chunk_id, event_type AS label, row_number() OVER (PARTITION BY event_id // {CHUNK} ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def majority_label(spark, sf_dir):
    counts = stream(spark, sf_dir).groupBy(F.floor(F.col("t") / CHUNK).alias("chunk_id"), "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("chunk_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
    return best.select("chunk_id", F.col("best")["label"].alias("label"))


@query(
    f"""WITH {POINTS_SQL}, f AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE x > 0) AS chosen FROM points GROUP BY 1), g AS (SELECT label, chosen / sum(chosen) OVER () AS of_selection, chosen / n AS of_component, count(*) FILTER (WHERE chosen > 0) OVER () AS k FROM f WHERE chosen > 0)
SELECT label, round(of_selection, 6) AS of_selection, round(of_component, 6) AS of_component, of_selection > 1 / k / 2 AND of_component > 0.5 AS picked FROM g"""
)
def analysis_component(spark, sf_dir):
    """Of a selection (x above 0): which components it mostly is, and mostly takes."""
    counts = points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") > 0).cast("long")).alias("chosen")).where("chosen > 0")
    wide = P.with_stats(counts, F.sum("chosen").alias("all"), F.count(F.lit(1)).alias("k"))
    a, b = F.col("chosen") / F.col("all"), F.col("chosen") / F.col("n")
    return wide.select("label", r6(a).alias("of_selection"), r6(b).alias("of_component"), ((a > 1 / F.col("k") / 2) & (b > 0.5)).alias("picked"))


@query(f"WITH {COMP_SQL}, e AS (SELECT label, 0.5 * log_det + 1 + ln(2 * pi()) AS e FROM comp) SELECT label, round((max(e) OVER () - 0.5 * e) / max(e) OVER () * 0.8, 6) + 0.0::DOUBLE AS alpha FROM e")
def label_alpha(spark, sf_dir):
    """How much the distances within a component shrink, by its entropy."""
    entropy = comps(spark, sf_dir).select("label", (F.col("log_det") / 2 + 1 + F.log(2 * F.pi())).alias("e"))
    return P.with_stats(entropy, F.max("e").alias("top")).select("label", r6((F.col("top") - 0.5 * F.col("e")) / F.col("top") * 0.8).alias("alpha"))


@query(f"WITH {POINTS_SQL}, p AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM points GROUP BY 1) SELECT round(sum(-p * log2(p)) + 1e-4, 6) AS entropy FROM p")
def label_entropy(spark, sf_dir):
    counts = P.with_stats(points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")), F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return counts.agg(r6(F.sum(-p * F.log2(p)) + 1e-4).alias("entropy"))


#: Axes of the queries over more than a plane.
AXES = 8


def _swept(d: int) -> str:
    """Covariances, their log-determinants and inverses by class, in long form: one sweep of the matrix for each axis."""
    parts = [
        f"x AS (SELECT vec_id AS t, label, unnest(range(1, {d + 1})) AS i, unnest(embedding[1:{d}])::DOUBLE AS x FROM embeddings)",
        "mu AS (SELECT label, i, avg(x) AS mu, count(*) AS n FROM x GROUP BY 1, 2)",
        "z AS (SELECT x.t, x.label, x.i, x.x - mu.mu AS z FROM x JOIN mu ON x.label = mu.label AND x.i = mu.i WHERE n >= 3)",
        "w0 AS (SELECT p.label, p.i, q.i AS j, sum(p.z * q.z) / (count(*) - 1) AS a, 0.0::DOUBLE AS ld FROM z p JOIN z q ON p.t = q.t GROUP BY 1, 2, 3)",
    ]
    for k in range(1, d + 1):
        parts.append(
            f"w{k} AS (SELECT label, i, j, CASE WHEN i = {k} AND j = {k} THEN -1 / p WHEN i = {k} OR j = {k} THEN a / p ELSE a - r * c / p END AS a, ld + ln(p) AS ld FROM (SELECT *, max(a) FILTER (WHERE i = {k} AND j = {k}) OVER (PARTITION BY label) AS p, max(a) FILTER (WHERE j = {k}) OVER (PARTITION BY label, i) AS r, max(a) FILTER (WHERE i = {k}) OVER (PARTITION BY label, j) AS c FROM w{k - 1}))"
        )
    return ", ".join(parts)


AXES_SQL = f"""{_swept(AXES)},
comp AS (SELECT label, n, ln(n / sum(n) OVER ()) AS log_weight FROM (SELECT DISTINCT label, n FROM mu WHERE n >= 3)),
inv AS (SELECT label, i, j, -a AS a, ld FROM w{AXES}),
far AS (SELECT x.t, x.label, mu.label AS component, x.i, x.x - mu.mu AS z FROM x JOIN mu ON x.i = mu.i),
sc AS (SELECT p.t, p.label, p.component, sum(p.z * inv.a * q.z) AS maha, max(ld) AS log_det FROM far p JOIN far q ON p.t = q.t AND p.component = q.component JOIN inv ON inv.label = p.component AND inv.i = p.i AND inv.j = q.i GROUP BY 1, 2, 3)"""


def _many(spark, sf_dir):
    rows = axes(spark, sf_dir, AXES)
    return rows, M.components(rows)


@query(f"WITH {_swept(AXES)}, m AS (SELECT label, max(n) AS n, list(round(mu, 6) + 0.0::DOUBLE ORDER BY i) AS mu FROM mu GROUP BY 1), s AS (SELECT label, list(round(a, 6) + 0.0::DOUBLE ORDER BY i, j) AS s FROM w0 GROUP BY 1), l AS (SELECT label, max(ld) AS ld FROM w{AXES} GROUP BY 1) SELECT label, n, mu, s, round(ld, 6) + 0.0::DOUBLE AS log_det FROM m JOIN s USING (label) JOIN l USING (label)")
def mean_cov_axes(spark, sf_dir):
    """Moments on eight axes."""
    found = M.moments(axes(spark, sf_dir, AXES))
    return found.select("label", "n", F.transform("mu", r6).alias("mu"), F.transform("s", r6).alias("s"), r6(F.col("log_det")).alias("log_det"))


@query(f"WITH {AXES_SQL} SELECT t, round(maha, 6) + 0.0::DOUBLE AS value FROM sc WHERE label = component")
def mahalanobis_axes(spark, sf_dir):
    return M.own_scores(*_many(spark, sf_dir), value="mahalanobis").select("t", r6(F.col("value")).alias("value"))


@query(f"WITH {AXES_SQL} SELECT t, round(-(maha + log_det + {AXES} * ln(2 * pi())) / 2, 6) + 0.0::DOUBLE AS value FROM sc WHERE label = component")
def gauss_logpdf_axes(spark, sf_dir):
    return M.own_scores(*_many(spark, sf_dir), value="log_density").select("t", r6(F.col("value")).alias("value"))


@query(f"WITH {AXES_SQL} SELECT t, component, round(score, 6) + 0.0::DOUBLE AS score FROM (SELECT t, component, maha + log_det - log_weight AS score, row_number() OVER (PARTITION BY t ORDER BY maha + log_det - log_weight, component) AS r FROM sc JOIN comp ON component = comp.label) WHERE r = 1")
def gmm_assign_axes(spark, sf_dir):
    return M.assign(*_many(spark, sf_dir)).select("t", "component", r6(F.col("score")).alias("score"))


# Distances of components, and of components and models, on the plane.

GAUSS_SQL = f"{POINTS_SQL}, g AS (SELECT label, count(*) AS n, avg(x) AS m1, avg(y) AS m2, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM points GROUP BY 1)"


def _parts(spark, sf_dir):
    rows = M.moments(points(spark, sf_dir)).orderBy("label").collect()
    total = sum(r["n"] for r in rows)
    return [(r["label"], I.Part.of(np.array(r["mu"]), np.reshape(r["s"], (2, 2)), r["n"], total)) for r in rows]


@query(
    f"""WITH {GAUSS_SQL}, k AS (SELECT p.label AS i, q.label AS j, ((q.c * p.a - 2 * q.b * p.b + q.a * p.c) + q.c * (q.m1 - p.m1) ** 2 - 2 * q.b * (q.m1 - p.m1) * (q.m2 - p.m2) + q.a * (q.m2 - p.m2) ** 2) / (q.a * q.c - q.b * q.b) AS t, ln((q.a * q.c - q.b * q.b) / (p.a * p.c - p.b * p.b)) AS l FROM g p, g q),
d AS (SELECT i, j, (t - 2 + l) / 2 AS kl FROM k) SELECT a.i, a.j, round(a.kl, 6) + 0.0::DOUBLE AS kl, round((a.kl + b.kl) / 2, 6) + 0.0::DOUBLE AS symmetric FROM d a JOIN d b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j"""
)
def gaussian_kl(spark, sf_dir):
    """Of each pair of the classes' components, which are few."""
    parts = _parts(spark, sf_dir)
    made = [(i, j, round(I.kl(a, b), 6) + 0.0, round(I.symmetric_kl(a, b), 6) + 0.0) for i, a in parts for j, b in parts if i < j]
    return spark.createDataFrame(made, "i int, j int, kl double, symmetric double")


@query(
    f"""WITH {GAUSS_SQL}, m AS (SELECT t * 5 // (SELECT max(t) + 1 FROM points) AS model, avg(x) AS m1, avg(y) AS m2, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM points WHERE t * 5 < 3 * (SELECT max(t) + 1 FROM points) GROUP BY 1),
d AS (SELECT label, g.n, model, sqrt((g.m1 - m.m1) ** 2 + (g.m2 - m.m2) ** 2) + g.a + g.c + m.a + m.c - 2 * sqrt(g.a * m.a + 2 * g.b * m.b + g.c * m.c + 2 * sqrt((g.a * g.c - g.b * g.b) * (m.a * m.c - m.b * m.b))) AS d FROM g, m)
SELECT label, model, round(d, 6) + 0.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, model) AS r FROM d) WHERE r = 1"""
)
def component_model(spark, sf_dir):
    """The model nearest to each component, by the distance of means and covariances."""
    rows = P.with_stats(points(spark, sf_dir), (F.max("t") + 1).alias("n")).withColumn("model", F.floor(F.col("t") * 5 / F.col("n"))).where("model < 3")
    models = [(r["model"], I.Part.of(np.array(r["mu"]), np.reshape(r["s"], (2, 2)), r["n"], 1)) for r in M.moments(rows, "model").orderBy("model").collect()]
    made = [(label, *min(((round(I.mean_distance(c, m), 6) + 0.0, k) for k, m in models))[::-1]) for label, c in _parts(spark, sf_dir)]
    return spark.createDataFrame(made, "label int, model long, distance double")


@query(
    f"""WITH {GAUSS_SQL}, w AS (SELECT avg(x) AS m1, avg(y) AS m2, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM points),
t AS (SELECT label, g.n * (g.c * (g.m1 - w.m1) ** 2 - 2 * g.b * (g.m1 - w.m1) * (g.m2 - w.m2) + g.a * (g.m2 - w.m2) ** 2) / (g.a * g.c - g.b * g.b) AS t2,
 (w.c * g.a - 2 * w.b * g.b + w.a * g.c) / (w.a * w.c - w.b * w.b) AS tr, (g.a * g.c - g.b * g.b) / (w.a * w.c - w.b * w.b) AS det, g.n AS n FROM g, w)
SELECT label, round(t2, 6) AS t2, round((tr * tr - 2 * det - 2 * tr + 2) / 2 - tr * tr / n / 2 + 2.0 / n, 6) + 0.0::DOUBLE AS w FROM t"""
)
def class_tests(spark, sf_dir):
    """Whether each class has the mean and the covariance of all points: the statistics, with p-values in ``functions.hypothesis``."""
    rows = points(spark, sf_dir)
    whole = M.moments(rows.withColumn("all", F.lit(0)), "all").first()
    mu, s = np.array(whole["mu"]), np.reshape(whole["s"], (2, 2))
    made = [(r["label"], round(H.mean_test(r["n"], np.array(r["mu"]), np.reshape(r["s"], (2, 2)), mu)[0], 6), round(H.covariance_test(r["n"], np.reshape(r["s"], (2, 2)), s)[0], 6) + 0.0) for r in M.moments(rows).collect()]
    return spark.createDataFrame(made, "label int, t2 double, w double")
