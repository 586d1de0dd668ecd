"""Steps that met all pairs: the same results by products and sums of blocks, and copies that grow slower than the rows' squares."""

import numpy as np
import pyarrow as pa

from tidemark.operators import forest, layout, pairs, text


def frame(spark, x, name="i"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{name} long, v array<double>")


def odd_rows():
    """Copies, clusters far apart and tight in themselves, and a row at no distance."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((150, 5)), np.ones((40, 5)), 1e6 + 1e-4 * rng.standard_normal((60, 5)), [[np.nan] * 5]])
    return x[rng.permutation(len(x))]


def test_large_tables_are_dealt_into_few_blocks(spark):
    assert [pairs.blocks_of(spark.range(n)) for n in (0, 500, 10_256, 102_564, 615_384)] == [1, 1, 6, 8, 19]


def test_nearest_by_products_is_that_of_differences(spark):
    x = odd_rows()
    with np.errstate(invalid="ignore"):
        d = pairs.distance_block(x, x)
    np.fill_diagonal(d, np.inf)
    d[np.isnan(d)] = np.inf
    order = np.lexsort((np.tile(np.arange(len(x)), (len(x), 1)), d), axis=1)[:, :7]
    truth = {(i, int(j), float(d[i, j]), rank) for i in range(len(x)) for rank, j in enumerate(order[i], 1) if np.isfinite(d[i, j])}
    for blocks in (1, 4):
        found = pairs.nearest(frame(spark, x), frame(spark, x, "j"), 7, n_blocks=blocks, itself=False)
        assert {(r.i, r.j, r.d, r["rank"]) for r in found.collect()} == truth


def test_distances_by_products_keep_close_rows(spark):
    x = odd_rows()
    x = x[np.isfinite(x).all(axis=1)]
    found, truth = pairs.distances(x, x[:70]), pairs.distance_block(x, x[:70])
    assert (np.abs(found - truth) <= 1e-9 * truth).all() and (found[truth == 0] == 0).all()


def test_repulsion_and_all_anchors_are_their_plain_sums(spark):
    rng = np.random.default_rng(6)
    v, at = rng.standard_normal((90, 4)), rng.standard_normal((90, 2)) * 5
    at[1] = at[0]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at.tolist())], "t long, x double, y double")
    way = at[:, None] - at[None]
    q = 1 / (1 + (way**2).sum(axis=2))
    np.fill_diagonal(q, 0)
    found = np.array(sorted(map(tuple, layout.repulsion(points, 3).collect())))
    assert np.allclose(found[:, 1:], np.column_stack([q.sum(axis=1), ((q * q)[..., None] * way).sum(axis=1)]), rtol=1e-12, atol=1e-12)
    held = np.arange(0, 90, 7)
    w = 1.0 + held % 3
    rows = spark.createDataFrame([(k, a.tolist(), *p) for k, (a, p) in enumerate(zip(v, at.tolist(), strict=True))], "t long, v array<double>, x double, y double")
    anchors = rows.where("t % 7 = 0").selectExpr("t AS a", "v", "x", "y", "1.0D + t % 3 AS w")
    p = np.exp(-0.1 * pairs.distance_block(v, v[held]) ** 2)
    p = p / p.sum(axis=1, keepdims=True) * w
    way = at[:, None] - at[held][None]
    q = 1 / (1 + (way**2).sum(axis=2))
    truth = (((p / p.sum() - q * w / (q * w).sum()) * q)[..., None] * way).sum(axis=1)
    found = np.array(sorted(map(tuple, layout.gradient_of_all_anchors(rows, anchors, 0.1).collect())))
    assert np.allclose(found[:, 1:], truth, rtol=1e-9, atol=1e-13)


def test_term_weights_shuffle_texts_once_and_do_not_depend_on_the_join(spark):
    docs = spark.createDataFrame([(1, "A b b c"), (1, "b d"), (2, "c, d-d"), (3, None), (None, "b")], "doc_id long, text string")
    plan = text.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    sent, joined = (sorted(map(str, text.tfidf(docs, n).collect())) for n in (100, 0))
    assert sent == joined and len(sent) == 7


def test_a_forest_of_too_little_recall_gives_way_to_the_exact_search(spark):
    x = np.random.default_rng(8).standard_normal((600, 30))  # distances all alike, which splits can't tell apart
    a, b = frame(spark, x), frame(spark, x, "j")
    exact = {(r.i, r.j) for r in pairs.nearest(a, b, 5, itself=False).collect()}
    some = {(r.i, r.j) for r in forest.nearest_by_forest(a, b, 5, itself=False, trees=2, leaf=20, recall=0.9).collect()}
    assert len(exact & some) >= 0.9 * len(exact)


def test_distances_of_large_blocks_leave_their_task_in_parts(spark):
    x = np.random.default_rng(9).standard_normal((2600, 3))
    left = np.arange(2600) < 1400
    rows = pa.record_batch([pa.array(range(2600)), pa.array(x.tolist()), pa.array(left)], ["i", "v", "_left"])
    parts = list(pairs.given(iter([rows.slice(0, 900), rows.slice(900)])))
    assert max(p.num_rows for p in parts) <= pairs.GIVEN**2 < 1400 * 1200
    i, j, d = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(3))
    truth = pairs.distance_block(x[left], x[~left])
    assert len(i) == truth.size and (d == truth[i, j - 1400]).all()
    found = sorted(map(tuple, pairs.all_distances(frame(spark, x[:50]), frame(spark, x[:40], "j"), 3).collect()))
    assert [r[:2] for r in found] == [(i, j) for i in range(50) for j in range(40)]
    assert np.array_equal(np.array([r[2] for r in found]).reshape(50, 40), pairs.distance_block(x[:50], x[:40]))


def test_rows_of_all_distances_are_shuffled_once_whatever_the_blocks(spark):
    """They were copied for each block of the other side, so what was shuffled grew with the square of the rows."""
    x = np.random.default_rng(10).standard_normal((90, 3))
    found = pairs.all_distances(frame(spark, x), frame(spark, x[:50], "j"), 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange RoundRobinPartitioning(6)") == 2
    d = np.full((90, 50), np.nan)
    for r in found.collect():
        d[r.i, r.j] = r.d
    assert np.array_equal(d, pairs.distance_block(x, x[:50]))
    assert pairs.all_distances(frame(spark, x), frame(spark, x, "j").limit(0)).count() == 0
