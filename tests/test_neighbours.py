"""Approximate and pruned neighbours against exact ones, and counts of what was not looked at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, forest, pairs, pivots
from tidemark.streaming import sliding


def table(spark, x, name):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{name} long, v array<double>")


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((25, 6)) * 20
    return np.concatenate([centres[rng.integers(0, 25, 1500)] + rng.standard_normal((1500, 6)), np.zeros((60, 6)), rng.integers(0, 3, (40, 6))])


def rows_of(df):
    return sorted((r.i, r.j, round(r.d, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def exact(spark, clusters):
    return rows_of(pairs.nearest(table(spark, clusters, "i"), table(spark, clusters, "j"), 5, itself=False))


def test_pruned_neighbours_are_exact_and_most_rings_are_not_visited(spark, clusters, exact):
    found, share = pivots.search(table(spark, clusters, "i"), table(spark, clusters, "j"), 5, itself=False)
    assert rows_of(found) == exact
    assert share < 0.15


def test_pruned_neighbours_of_few_rows_and_of_none(spark):
    x = np.array([[0.0, 0], [1, 0], [5, 5]])
    found = pivots.nearest_pruned(table(spark, x[:1] + 9, "i"), table(spark, x, "j"), 5)
    assert [r.j for r in found.orderBy("rank").collect()] == [2, 1, 0]
    assert pivots.nearest_pruned(table(spark, x, "i"), table(spark, x, "j").limit(0), 5).count() == 0
    assert pivots.nearest_pruned(table(spark, x, "i").limit(0), table(spark, x, "j"), 5).count() == 0


@pytest.mark.parametrize("sample", [forest.SAMPLE, 150])
def test_the_forest_finds_nine_tenths_whether_grown_at_once_or_in_rounds(spark, clusters, exact, sample):
    found = rows_of(forest.nearest_by_forest(table(spark, clusters, "i"), table(spark, clusters, "j"), 5, itself=False, leaf=100, sample=sample))
    assert len(set(found) & set(exact)) >= 0.9 * len(exact)
    assert len(found) == len(exact) and len({(i, j) for i, j, _ in found}) == len(found)


def test_leaves_are_small_and_hold_each_row_once_a_tree(spark, clusters):
    right = table(spark, clusters[:1500], "id")
    _, b = forest.in_leaves(right, right, trees=3, leaf=50, sample=150)
    assert b.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0] <= 50
    assert b.groupBy("tree", "id").count().where("count != 1").count() == 0 and b.count() == 4500


def test_leaves_of_few_rows_are_those_of_all_and_no_others(spark, clusters):
    right = table(spark, clusters[:1500], "id")
    a, every = forest.in_leaves(right.where("id % 300 = 7"), right, trees=3, leaf=50, sample=150)
    few, b = forest.in_leaves(right.where("id % 300 = 7"), right, trees=3, leaf=50, sample=150, few=True)
    of = lambda df: {(r.tree, r.leaf, r.id) for r in df.collect()}
    leaves = {k[:2] for k in of(a)}
    assert of(few) == of(a) and of(b) == {k for k in of(every) if k[:2] in leaves} and b.count() <= 15 * 50


def test_rows_without_enough_rows_in_their_leaves_are_searched_for_exactly(spark):
    x = np.random.default_rng(2).standard_normal((30, 2))
    found = rows_of(forest.nearest_by_forest(table(spark, x, "i"), table(spark, x, "j"), 20, itself=False, trees=1, leaf=4))
    assert found == rows_of(pairs.nearest(table(spark, x, "i"), table(spark, x, "j"), 20, itself=False))
    assert forest.nearest_by_forest(table(spark, x, "i"), table(spark, x, "j").limit(0), 3).count() == 0


def test_equal_rows_do_not_make_large_leaves(spark):
    x = np.concatenate([np.zeros((3000, 2)), np.ones((5, 2))])
    found = forest.nearest_by_forest(table(spark, x, "i"), table(spark, x, "j"), 2, itself=False, trees=2, leaf=10)
    by = {r.i: sorted(q.j for q in found.where(F.col("i") == r.i).collect()) for r in found.where("i in (0, 7, 2999, 3001)").select("i").distinct().collect()}
    assert by == {0: [1, 2], 7: [0, 1], 2999: [0, 1], 3001: [3000, 3002]}


def test_the_cheapest_setting_above_the_recall_is_chosen(spark, clusters):
    found = forest.settings(table(spark, clusters, "i"), 5, leaves=(20, 80), trees=6, queries=100).collect()
    assert len(found) == 12
    chosen = [r for r in found if r.chosen]
    assert len(chosen) == 1 and chosen[0].recall >= 0.9
    assert chosen[0].cost == min(r.cost for r in found if r.recall >= 0.9)


@pytest.mark.parametrize("sent", [pairs.SENT, 0])
def test_neighbours_on_one_axis_with_ties_and_nulls(spark, sent):
    rng = np.random.default_rng(4)
    values, labels = np.round(rng.standard_normal(500), 1), rng.choice(["a", "b", "c"], 500)
    rows = [(t, float(x), str(c)) for t, (x, c) in enumerate(zip(values, labels, strict=True))]
    extra = [(900, None, "a"), (901, float("nan"), "a"), (902, 1.0, None), (903, 1.0, "only here")]
    table = spark.createDataFrame(rows + extra, "t long, x double, label string").repartition(3)
    trained = table.where("t % 4 = 0 or t = 900 or t = 902")
    expected = []
    for t, x, c in rows:
        own = sorted((abs(x - y), u) for u, y, e in rows if u % 4 == 0 and e == c)
        expected += [(t, c, u, round(d, 9)) for d, u in own[:6]]
    found = pairs.nearest_of_label(table, trained, 6, sent=sent)
    assert sorted((r.i, r.label, r.j, round(r.d, 9)) for r in found.collect()) == sorted(expected)
    assert pairs.nearest_of_label(table, trained.limit(0), 6, sent=sent).count() == 0


def test_followed_windows_are_those_of_the_batch_plan(spark):
    """On two axes, row by row, with the state written and read again every few rows."""
    rng = np.random.default_rng(5)
    rows = [(t, [float(a), float(b)], rng.choice(["a", "b", "c"])) for t, (a, b) in enumerate(rng.standard_normal((120, 2)))]
    rows = [(t, v, str(c)) for t, v, c in rows]
    table = spark.createDataFrame(rows, "t long, v array<double>, label string")
    trained = table.where("t < 40 and label != 'c'")
    expected = {r.t: r.drift for r in drift.sliding(table, trained, 12, 3).collect()}
    near = {r.t: [[n.j, list(n.v)] for n in r.near] for r in sliding.with_near(table, trained, 3).collect()}
    found, followed = dict.fromkeys(range(120), 0.0), {c: sliding.Followed(12) for c in "abc"}
    for t, v, c in [*rows, *[(119, None, c) for c in "abc"]]:
        for s, e, score in followed[c].on(t, v, near.get(t)):
            for k in range(s, e):
                found[k] += score / 12
        if t % 7 == 0:
            followed[c] = sliding.Followed(12, followed[c].dump())
    assert sorted(expected) == list(range(11, 120))
    assert all(found[t] == pytest.approx(expected[t], abs=1e-9) for t in expected)
