"""Repulsion by the adaptive tree and anchored layouts as jobs, against plain sums."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import layout as L
from tidemark.operators import quadtree as Q


def positions(spark, x):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "t long, x double, y double")


@pytest.fixture(scope="module")
def clustered():
    """Wide and very dense parts and equal points: cells of the last levels are needed."""
    rng = np.random.default_rng(1)
    return np.concatenate([rng.standard_normal((300, 2)) * 20, rng.standard_normal((300, 2)) * 1e-3 + 5, np.full((50, 2), 3.0)])


def plain(x):
    way = x[:, None] - x[None]
    q = 1 / (1 + (way**2).sum(axis=2))
    np.fill_diagonal(q, 0)
    return q.sum(axis=1), ((q * q)[..., None] * way).sum(axis=1)


@pytest.mark.parametrize("sent", [Q.SENT, 0])
def test_forces_are_exact_at_no_angle_and_close_at_the_usual_one(spark, clustered, sent):
    q, f = plain(clustered)
    at = positions(spark, clustered).repartition(3)
    for theta, most in ((0.0, 1e-9), (0.3, 0.01)):
        found = Q.repulsion_by_tree(at, theta=theta, leaf=8, sent=sent).toPandas().sort_values("i")
        assert found["i"].tolist() == list(range(len(clustered)))
        assert np.abs(found["q"] / q - 1).max() < most
        assert np.linalg.norm(found[["fx", "fy"]].to_numpy() - f, axis=1).max() < most * np.linalg.norm(f, axis=1).mean()


def test_tree_of_few_equal_and_no_points(spark):
    for sent in (Q.SENT, 0):
        same = Q.repulsion_by_tree(positions(spark, np.full((40, 2), 2.0)), leaf=4, sent=sent).toPandas()
        assert (same["q"] == 39).all() and (same[["fx", "fy"]] == 0).all().all()
        assert Q.repulsion_by_tree(positions(spark, np.zeros((1, 2))), sent=sent).collect()[0].q == 0
    assert Q.repulsion_by_tree(positions(spark, np.zeros((1, 2))).limit(0)).count() == 0


def test_cells_of_the_table_are_those_of_the_arrays(spark, clustered):
    square = (float(clustered[:, 0].min()), float(clustered[:, 1].min()), float(np.ptp(clustered, axis=0).max()) * (1 + 1e-9))
    code = Q.codes(clustered[:, 0], clustered[:, 1], square)
    order = np.argsort(code, kind="stable")
    tree = Q.Tree.of(code[order], clustered[order, 0], clustered[order, 1], 8)
    rows = Q.cells(Q._coded(positions(spark, clustered), square), 8).collect()
    assert {(r.level, r.cell, r.n) for r in rows} == set(zip(tree.level.tolist(), tree.code.tolist(), tree.n.tolist(), strict=True))
    assert len(rows) == len(tree.n) and max(r.level for r in rows) > 12
    lows = Q.boxes(tree.level, tree.code, square)
    inside = (tree.x >= lows[0] - 1e-9) & (tree.x <= lows[0] + lows[2] + 1e-9) & (tree.y >= lows[1] - 1e-9) & (tree.y <= lows[1] + lows[2] + 1e-9)
    assert inside.all()


def test_an_anchored_layout_in_rounds_is_that_of_one_task(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal((14, 3)), rng.standard_normal((14, 3)) + 6])
    points = spark.createDataFrame([(t, x.tolist(), t % 2) for t, x in enumerate(v)], "t long, v array<double>, label int")
    placed = positions(spark, rng.standard_normal((20, 2)) * 5)
    one = L.continued(points, placed, perplexity=4.0, rounds=4).toPandas().sort_values("t")
    jobs = L.continued_in_rounds(points, placed, perplexity=4.0, rounds=4, k=100, repel=L.repulsion).toPandas().sort_values("t")
    assert one["t"].tolist() == jobs["t"].tolist() == list(range(28))
    assert np.abs(one[["x", "y"]].to_numpy() - jobs[["x", "y"]].to_numpy()).max() < 0.02 * np.abs(one[["x", "y"]].to_numpy()).max()


def test_an_anchored_layout_ends_when_its_error_is_stale(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(t, rng.standard_normal(3).tolist(), 0) for t in range(12)], "t long, v array<double>, label int")
    found = L.continued_in_rounds(points, positions(spark, rng.standard_normal((9, 2))), perplexity=3.0, rounds=2, stale=0)
    assert found.count() == 12  # the first error ends it


def test_groups_of_leaves_in_many_parts_give_the_sums_of_the_arrays(spark):
    """Equal points fill one leaf, which is more than a group and more than a piece."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((500, 2)) * 10, np.full((2100, 2), 3.0)])
    at, square = positions(spark, x), (float(x[:, 0].min()), float(x[:, 1].min()), float(np.ptp(x, axis=0).max()) * (1 + 1e-9))
    one = Q._by_tasks(at, square, 0.5, 8).toPandas().sort_values("i").to_numpy()
    found = Q._by_joins(at, square, 0.5, 8, most=60, piece=400).toPandas().sort_values("i").to_numpy()
    assert found.shape == one.shape and np.allclose(found, one, rtol=1e-9, atol=1e-9)


def test_groups_do_not_become_more_as_points_do(spark):
    for n in (20_000, 80_000):
        x = np.random.default_rng(5).random((n, 2))
        frame = spark.createDataFrame(pd.DataFrame({"t": range(n), "x": x[:, 0], "y": x[:, 1]}))
        tree = Q.cells(Q._coded(frame, (0.0, 0.0, 1.0)), 64)
        groups = Q._groups(tree, max(Q.LEAST, n // Q.GROUPS)).collect()
        assert Q.GROUPS // 4 <= len(groups) <= 4 * Q.GROUPS and sum(4.0 ** -r.gl for r in groups) == 1.0
