"""Operators that go in rounds of jobs: quantiles by narrowing brackets, rings of contours, matched labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contours, kernel, quantiles
from tidemark.operators import mixture as M
from tidemark.operators import models as C


def test_quantiles_by_brackets_are_those_of_sorted_lists(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.standard_normal(3000)] + [("b", float(x)) for x in rng.integers(0, 4, 2000)] + [("c", 7.0)] * 900 + [("d", 1e300), ("d", -1e-300), (None, 2.0), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    found = {(r.k, r.share): r.quantile for r in quantiles.exact_quantiles(df, "k", "v", shares, most=20, bins=8).collect()}
    for k in ("a", "b", "c", "d", None):
        own = np.array([v for c, v in rows if c == k and v is not None and v == v])
        for s in shares:
            assert found[k, s] == pytest.approx(np.quantile(own, s), rel=1e-12, abs=1e-15)
    assert len(found) == 30
    whole = {(r.k, r.share): r.quantile for r in quantiles.exact_quantiles(df, "k", "v", shares).collect()}
    assert whole == {k: pytest.approx(v, rel=1e-12, abs=1e-15) for k, v in found.items()}
    assert quantiles.exact_quantiles(df.limit(0), "k", "v", shares).count() == 0


def test_rings_close_turn_and_hold_holes(spark):
    """A block of high cells with a low one in the middle, and one apart: three rings, the hole's area negative."""
    cells = [(x, y, 4.0) for x in range(5) for y in range(5) if (x, y) != (2, 2)] + [(2, 2, 0.0), (10, 10, 4.0)]
    found = contours.rings(contours.pieces(spark.createDataFrame(cells, "gx int, gy int, density double"), [2.0, 9.0])).collect()
    assert sorted(round(r.area, 6) for r in found) == [-0.5, 0.5, 24.5] and {r.level for r in found} == {2.0}
    for r in found:
        x, y = np.array([c.x for c in r.corners]), np.array([c.y for c in r.corners])
        assert (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2 == pytest.approx(r.area)
        assert (np.hypot(x - np.roll(x, -1), y - np.roll(y, -1)) < 1.5).all() and len(r.corners) == r.n


def test_labels_are_matched_by_the_most_rows_first(spark):
    counts = [(0, 10, 50), (0, 11, 40), (1, 10, 45), (1, 12, 3), (2, 12, 3), (3, 13, 1), (None, 10, 99), (4, None, 9)]
    df = spark.createDataFrame(counts, "old int, new int, n long")
    assert sorted((r.old, r.new) for r in M.matched(df).collect()) == [(0, 10), (1, 12), (3, 13)]
    rng = np.random.default_rng(2)
    rows = [(int(o), int(w), int(rng.integers(1, 4))) for o in range(8) for w in range(9) if rng.random() < 0.6]
    left, plain = sorted(rows, key=lambda r: (-r[2], r[0], r[1])), []
    while left:
        o, w, _ = left[0]
        plain.append((o, w))
        left = [r for r in left if r[0] != o and r[1] != w]
    assert sorted((r.old, r.new) for r in M.matched(spark.createDataFrame(rows, "old int, new int, n long")).collect()) == sorted(plain)
    assert M.matched(df.limit(0)).count() == 0
    assert df.select(F.count("old")).first()[0] == 7


def test_kernel_machines_meet_the_conditions_of_the_best_one(spark):
    """A disc within a ring: each decision is the sum of kernels at the rows that fall short, by how much; and held-out rows are told apart."""
    rng = np.random.default_rng(3)
    angle, far = rng.uniform(0, 2 * np.pi, 200), np.where(np.arange(200) % 4 == 0, rng.uniform(0, 1, 200), rng.uniform(1.6, 2.6, 200))
    x, label = np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1), np.where(far < 1.3, "in", "out")
    rows = spark.createDataFrame([(t, v.tolist(), str(c)) for t, (v, c) in enumerate(zip(x, label, strict=True))], "t long, f array<double>, label string").repartition(3)
    rows = rows.withColumn("train", C.fold_flags(F.col("t"), 3, 0.7)).cache()
    made = kernel.fit(rows, ["in", "out", "never"], cost=2.0, gamma=0.7)
    flags = {r.t: list(r.train) for r in rows.collect()}
    own = np.array([flags[t][1] for t in range(200)])
    f, sign = made.decisions(made.inputs(x), 1)[:, 0], np.where(label == "in", 1.0, -1.0)
    weight = own.sum() / 2 / np.where(label == "in", own[label == "in"].sum(), own[label == "out"].sum())
    alpha = np.where(own, 2 * 2.0 * weight * sign * np.maximum(1 - sign * f, 0), 0.0)
    z = (x - made.mean) / made.scale
    k = np.exp(-0.7 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert np.abs(k @ alpha + made.weights[1, 0, -1] - f).max() < 1e-4 and 0 < (alpha != 0).sum() < own.sum()
    held = C.predict(rows, made, None, "train").collect()
    by = {}
    for r in held:
        by.setdefault((r.t, r.fold), {})[r["class"]] = r.proba
    assert all(abs(sum(p.values()) - 1) < 1e-9 and p["never"] == 0 for p in by.values())
    assert np.mean([max(p, key=p.get) == label[t] for (t, _), p in by.items()]) > 0.95
    sure = [p["in"] for (t, _), p in by.items()]
    truth = [label[t] == "in" for t, _ in by]
    assert abs(np.mean(sure) - np.mean(truth)) < 0.05  # calibrated on the whole


def test_kernel_machines_of_one_class_and_of_few_landmarks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(3, 1, (150, 3))])
    rows = spark.createDataFrame([(t, v.tolist(), "a" if t < 150 else "b") for t, v in enumerate(x)], "t long, f array<double>, label string").withColumn("train", F.array(F.col("t") < 140, F.col("t") % 2 == 0))
    made = kernel.fit(rows, ["a", "b"], landmarks=40)
    one = C.predict(rows, made, 0).where("class = 'a'").agg(F.min("proba")).first()[0]
    assert one == 1.0
    right = C.predict(rows, made, None, "train").where("fold = 1").groupBy("t").agg(F.max(F.struct("proba", "class"))["class"].alias("p"))
    assert right.where((F.col("t") < 150) == (F.col("p") == "a")).count() > 0.95 * 150
    with pytest.raises(ValueError, match="rows"):
        kernel.fit(rows.limit(0), ["a"])
