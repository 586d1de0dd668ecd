"""Operators against brute force in numpy, invariants, and generated streams with known changes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import DATASETS, DataConfig
from tidemark.functions import hypothesis as H
from tidemark.operators import drift as D
from tidemark.operators import ensemble as E
from tidemark.operators import incremental as I
from tidemark.operators import layout as L
from tidemark.operators import mixture as M
from tidemark.operators import models as C
from tidemark.operators import ordered as O
from tidemark.operators import pairs as J
from tidemark.operators import prepare as P
from tidemark.operators import views as V
from tidemark.operators import windows as W
from tidemark.session import Session
from tidemark.sources import files, synthetic
from tidemark.sources.snapshots import Snapshots
from tidemark.streaming import replay

RNG = np.random.Generator(np.random.PCG64(1))


@pytest.fixture(scope="module")
def rows(spark):
    x, label = RNG.normal(0, 1, 120).round(3), RNG.integers(0, 3, 120)
    return spark.createDataFrame([(t, float(a), f"l{k}") for t, (a, k) in enumerate(zip(x, label, strict=True))], "t long, x double, label string").cache()


def brute_window(rows, window, trained, k, raw_guard):
    near = lambda r: [j for _, j in sorted((abs(r.x - s.x), s.t) for s in trained if s.label == r.label)[:k]]
    by_t = {r.t: r for r in rows}
    total = 0.0
    for label in sorted({r.label for r in rows}):
        own = [r for r in window if r.label == label]
        used = sorted({j for r in own for j in near(r)})
        if not own or not used:
            total += len(own)
            continue
        w, t = np.array([r.x for r in own]), np.array([by_t[j].x for j in used])
        a, b, c = (np.abs(p[:, None] - q[None]) for p, q in ((w, t), (w, w), (t, t)))
        if (a.sum() if raw_guard else a.mean()) >= 1e-4:
            total += len(own) * (1 - (b.mean() + c.mean()) / (2 * a.mean()))
    return total / len(window)


@pytest.mark.parametrize("most, pairs", [(1000, 2048), (3, 4)])
def test_sliding_drift_against_brute_force(rows, most, pairs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", pairs)
    local = sorted(rows.collect())
    trained = [r for r in local if r.t < 40 and r.label != "l2"]
    found = {r.t: r.drift for r in D.sliding(rows, rows.where("t < 40 and label != 'l2'"), 15, 3, most).collect()}
    assert sorted(found) == list(range(14, 120))
    for t in found:
        assert found[t] == pytest.approx(brute_window(local, local[t - 14 : t + 1], trained, 3, True), abs=1e-9)


def test_chunk_drift_against_brute_force(rows):
    local = sorted(rows.collect())
    found = {r.chunk_id: r.drift for r in D.of_chunks(rows.withColumn("chunk_id", F.floor(F.col("t") / 25)), rows.where("t < 40"), 5).collect()}
    for k, drift in found.items():
        assert drift == pytest.approx(brute_window(local, local[k * 25 : k * 25 + 25], local[:40], 5, False), abs=1e-9)


def test_nearest_of_label_does_not_depend_on_blocks(rows):
    trained = rows.where("t < 50")
    for k in (1, 4, 100):
        whole, cut = (sorted(J.nearest_of_label(rows, trained, k, block=m).collect()) for m in (1000, 3))
        assert whole == cut and whole


def brute_axes(window, trained, k, total):
    near = lambda r: [s.t for _, s in sorted(((np.linalg.norm(np.subtract(r.v, s.v)), s.t), s) for s in trained if s.label == r.label)[:k]]
    by_t, out = {s.t: s for s in trained}, 0.0
    for label in {r.label for r in window}:
        own = [r for r in window if r.label == label]
        used = sorted({j for r in own for j in near(r)})
        if not used:
            out += len(own)
            continue
        w, t = np.array([r.v for r in own]), np.array([by_t[j].v for j in used])
        a, b, c = (np.linalg.norm(p[:, None] - q[None], axis=2) for p, q in ((w, t), (w, w), (t, t)))
        if (a.sum() if total else a.mean()) >= 1e-4:
            out += len(own) * (1 - (b.mean() + c.mean()) / (2 * a.mean()))
    return out / len(window)


@pytest.mark.parametrize("block", [2048, 6])
def test_drift_of_many_axes_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    v, label = RNG.normal(0, 1, (90, 3)).round(3), RNG.integers(0, 2, 90)
    rows = spark.createDataFrame([(t, x.tolist(), int(k)) for t, (x, k) in enumerate(zip(v, label, strict=True))], "t long, v array<double>, label int").cache()
    local, trained = sorted(rows.collect()), rows.where("t < 40")
    chunks = {r.chunk_id: r.drift for r in D.of_chunks(rows.withColumn("chunk_id", F.floor(F.col("t") / 30)), trained, 4).collect()}
    assert chunks == {k: pytest.approx(brute_axes(local[30 * k : 30 * k + 30], local[:40], 4, False)) for k in range(3)}
    windows = {r.t: r.drift for r in D.sliding(rows, trained, 12, 4).collect()}
    assert windows == {t: pytest.approx(brute_axes(local[t - 11 : t + 1], local[:40], 4, True)) for t in range(11, 90)}
    apart = lambda p, q: np.linalg.norm(v[p][:, None] - v[q][None], axis=2).mean()
    for t, drift in ((r.t, r.drift) for r in D.adjacent(rows, 9, 20).collect()):
        p, q = slice(t - 9, t), slice(t, t + 9)
        assert drift == pytest.approx(1 - (apart(p, p) + apart(q, q)) / (2 * apart(p, q)))


def test_ranked_sums_split_equal_rows(spark):
    rows = spark.range(6000).select((F.col("id") % 2).alias("g"), F.lit(1.0).alias("x"), "id").repartition(6)
    found = O.ranked(rows, ["g"], ["x"], {"r": F.lit(1)}).groupBy("g").agg(F.min("r"), F.max("r"), F.countDistinct("r")).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 3000, 3000), (1, 1, 3000, 3000)]


def test_drift_of_the_training_rows_is_nothing_and_of_none_is_all(rows):
    same = D.of_chunks(rows.withColumn("chunk_id", F.lit(1)), rows, 1).first()
    none = D.of_chunks(rows.withColumn("chunk_id", F.lit(1)), rows.limit(0), 5).first()
    assert same.drift == pytest.approx(0, abs=1e-3) and none.drift == 1.0  # equal values share a neighbour


@pytest.mark.parametrize("size", [7, 1000])
def test_blocks_do_not_change_ordered_results(spark, size):
    x = [None if t % 4 == 0 else float(t * 37 % 11) for t in range(60)]
    df = spark.createDataFrame(list(enumerate(x)), "t long, x double")
    filled, last = [], None
    for v in x:
        last = v if v is not None else last
        filled.append(last)
    assert [r.f for r in O.forward_fill(df, "x", "f", size=size).orderBy("t").collect()] == filled
    y = df.na.fill(0.0)
    values = [v or 0.0 for v in x]
    sums = O.running_sums(y, {"x": "s"}, size=size).orderBy("t").collect()
    assert [r.s for r in sums] == np.cumsum(values).tolist()
    means = O.framed(y, lambda w: [F.avg("x").over(w.rowsBetween(-2, 3)).alias("m")], 2, 3, size=size).orderBy("t").collect()
    assert [r.m for r in means] == pytest.approx([np.mean(values[max(0, t - 2) : t + 4]) for t in range(60)])


def test_nearest_with_ties_and_blocks(spark):
    v = [[0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [3.0, 0.0], [0.0, 1.0]]
    a = spark.createDataFrame(list(enumerate(v)), "i long, v array<double>")
    b = spark.createDataFrame(list(enumerate(v)), "j long, v array<double>")
    found = {(r.i, r.rank): r.j for r in J.nearest(a, b, 2, n_blocks=3, itself=False).collect()}
    assert found == {(0, 1): 1, (0, 2): 2, (1, 1): 2, (1, 2): 0, (2, 1): 1, (2, 2): 0, (3, 1): 1, (3, 2): 2, (4, 1): 0, (4, 2): 1}
    assert J.nearest(a, b.limit(0), 2).count() == 0 and J.all_distances(a, b).count() == 25


def test_overlaps_count_each_pair_once(spark):
    ends = [(k, int(s), int(s + e)) for k, (s, e) in enumerate(zip(RNG.integers(0, 100, 40), RNG.integers(0, 30, 40), strict=True))]
    df = spark.createDataFrame([(k, "a", s, e) for k, s, e in ends], "k long, label string, s long, e long")
    found = sorted((r.k, r.k2) for r in J.overlaps(df, df, 9).collect())
    assert found == sorted((a, b) for a, s, e in ends for b, s2, e2 in ends if s <= e2 and s2 <= e)


def test_min_max_and_z_scores_of_a_constant(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.x for r in P.min_max(df, "x", "x").collect()] == [0.0, 0.0] and [r.x for r in P.z_scores(df, ["x"]).collect()] == [0.0, 0.0]


def test_brush_snaps_to_all(spark):
    df = spark.range(100).withColumnRenamed("id", "t")
    assert P.brush(df, 0.0, 0.99).count() == 100 and P.brush(df, 0.25, 0.5).count() == 25


def test_kmeans_against_numpy(spark):
    xy = RNG.normal(0, 1, (60, 2))
    df = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(xy)], "t long, x double, y double")
    now = np.arange(60) * 4 // 60
    for _ in range(3):
        labels = sorted(set(now))
        centres = np.array([xy[now == k].mean(axis=0) for k in labels])
        now = np.array(labels)[((xy[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    assert [r.cluster for r in L.kmeans(df, 4, 3).orderBy("t").collect()] == now.tolist()


def test_layout_separates_groups_and_repulsion_excludes_itself(spark):
    v = np.concatenate([RNG.normal(0, 0.3, (30, 5)), RNG.normal(4, 0.3, (30, 5))])
    found = L.fitted(spark.createDataFrame([(t, x.tolist()) for t, x in enumerate(v)], "t long, v array<double>"), 10.0, 250).orderBy("t").toPandas()[["x", "y"]].to_numpy()
    within = np.linalg.norm(found[:30] - found[:30].mean(axis=0), axis=1).max()
    assert np.linalg.norm(found[:30].mean(axis=0) - found[30:].mean(axis=0)) > 1.5 * within
    pair = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "t long, x double, y double")
    assert sorted((r.i, r.q, r.fx, r.fy) for r in L.repulsion(pair).collect()) == [(0, 0.5, -0.25, 0.0), (1, 0.5, 0.25, 0.0)]


def test_depths_of_a_long_chain(spark):
    made = [(k, k - 1 if k else None) for k in range(1000)] + [(5000, None)]
    found = {r.no: (r.root, r.depth) for r in V.depths(spark.createDataFrame(made, "no long, parent long")).collect()}
    assert found == {**{k: (0, k) for k in range(1000)}, 5000: (5000, 0)}


# Mixtures


def test_fit_finds_components_and_bic_their_number():
    x = np.concatenate([RNG.normal(-4, 1, (200, 2)), RNG.normal(4, 1, (300, 2))])
    comps = I.best_by_bic(x, 4)
    assert len(comps) == 2
    assert sorted(round(float(c.mu[0])) for c in comps) == [-4, 4] and sum(c.weight for c in comps) == pytest.approx(500)


def test_component_algebra():
    x = RNG.normal(0, 1, (50, 3))
    whole = lambda r: I.Part.of(r.mean(axis=0), np.cov(r.T, bias=True), len(r), 50)
    a, b, both = whole(x[:20]), whole(x[20:]), whole(x)
    m = I.merged(a, b)
    assert np.allclose(m.mu, both.mu) and np.allclose(m.s, both.s)
    back = I.merged(m, b, -1)
    assert np.allclose(back.mu, a.mu) and np.allclose(back.s, a.s)
    one = I.updated(whole(x[:49]), x[49], 1.0)
    assert np.allclose(one.mu, both.mu) and np.allclose(one.s, both.s)
    far = I.shifted(a, x[30], 3.0)
    assert np.allclose(far.mu, a.mu + (x[30] - a.mu) * 3 / 20) and np.allclose(far.s, a.s)
    assert I.kl(a, a) == pytest.approx(0) and I.kl(a, b) > 0 and I.symmetric_kl(a, b) == pytest.approx(I.symmetric_kl(b, a)) and I.mean_distance(a, a) == pytest.approx(0, abs=1e-6)
    assert I.to_nearest_model([a, b], [b]) == pytest.approx(0.4 * I.mean_distance(a, b), abs=1e-6)


def test_transport_moves_shares_at_the_least_cost():
    assert I.transport(np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([0.5, 0.5]), np.array([0.5, 0.5])) == pytest.approx(0)
    assert I.transport(np.array([[1.0, 3.0], [2.0, 1.0]]), np.array([0.7, 0.3]), np.array([0.2, 0.8])) == pytest.approx(0.2 + 1.5 + 0.3)
    line, a, b = np.arange(6.0), RNG.random(6), RNG.random(6)
    moved = np.abs(np.cumsum(a / a.sum() - b / b.sum()))[:-1].sum()  # on a line, what crosses each gap
    assert I.transport(np.abs(line[:, None] - line[None]), a, b) == pytest.approx(moved)


def test_mixtures_of_many_components_lose_no_row(spark, monkeypatch):
    made = [(k, 5.0, [float(k), 0.0], [1.0, 0.0, 0.0, 1.0], 0.0, 0.0) for k in range(10_001)]
    comps = spark.createDataFrame(made, "label int, n double, mu array<double>, s array<double>, log_det double, log_weight double")
    points = spark.createDataFrame([(t, [t * 2000.2, 0.0]) for t in range(6)], "t long, v array<double>")
    expected = [(t, min(10_000, round(t * 2000.2))) for t in range(6)]
    assert [(r.t, r.component) for r in M.assign(points, comps).orderBy("t").collect()] == expected
    monkeypatch.setattr(M, "HELD_BYTES", 400_000)
    assert [(r.t, r.component) for r in M.assign(points, comps).orderBy("t").collect()] == expected


def test_moments_and_scores_against_numpy(spark):
    x, label = RNG.normal(0, 1, (90, 5)) @ RNG.normal(0, 1, (5, 5)), RNG.integers(0, 3, 90)
    points = spark.createDataFrame([(t, v.tolist(), int(k)) for t, (v, k) in enumerate(zip(x, label, strict=True))], "t long, v array<double>, label int").repartition(4)
    found = {r.label: r for r in M.components(points).collect()}
    density = {}
    for k in range(3):
        own = x[label == k]
        assert np.allclose(found[k].mu, own.mean(axis=0)) and np.allclose(np.reshape(found[k].s, (5, 5)), np.cov(own.T)) and found[k].log_det == pytest.approx(np.linalg.slogdet(np.cov(own.T))[1])
        away = x - own.mean(axis=0)
        density[k] = -(np.einsum("ni,ij,nj->n", away, np.linalg.inv(np.cov(own.T)), away) + found[k].log_det + 5 * np.log(2 * np.pi)) / 2 + np.log(len(own) / 90)
    logs = np.stack([density[k] for k in range(3)], axis=1)
    shares = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    made = {(r.t, r.label): r.value for r in M.all_scores(points, M.components(points), value="posterior").collect()}
    assert all(made[t, k] == pytest.approx(shares[t, k]) for t in range(90) for k in range(3))


def test_fits_over_all_rows_find_components_of_many_axes(spark):
    x = np.concatenate([RNG.normal(-4, 1, (150, 4)), RNG.normal(4, 1, (250, 4))])
    points = spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "t long, v array<double>").repartition(3).cache()
    best = M.best_by_bic(points, 3)
    assert len(best.parts.keys) == 2 and sorted(np.round(np.exp(best.parts.log_weight), 3)) == pytest.approx([0.375, 0.625], abs=0.01)
    first, total = I.fit(x, 1)
    assert M.fit(points, [M._start(x, 1, 1e-6)])[0].total == pytest.approx(total, rel=1e-6)
    parts, placed = M.built(points, 3)
    assert placed.count() == 400 and placed.groupBy("component").count().count() == len(parts.keys) == 2


def test_follower_marks_what_is_far_and_grows():
    x = RNG.normal(0, 1, (200, 2))
    follower = I.Follower(I.best_by_bic(x, 2), x, trigger=30)
    assert not follower.add(np.zeros(2))[1] and follower.add(np.array([30.0, 30.0]))[1]
    before = len(follower.comps)
    for r in RNG.normal(20, 1, (60, 2)):
        follower.add(r)
    assert len(follower.comps) > before and len(follower.limits) == len(follower.comps)


def test_tails_and_tests_have_known_values():
    assert H.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and H.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05) and H.chi2_tail(0.5, 4) == pytest.approx(0.9735009788392561)
    assert H.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05) and H.f_tail(0, 2, 5) == 1.0
    u = np.linspace(2.0, 4000.0, 4_000_001)
    density = u**0.5 / (1 + 3 * u / 20) ** 11.5
    below = np.linspace(1e-9, 2.0, 400_001)
    rest = below**0.5 / (1 + 3 * below / 20) ** 11.5
    area = lambda y, x: ((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()
    assert H.f_tail(2.0, 3, 20) == pytest.approx(area(density, u) / (area(density, u) + area(rest, below)), rel=1e-4)
    x = RNG.normal(0, 1, (400, 3))
    mu, s = x.mean(axis=0), np.cov(x.T)
    assert H.mean_test(400, mu, s, np.zeros(3))[1] > 0.001 and H.mean_test(400, mu, s, np.full(3, 0.5))[1] < 1e-6
    assert H.covariance_test(400, s, np.eye(3))[1] > 1e-4 and H.covariance_test(400, s, 3 * np.eye(3))[1] < 1e-6


def test_polygons_share_what_they_should(spark):
    square, turned = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(1.0, -1.0), (3.0, 1.0), (1.0, 3.0), (-1.0, 1.0)]
    assert V.cut_area(square, turned) == pytest.approx(4.0) and V.cut_area(turned, square[::-1]) == pytest.approx(4.0) and V.cut_area(square, [(x + 5, y) for x, y in square]) == 0
    assert V.cut_area(square, [(1.0, 1.0), (4.0, 1.0), (1.0, 4.0)]) == pytest.approx(1.0)
    made = [(k, [{"x": x + 1.5 * k, "y": y} for x, y in square]) for k in range(4)]
    df = spark.createDataFrame(made, "i long, corners array<struct<x:double,y:double>>")
    assert sorted((r.i, r.j, round(r.area, 6)) for r in V.intersections(df, 0.7).collect()) == [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]


def test_mixtures_of_windows_cost_most_where_the_stream_changes(spark):
    x = np.concatenate([RNG.normal(0, 1, (300, 2)), RNG.normal(8, 1, (300, 2))])
    found = {r.start: r.drift for r in W.mixture_drift(spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "t long, v array<double>"), 100, 50, 2).collect()}
    assert sorted(found) == list(range(0, 501, 50)) and sorted(found, key=found.get)[-2:] in ([250, 300], [300, 250])


# Sources, sinks, streams, sessions


def test_generated_streams_change_where_they_should(spark):
    x = synthetic.synthetic(spark).orderBy("t").toPandas()
    assert len(x) == 2500 and abs(x.x1[:500].mean() + 2) < 0.2 and abs(x.x1[1000:1500].mean()) < 0.2 and abs(x.x2[1500:2000].mean() - 4) < 0.2
    late = x[2000:]
    assert ((late.x1**2 - late.x2 > 0) == late.y).all()
    assert (late.y_2 == np.where(np.abs(late.x1) > 2, 2, late.y)).all() and np.allclose(late.y_val, np.sin(late.x1**2) + np.cos(late.x2**2))
    early = x[:2000]
    assert set(x.y_2) == {0, 1, 2} and 0.08 < (early.y_val - np.sin(early.x1**2) - np.cos(early.x2**2)).std() < 0.12
    assert [synthetic.case1(spark).count(), synthetic.case2(spark).count(), synthetic.case3(spark).count()] == [5600, 2500, 3000]
    assert synthetic.case3(spark).where("t = 1").first().timestamp == "2018-01-01 02:00:00"


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.5, "a"), (1, None, "b")], "t long, x double, label string")
    files.write_csv(df.coalesce(1), f"{tmp_path}/csv")
    assert files.scan_csv(spark, f"{tmp_path}/csv", "t long, x double, label string").orderBy("t").collect() == df.collect()
    files.write_json(df, f"{tmp_path}/json")
    assert spark.read.schema(df.schema).json(f"{tmp_path}/json").count() == 2
    np.savez(f"{tmp_path}/m.npz", indptr=np.array([0, 2, 2, 3]), indices=np.array([0, 2, 1]), data=np.array([1.0, 2.0, 3.0]))
    assert sorted(tuple(r) for r in files.scan_npz(spark, f"{tmp_path}/m.npz").collect()) == [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)]
    (tmp_path / "terms.txt").write_text(json.dumps(["x", "y"]))
    assert [tuple(r) for r in files.scan_terms(spark, f"{tmp_path}/terms.txt").collect()] == [(0, "x"), (1, "y")]
    np.save(f"{tmp_path}/flags.npy", np.array([[True, False], [False, False]]))
    assert files.scan_flags(spark, f"{tmp_path}/flags.npy").where("is_train").collect() == [(0, 0, True)]
    made = spark.range(1).select(files.svg(["<a>", "-", "</a>"], F.lit('<p data-content="x">'), F.lit(5)).alias("s")).first().s
    assert made == "<a>5-<p></a>"


def test_snapshots_round_trip_and_refuse_paths(spark, tmp_path):
    snapshots = Snapshots(spark, f"file://{tmp_path}")
    name = snapshots.save({"a": spark.range(3), "b": spark.range(2)})
    assert {k: v.count() for k, v in snapshots.load(name).items()} == {"a": 3, "b": 2}
    with pytest.raises(ValueError):
        snapshots.load("../x")


def test_config_bounds_end_with_the_data():
    config = DataConfig(("x",), "y", 10, (5, (1, 1), 100))
    assert config.bounds(20) == [(0, 10), (10, 15), (15, 17), (17, 20)] and config.bounds(10) == [(0, 10)] and set(DATASETS) == {"synthetic", "weather", "paper"}


def test_known_datasets_have_their_batches():
    weather, paper = DATASETS["weather"], DATASETS["paper"]
    assert [b - a for a, b in weather.bounds(3000)][:4] == [90, 15, 15, 23] and all(b - a == 1 for a, b in weather.mini_bounds(3000)[1])
    assert [b - a for a, b in paper.bounds(10_000)] == [754, 835, 1110, 1542, 2257, 1428] and [b - a for a, b in paper.mini_bounds(10_000)[1]] == [207, 207, 204, 217]


def test_replay_gives_batches_in_order_and_goes_on(spark, tmp_path):
    rows = spark.range(30).withColumnRenamed("id", "t").withColumn("x", F.col("t") * 1.0)
    got = []
    take = lambda df, _: got.append([r.t for r in df.orderBy("t").collect()])
    replay.write_batches(rows, f"{tmp_path}/b", [(0, 10), (10, 20)])
    replay.replay(replay.read_batches(spark, f"{tmp_path}/b", rows.schema), f"{tmp_path}/c", take)
    replay.write_batches(rows, f"{tmp_path}/b", [(20, 30)])
    replay.replay(replay.read_batches(spark, f"{tmp_path}/b", rows.schema), f"{tmp_path}/c", take)
    assert got == [list(range(10)), list(range(10, 20)), list(range(20, 30))]


def test_followed_stream_equals_the_batch_result(spark, tmp_path):
    x = np.concatenate([RNG.normal(0, 1, (80, 2)), RNG.normal(3, 1, (40, 2))])
    rows = spark.createDataFrame([("s", t, float(a), float(b)) for t, (a, b) in enumerate(x)], "stream_id string, t long, x1 double, x2 double")
    replay.write_batches(rows, f"{tmp_path}/b", [(0, 30), (30, 90), (90, 120)])
    found = replay.follow_mixture(replay.read_batches(spark, f"{tmp_path}/b", rows.schema), ["x1", "x2"], 60)
    query = found.writeStream.format("memory").queryName("followed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    follower = I.Follower(I.best_by_bic(x[:60]), x[:60])
    expected = [follower.add(r) for r in x[60:]]
    late = spark.table("followed").where("t >= 60").orderBy("t").collect()
    assert [(r.component, r.uncertain) for r in late] == expected and spark.table("followed").count() == 120


def test_fold_models_agree_with_plain_newton_and_learn_three_classes(spark):
    x = np.concatenate([RNG.normal(m, 1, (60, 2)) for m in ((0, 0), (4, 0), (0, 4))])
    label = np.repeat(["a", "b", "c"], 60)
    rows = spark.createDataFrame([(t, v.tolist(), str(k)) for t, (v, k) in enumerate(zip(x, label, strict=True))], "t long, f array<double>, label string").repartition(3)
    rows = rows.withColumn("train", C.fold_flags(F.col("t"), 4, 0.7)).cache()
    made = C.fit(rows, ["a", "b", "c"])
    flags = {r.t: list(r.train) for r in rows.collect()}
    expected = {r.t: [r2.is_train for r2 in sorted(P.fold_flags(rows.where(F.col("t") == r.t), 4, 0.7).collect())] for r in rows.where("t < 3").collect()}
    assert all(flags[t] == e for t, e in expected.items())
    found = C.predict(rows, made, None, "train").collect()
    assert {(r.t, r.fold) for r in found} == {(t, k) for t, own in flags.items() for k in range(4) if not own[k]}
    best = {}
    for r in found:
        best[r.t, r.fold] = max(best.get((r.t, r.fold), (0.0, "")), (r.proba, r["class"]))
    assert np.mean([best[k][1] == label[k[0]] for k in best]) > 0.93
    # Fold 0 once more by gradient descent on the same objective.
    own = np.array([flags[t][0] for t in range(180)])
    xs, y = made.inputs(x[own]), np.searchsorted(["a", "b", "c"], label[own])
    w = (len(y) / np.bincount(y) / 3)[y]
    weights = np.zeros((3, 3))
    for _ in range(20_000):
        p = np.exp(xs @ weights.T)
        p /= p.sum(axis=1, keepdims=True)
        gap = p * w[:, None]
        gap[np.arange(len(y)), y] -= w
        weights -= 0.01 * (gap.T @ xs + np.array([1, 1, 1e-4]) * weights)
    p = np.exp(xs @ weights.T)
    assert made.probabilities(xs, 0) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=2e-3)
    one = C.fit(rows.where("label = 'b'"), ["a", "b", "c"])
    assert (one.probabilities(xs, 0) == [0, 1, 0]).all()
    chosen = C.fit_by_validation(rows, ["a", "b", "c"])
    assert len(chosen.seen) == 4 and np.mean(chosen.probabilities(xs, 0).argmax(axis=1) == y) > 0.93


def test_radial_features_tell_a_ring_from_its_middle(spark):
    angle, near = RNG.uniform(0, 2 * np.pi, 200), RNG.normal(0, 0.4, (200, 2))
    x = np.concatenate([np.stack([3 * np.cos(angle), 3 * np.sin(angle)], axis=1), near])
    rows = spark.createDataFrame([(t, v.tolist(), "ring" if t < 200 else "middle") for t, v in enumerate(x)], "t long, f array<double>, label string").withColumn("train", F.array(F.lit(True)))
    made = C.fit(rows, ["middle", "ring"], gamma=0.5)
    assert (made.probabilities(made.inputs(x), 0).argmax(axis=1) == np.repeat([1, 0], 200)).mean() > 0.98


def test_proportions_and_best_class(spark):
    sets = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [5])], "class string, idx array<long>")
    found = {r["class"]: r.proportion for r in E.proportions(sets, spark.createDataFrame([(1,), (2,), (2,)], "t long")).collect()}
    assert found == {"a": 0.5, "b": 0.0}


def test_cells_and_their_repulsion_come_near_the_exact_one(spark):
    xy = RNG.normal(0, 3, (300, 2))
    at = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(xy)], "t long, x double, y double")
    found = L.cells(at, 3).collect()
    assert all(sum(r.n for r in found if r.level == k) == 300 for k in range(4))
    exact, near = ({r.i: np.array([r.q, r.fx, r.fy]) for r in df.collect()} for df in (L.repulsion(at), L.repulsion_by_cells(at, 8, 0.2)))
    assert all(np.allclose(exact[t], near[t], rtol=0.02, atol=0.05) for t in exact)


def test_layout_in_rounds_follows_the_plain_gradient(spark):
    v = RNG.normal(0, 1, (24, 3))
    points = spark.createDataFrame([(t, x.tolist()) for t, x in enumerate(v)], "t long, v array<double>")
    found = np.array([[r.x, r.y] for r in L.fitted_in_rounds(points, 7.0, 4).orderBy("t").collect()])
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    order = np.argsort(np.where(np.eye(24) > 0, np.inf, d), axis=1)[:, :21]
    p = np.zeros((24, 24))
    near = {(r.i): r.beta for r in L.bandwidths(spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(24) for j in order[i]], "i long, j long, d double"), 7.0).collect()}
    for i in range(24):
        w = np.exp(-near[i] * d[i, order[i]])
        p[i, order[i]] = w / w.sum()
    p = (p + p.T) / (p + p.T).sum()
    y = L.principal(v)
    y = y / y[:, 0].std() * 1e-4
    step, gains = np.zeros_like(y), np.ones_like(y)
    for k in range(4):
        way = y[:, None] - y[None]
        q = 1 / (1 + (way**2).sum(axis=2))
        np.fill_diagonal(q, 0)
        g = (((12.0 if k < 1 else 1.0) * p - q / q.sum()) * q)[..., None] * way
        g = g.sum(axis=1)
        gains = np.maximum(np.where(step * g < 0, gains + 0.2, gains * 0.8), 0.01)
        step = (0.5 if k < 1 else 0.8) * step - 50.0 * gains * 4 * g
        y = np.floor((y + step) * 1e9) * 1e-9
    assert np.allclose(found, y, atol=1e-7)


def test_continued_layout_holds_old_rows_and_places_new_ones(spark, monkeypatch):
    monkeypatch.setattr(L, "ACTIVE", 60)
    v = np.concatenate([RNG.normal(0, 0.3, (40, 4)), RNG.normal(5, 0.3, (40, 4)), RNG.normal(5, 0.3, (10, 4))])
    points = spark.createDataFrame([(t, x.tolist(), int(x[0] > 2)) for t, x in enumerate(v)], "t long, v array<double>, label int").cache()
    placed = L.fitted(points.where("t < 80").select("t", "v"), 10.0, 150).cache()
    found = {r.t: (r.x, r.y) for r in L.continued(points, placed, 10.0, 100).collect()}
    old = {r.t: (r.x, r.y) for r in placed.collect()}
    assert sorted(found) == list(range(90)) and all(found[t] == old[t] for t in range(20))
    middle = lambda ts: np.mean([found[t] for t in ts], axis=0)
    assert np.linalg.norm(middle(range(80, 90)) - middle(range(40, 80))) < np.linalg.norm(middle(range(80, 90)) - middle(range(20, 40)))
    axes = L.main_axes(spark.createDataFrame([(t, float(a), float(b), 0.0) for t, (a, b) in enumerate(v[:, :2])], "t long, x double, y double, `z,1` double"), ["x", "y", "z,1"]).orderBy("t").collect()
    expected = L.principal(v[:, :2])
    assert np.allclose([[r.x, r.y] for r in axes], expected)


def test_session_end_to_end(spark, tmp_path):
    rows = synthetic.generate(spark, [synthetic.Part(60, [(1.0, (0, 0), [[1, 0], [0, 1]])]), synthetic.Part(60, [(1.0, (5, 5), [[1, 0], [0, 1]])])], lambda x, e: x[0] > x[1]).withColumnRenamed("y", "label_")
    config = DataConfig(("x1", "x2"), "label_", 60, (60, 60), window=20)
    session = Session(spark, rows, config)
    first = session.add_model(session.rows.select("t"))
    assert session.add_model(session.rows.select("t")) == first and session.advance() and not session.advance()
    table = {r.chunk_id: r for r in session.chunk_table().collect()}
    assert table[1].drift == pytest.approx(0, abs=1e-9) and table[2].drift > 0.5 and table[2].n == 60
    assert session.squares().agg(F.sum(F.when(F.col("kind") != "FN", F.col("n")))).first()[0] == 120
    assert session.chunk_summary(session.rows.select("t")).agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert 0 <= session.accuracy([30]).first().acc <= 1 and session.model_table().first().use
    snapshots = Snapshots(spark, f"file://{tmp_path}")
    other = Session(spark, rows, config)
    other.load(snapshots, session.save(snapshots))
    assert (other.at, other.used) == (1, {first})
    again = Session(spark, rows, config, (snapshots, session.save(snapshots)))
    assert again.arrived == 120 and again.parts.keys() == session.parts.keys() and again.used == {first}
    for restored in (other, again):  # the same weights, without a fit
        assert (restored.models[first]["model"].weights == session.models[first]["model"].weights).all()
        assert sorted(restored.predict().collect()) == sorted(session.predict().collect())
    session.set_active({first: False})
    assert session.trained_idx().count() == 0


def test_session_of_three_classes_with_lags_and_user_operations(spark):
    x = np.concatenate([RNG.normal(m, 1, (80, 3)) for m in ((0, 0, 0), (6, 0, 0), (0, 6, 0))])
    order = RNG.permutation(240)
    made = [(t, *map(float, x[k]), f"c{k // 80}") for t, k in enumerate(order)]
    rows = spark.createDataFrame(made, "t long, a double, b double, c double, label string")
    config = DataConfig(("a", "b", "c"), "label", 150, ((1, 1, 1), (40, 20), 100), window=20, folds=5, gmm_threshold=20, test_size=60, z_scores=True, lags=1, names={"a": "first,axis"})
    session = Session(spark, rows, config)
    assert session.attributes == ["first,axis", "b", "c"] and len(session.all.first().f) == 6
    whole = session.all.where("t < 150").select("t", "label")
    number = session.add_model(whole.select("t"))
    predicted = session.predict().groupBy("t").agg(F.max(F.struct("proba", "class"))["class"].alias("p")).join(session.rows.select("t", "label"), "t")
    assert predicted.agg(F.avg((F.col("p") == F.col("label")).cast("double"))).first()[0] > 0.9 and predicted.select("p").distinct().count() == 3
    assert session.adapt() and not session.adapt() and session.stored == [None, [number]]
    other = session.add_model(session.all.where("t < 60").select("t"))
    session.use_only([other])
    assert session.adapt() and session.stored == [[number], [other]]
    both = session.compared_squares().collect()
    assert {r.which for r in both} == {"previous", "current"} and all(0 <= r.acc <= 1 for r in both)
    accuracies, median, _ = session.evaluate()
    assert accuracies.count() == 5 and median.count() == 1
    while session.advance():
        pass
    assert session.arrived == 240 and sum(c.weight for c in session.parts.values()) > 200
    idx = session.rows.where("t < 30").select("t")
    major = session.merge_component(idx)
    assert {r.label for r in session.labels().join(idx, "t").collect()} == {major} and set(session.limits) == set(session.parts)
    key = session.regroup(session.rows.where("label = 'c1'").select("t"))
    assert key in session.parts and session.labels().count() == 240
    before = set(session.parts)
    taken = session.adjust_component(session.rows.where("label = 'c2'").select("t"))
    assert set(taken.values()) <= before and session.labels().count() == 240 and set(session.limits) == set(session.parts)
    if len(session.parts) > 1:
        gone = min(session.parts)
        session.delete_component(gone)
        assert gone not in session.parts and session.labels().where(F.col("label") == gone).count() == 0
    drift = session.drift(sliding=False)
    assert {r.attribute for r in drift.select("attribute").distinct().collect()} == {"first,axis", "b", "c", "all", "ED"}
    assert session.series(["b"], origin=True).count() == 240
    first = session.layout()
    assert first.count() == 240 and session.layout(["b"]).count() == 240 and len(session.layout_trace().first().x) == 2 and session.trace == []
    session.close()


def test_moves_composed_by_tasks_are_those_one_after_another(spark):
    """20 000 rows, of which none may be left out: each changes the means."""
    rng = np.random.default_rng(3)
    parts = {k: I.Part.of(rng.standard_normal(2), np.eye(2), 500.0 + k, 1000.0) for k in (2, 5)}
    x, g = rng.standard_normal((20_000, 2)), I.gaussians([parts[2], parts[5]])
    rows = spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "order long, v array<double>").repartition(7)
    found = I.moved(parts, rows, g.posterior)
    expected = dict(parts)
    for v, p in zip(x, g.posterior(x), strict=True):
        expected = {k: I.shifted(c, v, float(q)) for (k, c), q in zip(expected.items(), p, strict=True)}
    for k, c in expected.items():
        assert np.allclose(found[k].mu, c.mu) and np.allclose(found[k].s, c.s) and found[k].weight == c.weight
    assert I.moved(parts, rows.limit(0), g.posterior)[2].mu.tolist() == pytest.approx(parts[2].mu.tolist())
