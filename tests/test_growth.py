"""Steps whose memory, moved bytes or time must grow no faster than their rows."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental as I
from tidemark.operators import windows as W
from tidemark.plans import drift as plan
from tidemark.streaming import replay, sliding


def test_follower_changes_its_sums_without_inverting_matrices(monkeypatch):
    """Row by row the same as scoring by ``Gaussians`` and changing each part on its own."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 1, (150, 2)) for m in (0, 6, 0, 25)])
    follower = I.Follower(I.best_by_bic(x[:100], 3), x[:100], trigger=10**6)
    parts, limits, expected = follower.comps, follower.limits, []
    for r in x[100:]:
        g = I.gaussians(parts)
        scores = g.score(r[None], True)[0]
        k = int(scores.argmin())
        expected.append((k, bool(scores[k] >= limits[k][0])))
        if scores[k] < min(limits[k]):
            parts = [I.updated(c, r, p) for c, p in zip(parts, g.posterior(r[None])[0], strict=True)]
    monkeypatch.setattr(np.linalg, "pinv", lambda *_: pytest.fail("a row inverts the matrices of all parts"))
    assert [follower.add(r) for r in x[100:]] == expected
    assert all(a.first == pytest.approx(b.first) and a.second == pytest.approx(b.second) and a.rows == b.rows for a, b in zip(follower.comps, parts, strict=True))


def test_followed_labels_have_a_task_each_and_any_batches(spark):
    rng = np.random.default_rng(6)
    made = [(["a", "b", None, "d"][t % 4] if t < 400 else "short", t, rng.normal(t % 4, 1, 2).tolist()) for t in range(405)]
    table = spark.createDataFrame(made, "label string, t long, v array<double>").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = I.followed(table, 60, 3).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(found) == 405 and len({r.label for r in found}) == len({r.task for r in found}) == 5
    for label in ("a", None, "short"):
        x = np.array([v for c, _, v in made if c == label])
        first = I.best_by_bic(x[:60], 3)
        follower = I.Follower(first, x[:60])
        expected = [(int(k), False) for k in I.gaussians(first).score(x[:60], True).argmin(axis=1)] + [follower.add(r) for r in x[60:]]
        assert [(r.component, r.uncertain) for r in sorted((r for r in found if r.label == label), key=lambda r: r.t)] == expected


def test_followed_rows_are_flat_arrays_in_order():
    near = [{"j": 3, "v": np.array([1.0, 2.0])}, {"j": 5, "v": np.array([3.0, 4.0])}]
    made = [(9, None, None), (9, np.array([0.5, 1.5]), near[:1]), (2, np.array([7.0, 8.0]), near), (4, np.array([1.0, 1.0]), []), (6, None, None)]
    frames = [pd.DataFrame({"t": [r[0] for r in some], "v": [r[1] for r in some], "near": [r[2] for r in some]}) for some in (made[:2], made[2:])]
    packed = sliding.Packed(iter(frames))
    assert all(isinstance(x, np.ndarray) and x.dtype != object for x in vars(packed).values())
    assert list(packed.in_order()) == [(2, [7.0, 8.0], [[3, [1.0, 2.0]], [5, [3.0, 4.0]]]), (4, [1.0, 1.0], []), (6, None, None), (9, [0.5, 1.5], [[3, [1.0, 2.0]]]), (9, None, None)]
    assert list(sliding.Packed(iter([])).in_order()) == []


def test_a_longer_stream_has_more_batches_and_the_same_drift(spark, monkeypatch):
    """With a restart halfway and stretches put out in small frames."""
    found, sf = {}, "/root/testdata/sf0.001"
    for size in (1 << 20, 100):
        batches = []
        write = replay.write_batches
        monkeypatch.setattr(plan, "BATCH", size)
        with monkeypatch.context() as m:
            m.setattr(replay, "write_batches", lambda rows, folder, bounds, *a: (batches.extend(bounds), write(rows, folder, bounds, *a)))
            found[size] = {r.t: r.drift for r in plan.drift_stream(spark, sf).collect()}
        assert len(batches) == (4 if size > 1000 else 12)
    assert found[100] == pytest.approx(found[1 << 20]) and len(found[100]) > 900


def test_windows_are_fitted_together_and_as_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 1 + m / 9, (90, 2)) for m in (0, 5, 1, 9, 0)])
    t = [k + 20 for k in range(450) if not 100 <= k < 260 and k != 300]  # windows without rows and with fewer
    windows = {s: np.array([x[k - 20] for k in t if s <= k < s + 60]).reshape(-1, 2) for s in range(0, 411, 30)}
    expected = {s: [c for c in I.best_by_bic(w, 3) if c.share > W.LEAST_SHARE] for s, w in windows.items() if len(w)}
    assert 0 < len(expected) < len(windows)
    rows = spark.createDataFrame([(k, x[k - 20].tolist()) for k in t], "t long, v array<double>")
    monkeypatch.setattr(W, "TOGETHER", 4)
    found = {r.start: json.loads(r.parts) for r in W.window_mixtures(rows, 60, 30).collect()}
    assert sorted(found) == sorted(expected)
    for s, parts in found.items():
        assert [p[0] for p in parts] == pytest.approx([c.share for c in expected[s]], abs=1e-6)
        assert np.array([p[1] for p in parts]) == pytest.approx(np.array([c.mu for c in expected[s]]), abs=1e-6)


def test_rounds_of_windows_invert_all_their_matrices_at_once(monkeypatch):
    windows, calls, pinv = list(np.random.default_rng(9).normal(0, 1, (16, 100, 2))), [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda s: (calls.append(1), pinv(s))[1])
    alone = [I.best_by_bic(w, 3) for w in windows]
    by_one = len(calls)
    together = I.best_of_many(windows, 3)
    assert 4 * (len(calls) - by_one) < by_one and [len(p) for p in together] == [len(p) for p in alone]
