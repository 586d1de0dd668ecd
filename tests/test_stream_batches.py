"""Windows followed by whole batches: the scores of following them row by row, without work for each row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import sliding


def made(rng, n, axes, trained):
    """(t, v, near) of a label's rows, with gaps longer than a window, rows without neighbours and one whose value is not a number."""
    t = np.cumsum(rng.integers(1, 5, n) + 40 * (rng.random(n) < 0.03))
    xs = rng.standard_normal((trained, axes))
    rows = []
    for k in range(n):
        js = rng.choice(trained, rng.integers(0, 4), replace=False)
        rows.append((int(t[k]), rng.standard_normal(axes), [(int(j), xs[j]) for j in js]))
    return rows


def stretch(rows, axes):
    near = [r for _, _, found in rows for r in found]
    values = np.concatenate([v for _, v in near]) if near else np.zeros(0)
    return [np.array([t for t, _, _ in rows]), np.concatenate([v for _, v, _ in rows]), np.array([len(f) for _, _, f in rows]), np.array([j for j, _ in near], np.int64), values]


@pytest.mark.parametrize("axes, trained", [(1, 9), (3, 400)])
def test_batches_of_rows_have_the_scores_of_rows_one_by_one(axes, trained, monkeypatch):
    monkeypatch.setattr(sliding, "TOGETHER", 37)
    monkeypatch.setattr(sliding, "PLACES", 50)
    rng = np.random.default_rng(axes)
    rows = made(rng, 400, axes, trained)
    last = rows[-1][0] + 45
    one, expected = sliding.Followed(12), {}
    for t, v, near in [*((t, v.tolist(), [[j, x.tolist()] for j, x in near]) for t, v, near in rows), (last, None, None)]:
        for s, e, score in one.on(t, v, near):
            expected |= {k: score for k in range(s, e)}
    marks, many, found = [rows[90][0] + 3, rows[91][0] + 200, rows[250][0], last], sliding.Batched(12), {}
    for low, mark in zip([0, *marks[:-1]], marks, strict=True):
        some = [r for r in rows if low < r[0] <= mark]
        parts = [stretch(p, axes) for p in (some[40:], some[:40]) if p]  # in any order
        for places, scores in many.on(parts, mark):
            assert len(set(places // 50)) == 1 and not found.keys() & set(places.tolist())
            found |= dict(zip(places.tolist(), scores.tolist(), strict=True))
        many = sliding.Batched(12, many.dump())
    assert sorted(found) == sorted(expected)
    assert all(found[k] == pytest.approx(expected[k], abs=1e-9) for k in expected)


def test_a_broken_value_counts_in_its_own_windows_only():
    rows = [(t, np.array([np.nan if t == 30 else t % 7]), [(t % 3, np.array([t % 3 * 2.0]))]) for t in range(80)]
    found = {int(t): s for places, scores in sliding.Batched(5).on([stretch(rows, 1)], 79) for t, s in zip(places, scores, strict=True)}
    assert [t for t in range(80) if np.isnan(found[t])] == [30, 31, 32, 33, 34]


def test_a_batch_is_not_followed_row_by_row(monkeypatch):
    """Distances are made for some hundred rows at a time: with one call or more a row, 1 000 000 rows did not end within 200 s."""
    calls, block = [], sliding.distance_block
    monkeypatch.setattr(sliding, "distance_block", lambda a, b: (calls.append(1), block(a, b))[1])
    rng = np.random.default_rng(7)
    t, xs = np.arange(0, 60_000, 3), rng.standard_normal(100)
    js = rng.integers(0, 100, (len(t), 1))
    held = [t, rng.standard_normal(len(t)), np.ones(len(t), np.int64), js.ravel(), xs[js].ravel()]
    assert sum(len(p) for p, _ in sliding.Batched(30).on([held], 59_999)) == 60_000
    assert len(calls) < len(t) / 100


def test_packed_rows_are_the_rows_with_their_neighbours(spark):
    """On one axis in sorted arrays, on more by pairs; labels null and without training rows, and batches cut as by their bounds."""
    rng = np.random.default_rng(8)
    rows = [(t, float(rng.integers(0, 9)), [None, "a", "b", "c"][t % 4]) for t in range(5, 205)]
    table = spark.createDataFrame(rows, "t long, x double, label string").repartition(3)
    cuts = [5 + 200 * k // 7 for k in range(8)]
    for wide in (table, table.select("t", "label", F.array("x").alias("v"))):
        trained = wide.where("t < 90 and label in ('a', 'b')")
        expected = {r.t: (r.label, list(r.v), [(n.j, n.v[0]) for n in r.near]) for r in sliding.with_near(wide, trained, 3).collect()}
        found = {}
        for r in sliding.packed(wide, trained, 3, 5, 204, 7).collect():
            ts, v, counts, js, near = (np.frombuffer(r[c], kind) for c, kind in sliding.HELD.items())
            assert r.t == ts.min() and len({sum(c <= t for c in cuts) for t in ts}) == 1
            at = np.cumsum(counts) - counts
            found |= {int(t): (r.label, [x], sorted(zip(js[a : a + n].tolist(), near[a : a + n].tolist(), strict=True))) for t, x, a, n in zip(ts, v, at, counts, strict=True)}
        assert found == expected and len(found) == 200
