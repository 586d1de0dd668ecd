"""Layouts whose rounds are a task's or a job each: as by joins, and all of their rounds."""

import pickle

import numpy as np

from tidemark.operators import layout as L
from tidemark.operators import rounds as R
from tidemark.plans import layout as plan


def test_rounds_of_sent_positions_are_those_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal((70, 4)), rng.standard_normal((70, 4)) + 5])[rng.permutation(140)]
    points = spark.createDataFrame([(3 * t, x.tolist(), t % 2) for t, x in enumerate(v)], "t long, v array<double>, label int")
    monkeypatch.setattr(R, "STRIP", 100)
    rows = lambda df: np.array(sorted(map(tuple, df.collect())))
    first = lambda sent: L.fitted_in_rounds(points.where("t < 330"), 5.0, 4, sent=sent)
    placed = first(0)
    then = lambda sent: rows(L.continued_in_rounds(points, placed, 5.0, 2, sent=sent))
    joined = rows(placed), then(0)
    for alone in (R.ALONE, 0):
        monkeypatch.setattr(R, "ALONE", alone)
        found = rows(first(1000)), then(1000)
        assert [len(f) for f in found] == [110, 140]
        assert all(np.allclose(a, b, rtol=1e-5, atol=2e-9) for a, b in zip(found, joined, strict=True))
    assert not np.allclose(joined[1][:110], joined[0])


def test_a_layout_that_does_not_improve_ends_with_its_best(spark):
    errors = iter([3.0, 1.0, 2.0, 2.0, 2.0])

    class Fake:
        def sums(self, at):
            return np.ones((4, at.n)), np.ones((6, at.n))

        def error(self, at, total):
            seen.append(at.x.copy())
            return next(errors)

    seen = []
    found = R.next_layout(Fake(), np.random.default_rng(2).standard_normal((2, 9)), R.NONE, 500, 0.5, 30)
    assert len(seen) == 5 and (found[0] == seen[1]).all()


def test_layout_steps_takes_all_rounds(spark, monkeypatch):
    taken = []

    class Counted:
        error_now = 0.0

        def sums(self, at):
            taken[-1] += 1
            return np.zeros((4, at.n)), np.ones((6, at.n))

        def error(self, at, total):
            self.error_now -= 1
            return self.error_now

    def laid_out(edges, start, layout, anchors=None):
        taken.append(0)
        layout(Counted(), np.random.default_rng(3).standard_normal((2, 30)))
        return start.select("t", "x", "y")

    monkeypatch.setattr(L, "laid_out", laid_out)
    assert plan.layout_steps(spark, "/root/testdata/sf0.001").count() == 500
    assert taken == [1000, 500]  # as the reference's first layout and those that go on


def test_what_a_round_sends_can_be_read_without_the_library():
    at = R.Positions(np.random.default_rng(4).standard_normal((2, 300)), np.ones((2, 3)))
    sent = pickle.dumps(at.plain())
    again = R.Positions.of(pickle.loads(sent))
    assert b"tidemark" not in sent
    assert all((a == b).all() for a, b in zip(at.pushed(1, 3), again.pushed(1, 3), strict=True))
