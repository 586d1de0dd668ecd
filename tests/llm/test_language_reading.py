"""The reading of the language network: what it computes, and how many steps it takes for it."""

import numpy as np
import pytest

from tidemark.llm import language


def test_reading_takes_a_step_a_byte_and_agrees_with_all_states(monkeypatch):
    network = language.Network(["a", "b", "c"], hidden=4)
    rows, _ = language.stretches(["Grüße aus Köln, 12 words and 7 numbers ".encode() * 40])
    own = slice(language.CONTEXT, language.CONTEXT + language.OWN)
    expected = np.moveaxis(network._probabilities(network._states(rows))[own], -1, 0)
    steps, matmul = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: (steps.append(1), matmul(*a, **k))[1])
    found = network.read(rows, own)
    assert len(steps) == language.CONTEXT + language.OWN
    assert found == pytest.approx(expected, abs=1e-5)


def test_reading_bears_gates_that_are_shut():
    network = language.Network(["a", "b"], hidden=2)
    network.w["x"] *= 1000
    rows, _ = language.stretches([b"open and shut"])
    own = slice(language.CONTEXT, language.CONTEXT + language.OWN)
    with np.errstate(all="raise", under="ignore"):
        found = network.read(rows, own)
    assert found == pytest.approx(np.moveaxis(network._probabilities(network._states(rows))[own], -1, 0), abs=1e-5)
