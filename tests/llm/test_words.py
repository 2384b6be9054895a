"""Word keys of long data equal those of short data."""

import numpy as np
import pytest

from tamiz.llm import words as W


def test_keys_do_not_depend_on_stretches(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    cuts = np.unique(np.concatenate([[0], rng.integers(0, 3000, 200), [3001, 4400, 4990, 5000]]))
    starts, ends = cuts[:-1], cuts[1:]
    whole = W.span_hashes(data, starts, ends)
    longer = np.array([W.span_hashes(data[a:b], np.zeros(1, np.int64), np.full(1, b - a))[0] for a, b in zip(starts, ends)])
    assert (whole == longer).all()
    monkeypatch.setattr(W, "SLICE_BYTES", 64)
    monkeypatch.setattr(W, "_POWERS", {})
    assert (W.span_hashes(data, starts, ends) == whole).all()
    many = np.repeat(starts, 2)
    assert (W.span_hashes(data, many, np.minimum(many + 3, np.repeat(ends, 2))) == np.repeat(W.span_hashes(data, starts, np.minimum(starts + 3, ends)), 2)).all()


@pytest.mark.parametrize("n", range(8))
def test_runs_of_fewer_keys_than_asked_are_none(n):
    keys = np.arange(n, dtype=np.uint64)
    assert len(W.combine(keys, 5)) == max(0, n - 4)
