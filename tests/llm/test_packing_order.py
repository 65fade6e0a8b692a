"""Neighbours come best first, however few of them are sorted at first."""

import numpy as np
import pytest

from lodestar.llm.packing import _best_first


@pytest.mark.parametrize("n", [0, 1, 64, 257, 3000])
def test_best_first(n):
    rng = np.random.default_rng(n)
    scores, own = np.round(rng.random(n) * 20) - 2.0, rng.permutation(n)
    near = np.flatnonzero(scores >= 0)
    assert list(_best_first(scores, own)) == own[near[np.argsort(-scores[near], kind="stable")]].tolist()
