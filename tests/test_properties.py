"""Properties of the Spark-free helpers, on generated input."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.geometry import rotation
from quern.operators.matching import match_on_line

numbers = st.lists(st.floats(-100, 100, allow_nan=False), min_size=0, max_size=5)


@given(numbers, numbers)
@settings(max_examples=80, deadline=None)
def test_matching_is_optimal_and_one_to_one(a, b):
    pairs = match_on_line(np.array(a), np.array(b))
    n = min(len(a), len(b))
    assert len(pairs) == len({i for i, _ in pairs}) == len({j for _, j in pairs}) == n
    if n:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        best = min(sum(abs(short[i] - long[j]) for i, j in enumerate(p)) for p in itertools.permutations(range(len(long)), n))
        assert sum(abs(a[i] - b[j]) for i, j in pairs) == pytest.approx(best, abs=1e-9)


@given(st.tuples(*[st.floats(-5, 5)] * 3).filter(lambda v: sum(x * x for x in v) > 0.01), st.floats(-360, 360))
@settings(max_examples=50, deadline=None)
def test_rotations_keep_lengths_and_their_axis(axis, angle):
    m = np.array(rotation(axis, angle))
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-9)
    assert np.allclose(m @ np.array(axis), axis, atol=1e-9)
