"""Column-wise suffix order against plain comparison."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.bwt import suffix_classes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=9), st.integers(1, 5))
def test_classes(strings, span):
    data, offsets = np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    got = iter(suffix_classes(data, offsets, span).tolist())
    classes: dict[bytes, int] = {}
    for s in strings:
        for i in range(len(s)):
            x = next(got)
            if len(s) - i >= span:
                assert classes.setdefault(s[i : i + span], x) == x
    assert len(set(classes.values())) == len(classes)
