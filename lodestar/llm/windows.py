"""Content-chosen anchors over byte strings.

Every window of ``span`` bytes owns one anchor: the ``gram``-byte string inside
it with the smallest mixed hash (leftmost on ties).  Two equal windows own equal
anchors at equal offsets, so windows can be dealt out by their anchor.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def gram_hash(data: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each ``length``-byte substring, by doubling."""
    level, width, power = data.astype(np.uint64) + np.uint64(1), 1, np.array([base])
    out, have = None, 0
    scale = None
    n = len(data) - length + 1
    while True:
        if length & width:
            if out is None:
                out, have, scale = level, width, power
            else:
                m = len(data) - have - width + 1
                out = out[:m] + scale * level[have : have + m]
                have, scale = have + width, scale * power
        width2 = width * 2
        if width2 > length:
            break
        m = len(data) - width2 + 1
        level = level[:m] + power * level[width : width + m]
        power = power * power
        width = width2
    return out[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
