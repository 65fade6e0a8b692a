"""Words of many texts at once, as hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lodestar.llm.windows import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ALNUM = _ALPHA.copy()
_ALNUM[48:58] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[name] = have
    return have[:n]


@dataclass
class Words:
    """starts, ends: byte places in the joined texts; first: the index of each text's first word, then the total."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _starts(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where runs of ``inside`` begin; a run ends where its text ends."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(inside)]
    begins[at] = inside[at]
    return np.flatnonzero(begins)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False, digits: bool = False) -> Words:
    """Runs of bytes other than 0x20 and 0x09-0x0D; a word ends where its text ends.

    letters: runs of A-Z, a-z and bytes beyond ASCII instead; digits: of 0-9 as well.
    """
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = (_ALNUM if digits else _ALPHA)[data] if letters else ~_SPACE[data]
    starts = _starts(inside, offsets)
    stops = np.zeros(n + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    stops[cut] = inside[cut - 1]
    ends = np.flatnonzero(stops)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers("up", _BASE, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers("down", _INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of runs of letters, digits and bytes beyond ASCII of each text."""
    return np.diff(np.searchsorted(_starts(_ALNUM[data], offsets), offsets))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and bytes beyond ASCII, A-Z lower-cased, and the index of the text that each is from."""
    inside = _ALPHA[data]
    starts = _starts(inside, offsets)
    kept = np.flatnonzero(inside)
    at = np.append(np.searchsorted(kept, starts), len(kept)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(LOWER[data[kept]]))
    return terms, np.searchsorted(offsets, starts, side="right") - 1


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbouring words; of the whole sequence where it is shorter."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out * np.uint64(0xF1357AEA2E62A9C5)) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)
