"""Elias-Fano sequences: strictly monotone numbers in about two bits more than their low halves need.

A number's low bits stand in a packed array; its high bits are written in unary, so that
the k-th one of a bit string belongs to the k-th number and each zero ends the numbers of
one high part.  All look-ups take arrays, and read the parts wherever they lie, for example
in a memory-mapped file.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_NTH = np.array([[*[k for k in range(8) if b >> k & 1], *[0] * 8][:8] for b in range(256)], np.uint8).ravel()
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _nth_one(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one, from 0, of each 64-bit word: by counts of ones up to each byte, all eight in one word."""
    k = k.astype(np.uint64)
    pairs = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    fours = (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((fours + (fours >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    bit = np.bitwise_count((((k * _BYTES) | _TOPS) - upto) & _TOPS).astype(np.uint64) << np.uint64(3)
    rest = k - (((upto << np.uint64(8)) >> bit) & np.uint64(0xFF))
    byte = (words >> bit) & np.uint64(0xFF)
    return (bit + _NTH[(byte << np.uint64(3)) | rest]).astype(np.int64)


@dataclass
class Sequence:
    """n numbers, ``bits`` low bits each; high: words of the unary part; ones: how many ones stand before each word."""

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    def __post_init__(self) -> None:
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self._windows = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        self._runs = np.ndarray((max(8 * len(self.high) - 7, 0),), "<u8", self.high, strides=(1,))

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> bits) + np.arange(n)
        flags = np.zeros(-(-(n + (top >> bits) + 2) // 64) * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.cumsum(_POP[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64))
        rest = (values[:, None] >> np.arange(bits) & 1).astype(np.uint8) if n < 1 << 16 else np.concatenate([(v[:, None] >> np.arange(bits) & 1).astype(np.uint8) for v in np.array_split(values, n >> 15)])
        low = np.append(np.packbits(rest.ravel(), bitorder="little"), np.zeros(8, np.uint8))
        return cls(n, bits, low, high, np.append(0, ones[:-1]).astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        return (self._windows[bit >> 3] >> (bit & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, zero: bool = False) -> np.ndarray:
        """The place of the k-th one or zero of the unary part."""
        before = self.zeros if zero else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        words = self.high[word]
        return word * 64 + _nth_one(~words if zero else words, k - before[word])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``."""
        return (self._select(i) - i) << self.bits | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that isn't below x, among those of x's high part (else where they end), and whether it is x.

        Each distinct x is looked for once, in ascending order, so that neighbouring look-ups read neighbouring parts.
        """
        order = np.argsort(x)
        ordered = x[order]
        new = np.append(True, ordered[1:] != ordered[:-1])[: len(x)]
        which = np.empty(len(x), np.int64)
        which[order] = np.cumsum(new) - 1
        place, there = self._successor(ordered[new])
        return place[which], there[which]

    def _successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = x >> self.bits, x & ((1 << self.bits) - 1)
        inside = high < 64 * len(self.high) - self.n
        high = np.where(inside, high, 0)
        at = self._select(np.maximum(high - 1, 0), zero=True) + 1
        at[high == 0] = 0
        first = at - high
        stop = first + self._ones(at, high)
        end = stop.copy()
        open_ = np.flatnonzero(first < stop)
        while len(open_):
            middle = (first[open_] + stop[open_]) >> 1
            below = self._low(middle) < low[open_]
            first[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
            open_ = open_[first[open_] < stop[open_]]
        return first, inside & (first < end) & (self._low(np.minimum(first, max(self.n - 1, 0))) == low)

    def _ones(self, at: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many ones stand from the places ``at`` on, where the numbers of the parts ``high`` are: from the next 56 bits, or for longer runs from the zero that ends them."""
        byte = np.minimum(at >> 3, len(self._runs) - 1)
        window = ~(self._runs[byte] >> (at - 8 * byte).astype(np.uint64))
        run = np.bitwise_count((window & (~window + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        long = np.flatnonzero(run + at - 8 * byte > 56)
        if len(long):
            run[long] = self._select(high[long], zero=True) - at[long]
        return run
