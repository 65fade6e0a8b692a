"""The Burrows-Wheeler transform and common prefixes of a collection, built column by column.

All strings of the collection grow by one symbol a round, from their ends: each round
inserts, for every string that is long enough, the suffix one symbol longer.  Its place
follows from the transform alone (how often its first symbol occurs before the shorter
suffix), and the common prefixes next to it from minima over the present ones.  Transform
and prefixes are each read once and written once a round, in order, as files would be; the
collections here are small enough for both to stay in memory.
"""

from __future__ import annotations

import numpy as np


def _minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of the upper byte in each range low..high, ends included; ranges in the order of their ends, high below the last place."""
    if not len(low):
        return values[:0]
    edges = np.empty(2 * len(low), np.int64)
    edges[::2], edges[1::2] = low, high + 1
    return np.minimum.reduceat(values, edges)[::2] >> 8


def suffix_classes(data: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    """For each byte of the strings data[offsets[i]:offsets[i + 1]], the class of the suffix that starts there.

    Two suffixes of ``span`` or more symbols are in one class exactly if their first
    ``span`` symbols agree.
    """
    starts, ends = offsets[:-1], offsets[1:]
    sizes = ends - starts
    m, total = len(sizes), len(data) + len(sizes)
    kind, bits = (np.uint32, 23) if total < 1 << 23 else (np.int64, 40)
    mask = kind((1 << bits) - 1)
    present = np.zeros(256, bool)
    present[data] = True
    symbols = np.zeros(len(data) + 1, np.uint8)
    symbols[1:] = np.cumsum(present)[data]  # numbered from 1: text uses fewer than 256 byte values; 0 is the end of a string
    before = symbols.copy()  # the symbol before each byte; none before a string's first
    before[starts] = 0
    both = np.zeros(m + 1, np.uint16)  # the transform's symbol in the lower byte, the common prefix with the place before in the upper one; a place more than there are
    both[:-1] = np.where(sizes > 0, symbols[ends], 0)
    own, at = np.arange(m), np.arange(m, dtype=kind)  # strings that still grow, and where their present suffixes are, ascending
    occurs = np.zeros(0, kind)  # all places of the transform by (symbol, place)
    r = 0
    while len(own):
        r += 1
        c = both[at] & 0xFF
        key = c.astype(kind) << kind(bits) | at
        by_symbol = np.argsort(key, kind="stable")
        there = np.searchsorted(occurs, key[by_symbol]) + np.arange(len(own))
        old = np.ones(len(both) - 1, bool)
        old[there] = False
        grown = np.empty(len(both) - 1, kind)
        grown[there], grown[old] = key[by_symbol], occurs
        occurs = grown
        ended = int(np.searchsorted(occurs, kind(1) << kind(bits)))
        live = c > 0
        k = np.empty(len(own), np.int64)
        k[by_symbol] = there
        k, shorter, c = k[live], at[live].astype(np.int64), c[live]
        by_symbol = by_symbol[live[by_symbol]]
        by_symbol = (np.cumsum(live) - 1)[by_symbol]
        own = own[live][by_symbol]
        if not len(own):
            break
        # common prefixes with the neighbours that begin with the same symbol
        fore, aft = occurs[np.maximum(k - 1, 0)], occurs[np.minimum(k + 1, len(occurs) - 1)]
        left = np.flatnonzero((k > 0) & (fore >> kind(bits) == c))
        right = np.flatnonzero((k < len(occurs) - 1) & (aft >> kind(bits) == c))
        own_prefix, follows = np.zeros((2, len(k)), np.uint16)
        own_prefix[left] = np.minimum(_minima(both, (fore[left] & mask).astype(np.int64) + 1, shorter[left]) + 1, span)
        follows[right] = np.minimum(_minima(both, shorter[right] + 1, (aft[right] & mask).astype(np.int64)) + 1, span)
        new = (m + k - ended)[by_symbol]
        old = np.ones(len(both) + len(new), bool)
        old[new] = False
        grown = np.zeros(len(old), np.uint16)
        grown[old] = both
        after = new + 1
        grown[after] = grown[after] & 0xFF | follows[by_symbol] << 8
        grown[new] = before[ends[own] - r] | own_prefix[by_symbol] << 8
        occurs = (occurs & ~mask) | np.flatnonzero(old).astype(kind)[occurs & mask]
        both, at = grown, new.astype(kind)
    rank = np.empty(len(occurs), np.int64)
    rank[occurs & mask] = np.arange(len(occurs))
    ended = int(np.count_nonzero((both[:-1] & 0xFF) == 0))
    group = np.cumsum(both[:-1] >> 8 < span)
    out = np.zeros(len(data), np.int64)
    place = np.arange(m)
    for r in range(1, int(sizes.max(initial=0)) + 1):  # walk all strings from their ends through the finished transform
        live = np.flatnonzero(sizes >= r)
        place[live] = m + rank[place[live]] - ended
        out[ends[live] - r] = group[place[live]]
    return out
