"""Repeated strings of a fixed length among byte segments, by threshold-bounded interval expansion.

The segments' suffixes are sorted (prefix doubling, each segment ending in a mark of its own), which
gives the Burrows-Wheeler transform.  From the interval of all suffixes, intervals of strings w are
extended backwards to those of cw, breadth first, so the common-prefix lengths at their right ends
come out by increasing value; an interval whose end is known is not followed further.  The search
stops at the threshold: neighbours whose length is still unknown share at least that many bytes.
"""

from __future__ import annotations

import numpy as np

_PACK = 7  # symbols of nine bits in the first sort key


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array of codes (bytes plus 1; 0 ends a segment, and the ends count as different, in their order)."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(_PACK, codes.dtype)]).astype(np.int64)
    key, inside = np.zeros(n, np.int64), np.ones(n, bool)
    for t in range(_PACK):
        c = padded[t : t + n]
        key = key * 512 + c * inside
        inside &= c != 0
    order = np.argsort(key)
    ends = ~inside[order]
    tied = order[ends]
    order[ends] = tied[np.lexsort((tied, key[tied]))]
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ends[1:]
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    size = np.diff(np.append(start, n))
    open_ = np.repeat(size > 1, size)
    slots, reach = np.flatnonzero(open_), _PACK
    while len(slots):
        at = order[slots]
        key = (rank[at] << 32) | rank[at + reach]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        rank[at] = np.repeat(slots[start], size)
        slots = slots[np.repeat(size > 1, size)]
        reach *= 2
    return order


def group_bounds(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """bool[n + 1]: where, in suffix order, the first length symbols change (ends of segments differ from everything)."""
    n = len(codes)
    first = codes[order]
    bwt = codes[order - 1]  # order 0 wraps to the last symbol, an end mark
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    # end marks sort first and are all different, in text order: each is an interval of its own from the first step on
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    marks = int((codes == 0).sum())
    known[: marks + 1] = True
    stamp = np.full(n + 2, -1, np.int64)  # shifted by one, so that both neighbours exist
    low, high, base = np.array([0]), np.array([n]), 0
    for step in range(length):
        width = high - low
        owner = np.repeat(np.arange(base, base + len(low)), width)
        base += len(low)
        at = np.arange(len(owner)) + np.repeat(low - (np.cumsum(width) - width), width)
        real = bwt[at] != 0
        at, owner = at[real], owner[real]
        to = lf[at]
        stamp[to + 1] = owner
        c = first[to]
        after, before = np.minimum(to + 1, n - 1), np.maximum(to - 1, 0)
        right = to[(stamp[to + 2] != owner) | (first[after] != c)]
        left = to[(stamp[to] != owner) | (first[before] != c)]
        right.sort()
        left.sort()
        fresh = ~known[right + 1]
        low, high = left[fresh], right[fresh] + 1
        known[high] = True
        if not step:
            low, high = np.concatenate([np.arange(marks), low]), np.concatenate([np.arange(1, marks + 1), high])
        if not len(low):
            break
    return known


def repeated_starts(segments: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, the starts whose next length bytes also start elsewhere; a segment of weight m stands for m equal ones."""
    if not segments:
        return []
    sizes = np.array([len(s) + 1 for s in segments])
    ends = np.cumsum(sizes)
    codes = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    codes[ends - 1] = 0
    order = suffix_order(codes)
    bounds = np.flatnonzero(group_bounds(codes, order, length))
    owner = np.repeat(np.arange(len(segments)), sizes)
    weight = np.add.reduceat(weights[owner[order]], bounds[:-1])
    hit = np.zeros(len(codes), bool)
    hit[order[np.repeat(weight > 1, np.diff(bounds))]] = True
    begins = ends - sizes
    return [np.flatnonzero(hit[b : max(b, e - length)]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
