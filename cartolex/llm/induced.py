"""Suffix arrays by induced sorting, vectorised over buckets.

Positions are classified as S (smaller than their successor) or L. Leftmost S
positions (LMS) are sorted by inducing their substrings, named, and sorted as
suffixes through the string of names, recursively; from them all L and then all
S suffixes are induced. Inducing from one bucket is a handful of array
operations, since a suffix is only ever moved to a later bucket or, by runs of
one symbol, to a later round of its own. So that buckets stay few, a string of
more than ``WALK`` names is recursed on with each name written as two digits: the
suffixes that begin at a name keep their order. Names that occur once are left
out of the recursion but for those that end a comparison.
"""

from __future__ import annotations

import numpy as np

WALK = 256  # names of one digit


def _types(t: np.ndarray) -> np.ndarray:
    """True for S; the last symbol, the unique smallest, is S."""
    n = len(t)
    at = np.arange(n)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    nxt = np.minimum.accumulate(np.where(differs, at, n)[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = t[:-1] < t[1:]
    return smaller[nxt]


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that follows from LMS positions ``lms`` in order (by bucket at least).

    A bucket is its L suffixes, then its S suffixes. Whatever precedes the suffixes
    of one bucket is dealt to the fronts (L) or, backwards, to the ends (S) of the
    buckets of its symbols.
    """
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    start = end - size
    out = np.empty(len(t), np.int32)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    seed_at = np.concatenate([[0], np.cumsum(np.bincount(t[lms], minlength=k))])

    def before(now, s):
        now = now[now > 0] - 1
        return now[is_s[now] == s]

    front = start.copy()

    def deal(pos):
        if not len(pos):
            return
        symbol = t[pos]
        order = np.argsort(symbol, kind="stable")
        symbol, count = symbol[order], np.bincount(symbol, minlength=k)
        out[(front - np.cumsum(count) + count)[symbol] + np.arange(len(pos))] = pos[order]
        np.add(front, count, out=front)

    for c in range(k):
        at = start[c]
        while at < front[c]:
            now, at = out[at : front[c]], front[c]
            deal(before(now, False))
        deal(before(seeds[seed_at[c] : seed_at[c + 1]], False))
    back = end.copy()

    def deal_back(pos):
        if not len(pos):
            return
        symbol = t[pos]
        order = np.argsort(symbol, kind="stable")
        symbol, count = symbol[order], np.bincount(symbol, minlength=k)
        out[(back - 1 + np.cumsum(count) - count)[symbol] - np.arange(len(pos))] = pos[order]
        np.subtract(back, count, out=back)

    for c in range(k - 1, -1, -1):
        if c == 0:  # the last suffix is that of the symbol 0 alone
            out[0] = len(t) - 1
            back[0] = 0
        at = end[c]
        while at > back[c]:
            now, at = out[back[c] : at][::-1], back[c]
            deal_back(before(now, True))
        deal_back(before(out[start[c] : front[c]][::-1], True))
    return out


def _ordered(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names, of which the last is 0 and only it.

    A name that occurs once ends every comparison that reaches it, so of a run of
    such names the first stays in the string and the others are in order already.
    """
    times = np.bincount(names)
    keep = times[names] > 1
    keep[1:] |= keep[:-1]
    keep[-1] = True
    if not keep.all():
        rank, own = np.zeros(len(names), np.int64), np.flatnonzero(keep)
        rank[own[_digits(np.unique(names[own], return_inverse=True)[1].astype(np.int32))]] = np.arange(len(own))
        return np.lexsort((rank, names))
    return _digits(names)


def _digits(names: np.ndarray) -> np.ndarray:
    """As ``_ordered``, by the recursion alone."""
    k = int(names.max()) + 1
    if k <= WALK:
        return suffix_array(names, k)
    base = int(np.ceil(np.sqrt(k)))
    digits = np.zeros(2 * len(names) - 1, np.int32)
    digits[:-1:2], digits[1::2] = names[:-1] // base + 1, names[:-1] % base + 1
    order = suffix_array(digits, base + 2)
    return order[order % 2 == 0] // 2


def _names(t: np.ndarray, lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For sorted LMS substrings, of which the first is alone: names by equality with the one before."""
    a, b = lms[:-1], lms[1:]
    equal = np.zeros(len(b), bool)
    left = np.flatnonzero(length[:-1] == length[1:])
    j = 0
    while len(left):
        left = left[t[a[left] + j] == t[b[left] + j]]
        done = length[left] == j
        equal[left[done]] = True
        left = left[~done]
        j += 1
    return np.concatenate([[0], np.cumsum(~equal)])


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Positions of all suffixes in order. ``t``: symbols below ``k``, the last one 0 and only there."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    t = t.astype(np.uint16 if k <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    is_s = _types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    mark = np.full(n, -1, np.int32)
    mark[lms] = np.arange(len(lms))
    rough = _induce(t, is_s, lms, k)
    order = mark[rough]
    order = order[order >= 0]
    length = np.zeros(len(lms), np.int64)
    length[:-1] = np.diff(lms)
    names = _names(t, lms[order], np.where(order == len(lms) - 1, -1, length[order]))
    if names[-1] == len(lms) - 1:
        return _induce(t, is_s, lms[order], k)
    reduced = np.empty(len(lms), np.int32)
    reduced[order] = names
    return _induce(t, is_s, lms[_ordered(reduced)], k)


def same_prefix(raw: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether raw[a:] and raw[b:] share ``least`` bytes (8 or more; both have so many)."""
    words = raw[: len(raw) - 7].astype(np.uint64)
    for i in range(1, 8):
        words |= raw[i : len(raw) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    alive = np.arange(len(a))
    for at in [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]:
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def equal_windows(raw: np.ndarray, sa: np.ndarray, valid: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts in suffix order, first of each group of windows of ``least`` equal bytes).

    Common prefixes are computed in text order, each position against its
    predecessor in suffix order, and permuted back.
    """
    order = sa[valid[sa]]
    if not len(order):
        return order, np.zeros(0, bool)
    phi = np.full(len(raw), -1, np.int64)
    phi[order[1:]] = order[:-1]
    here = np.flatnonzero(phi >= 0)
    long = np.zeros(len(raw), bool)
    long[here] = same_prefix(raw, here, phi[here], least)
    return order, ~long[order]
