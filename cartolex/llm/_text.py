"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64
bits: a polynomial over the bytes, prefix-summed so that every word of a batch
costs two array look-ups, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between the batches of a task."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def forget() -> None:
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in runs of about ``most`` bytes of text; a longer text is a run alone."""
    at = utf8(batch.column(text))[1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """The words of some texts: ``start`` and ``end`` (byte positions in ``raw``), ``doc`` (row) and ``hash``."""

    def __init__(self, column, lower: bool = True):
        raw, self.offsets = utf8(column)
        self.raw = _LOWER[raw] if lower else raw
        self.n_docs = len(self.offsets) - 1
        space = _SPACE[raw]
        n = len(raw)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U)
            self.count = np.zeros(self.n_docs, np.int64)
            self.first = np.zeros(self.n_docs + 1, np.int64)
            return
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        word = ~space
        begins = word.copy()
        begins[1:] &= space[:-1] | edge[1:n]
        ends = word
        ends[:-1] &= space[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum((self.raw.astype(U) + U(1)) * powers(_BASE, n), out=sums[1:])
        size = (self.end - self.start).astype(U)
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(_INVERSE, n)[self.start] + size * U(0x8CB92BA72F3D8DD7))


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): for each document its distinct ``k``-word shingles, sorted; a text of fewer words, but some, has one."""
    h, n = words.hash, len(words.hash)
    whole = np.zeros(n, U)
    if n:
        acc = h.copy()
        for i in range(1, k):
            acc[: n - i] = mix(acc[: n - i]) * U(0x9E3779B97F4A7C15) + h[i:]
        whole = mix(acc)
    out, starts = [], [0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            x = 0x51ED270B7F4A7C15 + b - a
            for y in h[a:b].tolist():
                x = (x * 0x2545F4914F6CDD1D + y) % (1 << 64)
            out.append(mix(np.array([x], U)))
        else:
            out.append(np.zeros(0, U))
        starts.append(starts[-1] + len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0, U)), np.array(starts, np.int64)


def letters(column) -> np.ndarray:
    """For each text, whether it has a letter (ASCII, or a code point that Unicode calls alphabetic)."""
    raw, at = utf8(column)
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~found):
        text = raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "ignore")
        found[i] = any(c.isalpha() for c in text)
    return found
