"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped by workers.

Words come first: their counts are sorted hash arrays in the shared folder, a
range of hashes a shard, and a word's id is its place among all of them. Then
each task reduces its texts to distinct n-grams of the highest order, with
counts, and sends them to shards as compressed ids. A shard sums its n-grams,
writes their sorted array to the shared folder and beside it a file for the
shards of the order below, of two parts: each n-gram's suffix with the number of
words found in front of it (the continuation count, which is the count of the
lower orders), and its prefix with sums over what follows (total, and how many
continuations were seen once, twice, oftener). That order reads its parts of
these files and does the same, down to single words; files and exchanges go once
they are read. Scoring maps the arrays and searches sorted queries.

An n-gram's shard is taken from the key of the whole n-gram, so a context of any
frequency is spread over all shards and meets as partial sums.

Words are told apart by 64 bits of hash where they are counted, by 48 in n-grams.
An n-gram's key is all bits of its ids, scrambled, if they are 64 at most, else 64
bits of hash; an array holds the last four or six bytes of its sorted keys, and
where each value of the bits before them starts, so a key is found by all its bits.
Counts are 64-bit: arrays hold numbers of the commonest rows of counts, in one
byte or two, and other rows beside them. The lowest order is interpolated with the
uniform distribution over the vocabulary and one unknown word; each order has the
three discounts of modified Kneser-Ney, from its counts of counts. A text starts
with order - 1 start marks.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end per text.

Defined cases: a null or empty text is its end token alone; without training
rows the model is uniform over the unknown word (score 0 per token); repeated
rows count each time; a null id is in the training part (its remainder is null)
and keeps its row; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import os
import shutil
import uuid
from ast import literal_eval

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text
from .langid import fold

U = np.uint64
ORDER = 3
BOS, END = U(1), U(2)
#: ids that are no word's
FIRST, UNKNOWN = U(0), U(1)
HELD, BUCKET, _CODEC = 1_500_000, 32, "zstd"
_ROWS = "shard int, a binary"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def pack48(x: np.ndarray) -> np.ndarray:
    """48-bit values in six bytes each, as rows of bytes."""
    return np.ascontiguousarray(x.astype("<u8").reshape(-1).view(np.uint8).reshape(-1, 8)[:, :6])


def unpack48(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def pack_counts(x: np.ndarray) -> bytes:
    """64-bit counts: a byte each, and those of 255 or more beside them."""
    over = np.flatnonzero(x >= 255)
    return np.int64(len(x)).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + over.astype("<i8").tobytes() + x[over].astype("<i8").tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, "<i8", 1)[0])
    out = np.frombuffer(b, np.uint8, n, 8).astype(np.int64)
    over = np.frombuffer(b[8 + n :], "<i8").reshape(2, -1)
    out[over[0]] = over[1]
    return out


def shard_of(key: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    """By the top bits of keys of ``bits``, so that a shard is a range of keys."""
    return ((key >> U(bits - 32)) * U(shards) >> U(32)).astype(np.int64)


def windows(token: np.ndarray, count: np.ndarray, order: int, start) -> np.ndarray:
    """The n-grams that end with each token, ``count`` tokens a text; ``start`` before its first."""
    n = len(token)
    place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    grams = np.full((n, order), start, token.dtype)
    for j in range(order):
        back = order - 1 - j
        own = np.flatnonzero(place >= back)
        grams[own, j] = token[own - back]
    return grams


def tokens_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all tokens, ends included, in text order; tokens of each text)."""
    w = _text.Words(column)
    token = np.full(len(w.hash) + w.n_docs, END << U(16))
    token[np.arange(len(w.hash)) + w.doc] = np.maximum(w.hash, U(3) << U(16))
    return token, w.count + 1


def token_stream(column, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit words, n-grams of 48-bit words that end with them, document) of all tokens, ends included, in text order."""
    token, count = tokens_of(column)
    return token, windows(token >> U(16), count, order, BOS), np.repeat(np.arange(len(count)), count)


def scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of values of ``bits`` that spreads them."""
    mask, half = U((1 << bits) - 1), U(bits // 2)
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        x = x * U(factor) & mask
        x = x ^ (x >> half)
    return x


def in_order(key: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit keys.

    Their leading bits, with their places in the bits behind, are sorted as plain
    numbers, which takes a third of the time of sorting places by keys; keys that
    differ in later bits only are put in order after that.
    """
    n = len(key)
    if n < 2 or (key[1:] >= key[:-1]).all():
        return np.arange(n)
    low, bits = key.min(), (n - 1).bit_length()
    drop = max(int(key.max() - low).bit_length() + bits - 64, 0)
    packed = (key - low) >> U(drop) << U(bits)
    packed |= np.arange(n, dtype=U)
    packed.sort()
    packed &= U((1 << bits) - 1)
    order = packed.view(np.int64)
    if drop:
        k = key[order]
        if (k[1:] < k[:-1]).any():
            order = order[np.argsort(k, kind="stable")]
    return order


def _starts(key: np.ndarray) -> np.ndarray:
    """Where each of sorted keys is first."""
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them."""
    order = in_order(key)
    k = key[order]
    first = _starts(k)
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
    return k[first], back


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sums of ``values``, and where each key is first."""
    order = in_order(key)
    k = key[order]
    first = _starts(k)
    return (k[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values), order[first])


def _take(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Some rows of ids, column after column in memory."""
    return np.take(ids.T, at, 1).T


def pack_rows(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows of ids (sorted by the first two, which makes them small) and their rows of counts, compressed."""
    n, k = ids.shape
    lead = ids[:, 0] if k == 1 else ids[:, 0].astype(U) << U(32) | ids[:, 1]
    if (lead[1:] < lead[:-1]).any():
        by = in_order(lead.astype(U))
        ids, counts = _take(ids, by), counts[:, by]
    planes = np.empty((k, 4, n), np.uint8)
    for j in range(k):
        column = ids[:, j].astype("<u4")
        if not j:
            column[1:] -= column[:-1].copy()
        planes[j] = column.view(np.uint8).reshape(n, 4).T
    raw = np.array([n, k], "<i8").tobytes() + planes.tobytes() + pack_counts(counts.reshape(-1))
    return np.int64(len(raw)).tobytes() + pa.compress(raw, _CODEC, asbytes=True)


def unpack_rows(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(b[8:], int(np.frombuffer(b, "<i8", 1)[0]), _CODEC, asbytes=True)
    n, k = np.frombuffer(raw, "<i8", 2).tolist()
    planes = np.frombuffer(raw, np.uint8, 4 * n * k, 16).reshape(k, 4, n)
    ids = np.empty((k, n), "<u4")
    ids.view(np.uint8).reshape(k, n, 4).transpose(0, 2, 1)[:] = planes
    ids[0] = np.cumsum(ids[0])
    return ids.T, unpack_counts(raw[16 + 4 * n * k :]).reshape(-1, n)


def _unpacked(parts: list[bytes], level: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    each = [unpack_rows(p) for p in parts] or [(np.zeros((0, level), "<u4"), np.zeros((columns, 0), np.int64))]
    return np.concatenate([i.T for i, _ in each], 1).T, np.concatenate([c for _, c in each], 1)


def _cut(key: np.ndarray, shards: int, bits: int = 64):
    """(shard, its slice) of sorted keys."""
    cut = np.searchsorted(shard_of(key, shards, bits), np.arange(shards + 1))
    return [(int(s), slice(cut[s], cut[s + 1])) for s in np.flatnonzero(np.diff(cut))]


def _dealt(ids: np.ndarray, counts: np.ndarray, model):
    """(shard, packed rows) of distinct rows of ids; their order is kept within a shard."""
    shard = shard_of(model.key(ids), model.shards, model.bits(ids.shape[1]))
    by = np.argsort(shard.astype(np.uint16), kind="stable")
    ids, counts = _take(ids, by), counts[:, by]
    cut = np.cumsum(np.bincount(shard, minlength=model.shards))
    for s in np.flatnonzero(np.diff(cut, prepend=0)).tolist():
        own = slice(cut[s - 1] if s else 0, cut[s])
        yield s, pack_rows(ids[own], counts[:, own])


def _batches(rows):
    """Batches of rows (shard, a) of some 4 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], _NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], _NAMES)


def _reduced(batches, stream, reduce):
    """``reduce`` of what ``stream`` makes of slices of texts, some ``HELD`` tokens at once."""
    held, n = [], 0
    for b in batches:
        for part in _text.slices(b):
            held.append(stream(part.column("text")))
            n += len(held[-1])
            if n >= HELD:
                yield from _batches(reduce(np.concatenate(held)))
                held, n = [], 0
    if n:
        yield from _batches(reduce(np.concatenate(held)))


def _count_words(shards: int):
    def reduce(token):
        word, n = np.unique(token, return_counts=True)
        for s, own in _cut(word, shards):
            yield s, pack_counts(n[own]) + word[own].tobytes()

    return lambda batches: _reduced(batches, lambda text: tokens_of(text)[0], reduce)


def _count_grams(model):
    order = model.order

    def stream(text):
        """48-bit words, with the start marks before each text."""
        token, count = tokens_of(text)
        out = np.full(len(token) + (order - 1) * len(count), BOS)
        out[np.arange(len(token)) + np.repeat((order - 1) * np.arange(1, len(count) + 1), count)] = token >> U(16)
        return out

    def reduce(words):
        """Distinct n-grams: numbers of the words at hand make n-grams that are sorted as plain numbers."""
        some, back = distinct(words)
        ids, bits = model.ids(some), max((len(some) - 1).bit_length(), 1)
        end = np.flatnonzero(words[order - 1 :] != BOS)
        if order * bits > 64:
            grams = np.array([ids[back[end + j]] for j in range(order)]).T
            _, n, at = _sum_by(model.key(grams), np.ones(len(grams), np.int64))
            grams = _take(grams, at)
        else:
            back = back.astype(U)
            code = np.zeros(len(words) - order + 1, U)
            for j in range(order):
                code <<= U(bits if j else 0)
                code |= back[j : j + len(code)]
            code = code[end]
            code.sort()
            first = _starts(code)
            code, n = code[first], np.diff(first, append=len(code))
            grams = np.array([ids[(code >> U(bits * (order - 1 - j)) & U((1 << bits) - 1)).view(np.int64)] for j in range(order)]).T
        yield from _dealt(grams, n[None], model)

    return lambda batches: _reduced(batches, stream, reduce)


def _grouped(batches):
    """(shard, its values) of batches sorted by shard."""
    now, rows = None, []
    for batch in batches:
        for s, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append(a)
    if rows:
        yield now, rows


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """One file of arrays, whole or not there: a repeated task replaces it by an equal one."""
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        head = repr([(x.dtype.str, x.shape) for x in arrays]).encode()
        f.write(np.int64(len(head)).tobytes() + head)
        for x in arrays:
            f.write(b"\0" * (-f.tell() % 8))
            f.write(np.ascontiguousarray(x).data)
    os.replace(own, f"{folder}/{name}")


def _load(folder: str, name: str) -> list[np.ndarray] | None:
    """The arrays of a file, mapped; none of one that is not there."""
    if not os.path.exists(f"{folder}/{name}"):
        return None
    raw = np.memmap(f"{folder}/{name}", np.uint8, "r").view(np.ndarray)
    at = 8 + int(raw[:8].view("<i8")[0])
    out = []
    for dtype, shape in literal_eval(raw[8:at].tobytes().decode()):
        at += -at % 8
        size = int(np.prod(shape)) * np.dtype(dtype).itemsize
        out.append(raw[at : at + size].view(dtype).reshape(shape))
        at += size
    return out


def code_counts(table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of counts as numbers of the commonest columns, in one byte or two; (numbers, those columns, places of others, others)."""
    wide = 60 // len(table)
    small = np.flatnonzero((table < 1 << wide).all(0))
    packed = np.zeros(len(small), np.int64)
    for row in table:
        packed = packed << wide | row[small]
    value, back, times = np.unique(packed, return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(value))
    number = np.full(table.shape[1], 1 << 16)
    number[small] = rank[back]
    most = 255 if 8 * (1 + len(table)) * int((number >= 255).sum()) <= len(number) else 65535
    number = np.minimum(number, most)
    over = np.flatnonzero(number == most)
    own = np.zeros((len(table), min(most, len(value))), np.int64)
    own[:, number[number < most]] = table[:, number < most]
    return number.astype(np.uint8 if most == 255 else np.uint16), own, over, table[:, over]


def counts_at(coded, at: np.ndarray) -> np.ndarray:
    """The columns at some places."""
    number, own, over, others = coded
    n = number[at].astype(np.int64)
    out = own[:, np.minimum(n, own.shape[1] - 1)] if own.shape[1] else np.zeros((len(own), len(n)), np.int64)
    rare = np.flatnonzero(n == np.iinfo(number.dtype).max)
    if len(rare):
        out[:, rare] = others[:, np.searchsorted(over, at[rare])]
    return out


def code_keys(key: np.ndarray, bits: int, shards: int) -> tuple[np.ndarray, ...]:
    """Sorted keys of a shard without their top bits: (first top, bits of top, starts of the tops, four bytes after the bits that the starts give back, two more or none).

    The starts are of as many tops as leave some ``BUCKET`` keys each; of keys
    of which more than four bytes are then left, two more are kept.
    """
    fine = min(max(int(len(key) * shards // BUCKET).bit_length() - 1, 1), bits - 1)
    rest = 32 if bits - fine <= 32 else 48
    fine = max(fine, bits - rest)
    top = (key >> U(bits - fine)).astype(np.int64)
    starts = np.searchsorted(top, np.arange(int(top[0]), int(top[-1]) + 2))
    low = key & U((1 << min(rest, bits)) - 1)
    some = np.array([top[0], bits - fine])
    starts = starts.astype(np.uint32 if len(key) < 1 << 32 else np.int64)
    if rest == 32:
        return some, starts, low.astype(np.uint32), np.zeros(0, np.uint16)
    return some, starts, (low >> U(16)).astype(np.uint32), (low & U(0xFFFF)).astype(np.uint16)


def find_keys(coded, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are there, their places) by binary search from the starts of their top bits."""
    (first, below), starts, high, low = coded
    top = (key >> U(int(below))).astype(np.int64) - first
    own = np.flatnonzero((top >= 0) & (top < len(starts) - 1))
    at, end = starts[top[own]].astype(np.int64), starts[top[own] + 1].astype(np.int64)
    want = key[own]
    if len(low):
        want, tail = (want >> U(16)).astype(np.uint32), want.astype(np.uint16)
    else:
        want = want.astype(np.uint32)
    last = len(high)
    for i in reversed(range(int((end - at).max(initial=0)).bit_length())):
        to = at + (1 << i)
        less = high[np.minimum(to, last) - 1] < want
        less &= to <= end
        at += less.astype(np.int64) << i
    there = np.flatnonzero(at < end)
    there = there[high[at[there]] == want[there]]
    if len(low):
        on = there  # keys alike in the first four bytes are told apart by the rest
        while len(on):
            on = on[low[at[on]] < tail[on]]
            at[on] += 1
            on = on[at[on] < end[on]]
            on = on[high[at[on]] == want[on]]
        there = there[at[there] < end[there]]
        there = there[(high[at[there]] == want[there]) & (low[at[there]] == tail[there])]
    return own[there], at[there]


_SUMS = "level long, n1 long, n2 long, n3 long, n4 long, distinct_n long, total_n long"


def _sums(*rows: tuple[int, np.ndarray]) -> pa.RecordBatch:
    """Of levels and their counts: counts of counts, distinct n-grams and the sum."""
    out = [(level, *((n == i).sum() for i in (1, 2, 3, 4)), (n > 0).sum(), n.sum()) for level, n in rows]
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], [f.split()[0] for f in _SUMS.split(", ")])


def _words(folder: str):
    """Writes a shard of words with their counts; gives its sums, and its size as the total of level -1 - shard."""

    def run(batches):
        for s, rows in _grouped(batches):
            ends = [len(r) - 8 * int(np.frombuffer(r, "<i8", 1)[0]) for r in rows]
            word, n, _ = _sum_by(np.concatenate([np.frombuffer(r[e:], U) for r, e in zip(rows, ends, strict=True)]), np.concatenate([unpack_counts(r[:e]) for r, e in zip(rows, ends, strict=True)]))
            _save(folder, f"word-{s}", word, *code_counts(n[None]))
            yield _sums((0, n), (-1 - s, np.array([len(word)])))

    return run


def _level(model, level: int):
    """Writes a shard of n-grams of ``level`` words, with their sums as contexts, and what the level below needs of it."""
    folder, shards, bits = model.folder, model.shards, model.bits(level)

    def one(s, grams, contexts):
        grams, count = _unpacked(grams, level, 1)
        key, n, at = _sum_by(model.key(grams), count[0])
        grams = _take(grams, at)
        del count, at
        context, sums = _unpacked(contexts, level, 4)
        context, *sums, _ = _sum_by(model.key(context), *sums)
        every = key
        if len(context):
            every = np.concatenate([key, context])
            every.sort(kind="stable")  # merges the two
            every = every[_starts(every)]
        if not len(every):
            return
        table = np.zeros((5 if len(context) else 1, len(every)), np.int64)
        table[0, np.searchsorted(every, key)] = n
        if len(context):
            table[1:, np.searchsorted(every, context)] = sums
        _save(folder, f"gram{level}-{s}", *code_keys(every, bits, shards), *code_counts(table))
        del table, every, context, sums
        if level > 1 and len(grams):
            down = [_parts(grams[:, :-1], n, model), _parts(grams[:, 1:], None, model)]
            ends = np.cumsum([0, *(len(x) for d in down for x in d)])
            _save(f"{folder}/{level}", f"down-{s}", ends, np.frombuffer(b"".join(x for d in down for x in d), np.uint8))
        yield _sums((level, n))

    def dealt(batches):
        for s, grams in _grouped(batches):
            yield from one(s, grams, [])

    def passed(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                parts = ([], [])
                for t in range(shards):
                    have = _load(f"{folder}/{level + 1}", f"down-{t}")
                    for i in (0, 1) if have else ():
                        lo, hi = have[0][i * shards + s : i * shards + s + 2].tolist()
                        if lo < hi:
                            parts[i].append(have[1][lo:hi].tobytes())
                yield from one(s, parts[1], parts[0])

    return dealt if level == model.order else passed


def _parts(ids: np.ndarray, n: np.ndarray | None, model) -> list[bytes]:
    """Packed rows, for every shard, of the distinct rows of ids: with sums of ``n`` as of contexts, else how often each is there."""
    by = model.packed(ids)
    order = in_order(by)
    first = _starts(by[order])
    if n is None:
        sums = np.diff(first, append=len(order))[None]
    else:
        n = n[order]
        seen = np.minimum(n, 3)
        sums = np.array([np.add.reduceat(x, first, dtype=np.int64) for x in (n, seen == 1, seen == 2, seen == 3)])
        del n, seen
    out = [b""] * model.shards
    for s, rows in _dealt(_take(ids, order[first]), sums, model):
        out[s] = rows
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; counts of counts of zero fall back to 0.5, 1, 1.5, each below its count."""
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), k - 1e-3) for d, k in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))


class Model:
    """The folder of arrays with the model's totals; cheap to send to workers, which map the arrays on use.

    ``sizes`` are the words of each shard. A word's id is its place among all of
    them. ``settle`` takes for each level, and 0 for words: counts of counts 1 to
    4, distinct n-grams and the sum of their counts.
    """

    def __init__(self, folder: str, shards: int, order: int, sizes: list[int], n_tokens: int):
        self.folder, self.shards, self.order = folder, shards, order
        self.vocabulary, self.n_tokens = sum(sizes), n_tokens
        self.first = np.cumsum([FIRST + U(2), *sizes[:-1]]).astype(U)
        self.id_bits = (self.vocabulary + 1).bit_length()
        self._maps: dict[str, list[np.ndarray] | None] = {}

    def settle(self, totals: dict[int, tuple]) -> None:
        self.cuts = {k: discounts(*totals.get(k, (0,) * 6)[:4]) for k in range(1, self.order + 1)}
        n1, n2, _, _, distinct, self.base = totals.get(1, (0,) * 6)
        d = self.cuts[1]
        self.spare = (d[0] * n1 + d[1] * n2 + d[2] * (distinct - n1 - n2)) / self.base if self.base else 1.0

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def _map(self, name: str):
        if name not in self._maps:
            self._maps[name] = _load(self.folder, name)
        return self._maps[name]

    def bits(self, level: int) -> int:
        """Of a key of ``level`` words."""
        return min(max(level * self.id_bits, 32), 64)

    def packed(self, ids: np.ndarray) -> np.ndarray:
        """The bits of each row of ids where they are 64 at most, in the order of ids; else 64 bits of hash."""
        level = ids.shape[1]
        if level * self.id_bits > 64:
            key = np.full(len(ids), U(level))
            for j in range(level):
                key = _text.mix(key * U(0x9E3779B97F4A7C15) + ids[:, j])
            return key
        key = np.zeros(len(ids), U)
        for j in range(level):
            key = key << U(self.id_bits if j else 0) | ids[:, j]
        return key

    def key(self, ids: np.ndarray) -> np.ndarray:
        """A key of each row of ids: their bits, scrambled, where they are 64 at most; else 64 bits of hash."""
        level, key = ids.shape[1], self.packed(ids)
        return key if level * self.id_bits > 64 else scramble(key, self.bits(level))

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Ids of 48-bit words."""
        some, back = distinct(words.reshape(-1))
        out = np.where(some == BOS, FIRST, UNKNOWN)
        for s, own in _cut(some << U(16), self.shards):
            have = self._map(f"word-{s}")
            if have is not None:
                at = np.minimum(np.searchsorted(have[0], some[own] << U(16)), len(have[0]) - 1)
                out[own] = np.where(have[0][at] >> U(16) == some[own], at.astype(U) + self.first[s], out[own])
        return out[back].reshape(words.shape)

    def grams(self, level: int, ids: np.ndarray, rows: int) -> np.ndarray:
        """Count, and as a context total and continuations seen once, twice and oftener, of rows of ids."""
        key, back = distinct(self.key(ids))
        out = np.zeros((rows, len(key)), np.int64)
        for s, own in _cut(key, self.shards, self.bits(level)):
            have = self._map(f"gram{level}-{s}")
            if have is not None:
                which, at = find_keys(have[:4], key[own])
                n = counts_at(have[4:], at)[:rows]
                out[: len(n), own.start + which] = n
        return out[:, back]

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        """Occurrences of 64-bit words in training."""
        some, back = distinct(words)
        out = np.zeros(len(some), np.int64)
        for s, own in _cut(some, self.shards):
            have = self._map(f"word-{s}")
            if have is not None:
                at = np.minimum(np.searchsorted(have[0], some[own]), len(have[0]) - 1)
                out[own] = np.where(have[0][at] == some[own], counts_at(have[1:], at)[0], 0)
        return out[back]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each row's last word after the others; 48-bit words."""
        ids, levels = self.ids(grams), range(1, self.order + 1)
        return self._mixed([self.grams(k, ids[:, -k:], 1)[0] for k in levels], [self.grams(k, ids[:, -k - 1 : -1], 5)[1:] for k in levels[:-1]])

    def log10_of_texts(self, some: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The same of every token of texts of ``count`` tokens, which are the 48-bit words ``some[back]``.

        The context of a token's n-gram is the n-gram of the token before, or start marks: each is looked up once.
        """
        n, ids = len(back), self.ids(some)
        before = np.arange(n) - 1
        before[(np.cumsum(count) - count)[count > 0]] = n
        grams = np.concatenate([windows(ids[back], count, self.order, FIRST), np.full((1, self.order), FIRST)])
        single = self.grams(1, np.append(ids, FIRST)[:, None], 5)[:, np.append(back, len(ids))]
        found = [single, *(self.grams(k, grams[:, -k:], 5 if k < self.order else 1) for k in range(2, self.order + 1))]
        return self._mixed([f[0, :n] for f in found], [f[1:, before] for f in found[:-1]])

    def _mixed(self, counts: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log10 of probabilities by the counts of n-grams of each level and the sums of the contexts of the next."""
        if not self.n_tokens:
            return np.zeros(len(counts[0]))
        cut = lambda k, n: np.maximum(n - np.array([0.0, *self.cuts[k]])[np.minimum(n, 3)], 0.0)
        p = cut(1, counts[0]) / self.base + self.spare / (self.vocabulary + 1)
        for k, n, (total, n1, n2, n3) in zip(range(2, self.order + 1), counts[1:], contexts, strict=True):
            d = self.cuts[k]
            p = np.where(total > 0, (cut(k, n) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p) / np.maximum(total, 1), p)
        return np.log10(p)


def _totalled(sums: DataFrame) -> dict[int, tuple]:
    """Sums by level."""
    out: dict[int, np.ndarray] = {}
    for level, *n in sums.collect():
        out[level] = out.get(level, 0) + np.array(n)
    return {level: tuple(n.tolist()) for level, n in out.items()}


def _gathered(rows: DataFrame, tasks: int, f) -> dict[int, tuple]:
    return _totalled(_shared.map_arrow(rows.repartition(tasks, "shard").sortWithinPartitions("shard"), f, _SUMS))


def train(docs: DataFrame, order: int = ORDER, shards: int | None = None) -> Model:
    """Count every text of ``docs`` and write the arrays to the shared folder."""
    spark = docs.sparkSession
    tasks = _shared.n_partitions(spark)
    shards = min(shards or tasks, 1 << 15)
    folder = _shared.posix_path(_shared.work_path(spark, "kneser"))
    for level in range(order + 1):
        os.makedirs(f"{folder}/{level}", exist_ok=True)
    totals = _gathered(_shared.map_arrow(docs.select("text"), _count_words(shards), _ROWS), tasks, _words(folder))
    _shared.release_exchanges(spark)
    model = Model(folder, shards, order, [totals.get(-1 - s, (0,) * 6)[-1] for s in range(shards)], totals.get(0, (0,) * 6)[-1])
    totals |= _gathered(_shared.map_arrow(docs.select("text"), _count_grams(model), _ROWS), tasks, _level(model, order))
    _shared.release_exchanges(spark)
    for level in range(order - 1, 0, -1):
        totals |= _totalled(_shared.map_arrow(spark.range(0, shards, 1, shards), _level(model, level), _SUMS))
        shutil.rmtree(f"{folder}/{level + 1}")
    model.settle(totals)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        m = shared.value
        for b in batches:
            for part in _text.slices(b, most=1 << 21):
                token, count = tokens_of(part.column("text"))
                doc = np.repeat(np.arange(part.num_rows), count)
                some, back = distinct(token)
                p, c = m.log10_of_texts(some >> U(16), back, count), m.word_counts(some)[back]
                base = np.log10((c + 0.5) / (m.n_tokens + 0.5 * (m.vocabulary + 1)))
                per = lambda x, n=part.num_rows, doc=doc: np.bincount(doc, x, n)
                columns = [part.column("doc_id"), pa.array(per(np.ones(len(doc))).astype(np.int64)), pa.array(per(c > 0).astype(np.int64)), pa.array(np.full(part.num_rows, m.n_tokens, np.int64)), pa.array(per(base)), pa.array(per(p))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in names.split(", ")])

    return _shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, names)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(fold(5) == 1, F.lit(False))
    model = train(docs.where(~held))
    scored = score(docs, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
