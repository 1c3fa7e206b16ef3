"""Removal of repeated passages with sharded suffix arrays.

A byte goes if some string of ``LEAST`` bytes that covers it also starts in a
document of a smaller id. Matches never cross documents and are judged on the
input.

1. Every window of ``LEAST`` bytes is represented by its minimizer, the k-gram of
   least hash in it, so equal windows have equal minimizers at equal offsets and
   the windows of one minimizer are a run. A document's minimizers are its anchors.
2. Anchors are compared by hash across documents; those in two texts or more are
   shared. Each task answers what it can see itself and sends at most two rows
   per anchor hash, so a passage in a third of all documents is no large group.
3. The runs of windows of shared anchors are sent, as segments of text, to the
   shard of the anchor. A shard builds the suffix array of its distinct segments
   by induced sorting, groups the windows whose common prefix is ``LEAST`` or
   longer, and marks those of which a smaller document has an equal one.
   Equal segments are carried for their smallest document only, as far back as
   the task that cuts them; the others are removed with it.
4. The marked intervals meet their texts again and are cut out.

Texts travel compressed, twice. Texts equal as a whole are compared by
fingerprint first and count as one text for step 2. A row is addressed by a hash
of its id and text (``row``), so rows of one id with different texts are judged
one by one.

Defined cases: a null or empty text has nothing to remove; texts below ``LEAST``
bytes lose nothing; rows of one id never remove each other, and each loses what
rows of smaller ids have; a row of null id neither removes nor loses anything;
extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text
from .induced import equal_windows, suffix_array

U = np.uint64
LEAST, GRAM = 50, 20
HELD, TURN_BYTES = 1 << 20, 1 << 20
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)

ROW = "slot int, kind int, a binary, b binary, c binary"
#: kinds of rows; at one slot they are read in this order
COPY, SHARED, CUT, TEXT, ANCHOR, SEGMENT = range(6)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["slot", "kind", "a", "b", "c"])


def _slot(x: np.ndarray, slots: int) -> np.ndarray:
    """The slot of an id or hash; mixed first, as an anchor is the least hash of its window and so small."""
    return ((_text.mix(x.astype(U)) >> U(32)) * U(slots) >> U(32)).astype(np.int64)


def _by_slot(slot: np.ndarray, slots: int):
    order = np.argsort(slot, kind="stable")
    cut = np.searchsorted(slot[order], np.arange(slots + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), order[cut[s] : cut[s + 1]]


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


class Sums:
    """Polynomial hashes of all substrings of ``raw``."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * _text.powers(_BASE, n), out=self.sums[1:])
        self.inverse = _text.powers(_INVERSE, n) if n else np.zeros(0, U)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _text.mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(U))


def anchors(raw: np.ndarray, offsets: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, first window, last window) of all anchors, in text order."""
    none = (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n, width = len(raw), LEAST - GRAM + 1
    if n < LEAST:
        return none
    at = np.arange(n - GRAM + 1)
    h = _text.mix((sums.sums[GRAM:] - sums.sums[: n - GRAM + 1]) * sums.inverse[: n - GRAM + 1])
    low = U(32)  # whatever the length of ``raw``: a window's choice depends on its bytes alone
    best = h >> low << low | at.astype(U)  # ties go to the leftmost
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if width > span:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    place = (best & ((U(1) << low) - U(1))).astype(np.int64)  # of the window that starts here
    size = np.diff(offsets)
    whole = np.maximum(size - LEAST + 1, 0)
    doc = np.repeat(np.arange(len(size)), whole)
    start = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(offsets[:-1], whole)
    if not len(start):
        return none
    place = place[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    return doc[first], h[place[first]], start[first], start[last]


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where they are not null)"""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~column.is_null().to_numpy(zero_copy_only=False)


def _ordinals(doc: np.ndarray) -> np.ndarray:
    """Each anchor's number in its document."""
    first = _firsts(doc)
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def _shared_rows(row: np.ndarray, ordinal: np.ndarray, slots: int) -> list[tuple]:
    return [(s, SHARED, row[at].tobytes(), ordinal[at].astype("<u4").tobytes(), b"") for s, at in _by_slot(_slot(row, slots), slots)]


def _anchor_rows(slots: int):
    """Anchors for comparison; those shared among the texts of one task are answered here."""

    def reduced(row, prints, ordinals, keys):
        row, prints, ordinals, keys = map(np.concatenate, (row, prints, ordinals, keys))
        order = np.lexsort((prints, keys))
        row, prints, ordinals, keys = row[order], prints[order], ordinals[order], keys[order]
        first = _firsts(keys)
        if not len(first):
            return []
        size = np.diff(np.append(first, len(keys)))
        own = np.repeat(prints[first] != prints[first + size - 1], size)
        out = _shared_rows(row[own], ordinals[own], slots)
        # Of what is answered, two rows without an address tell the others.
        tell = np.zeros(len(keys), bool)
        tell[first] = tell[first + size - 1] = True
        send = ~own | tell
        where = np.where(own, np.iinfo(np.int64).min, row)[send]
        keys, prints, ordinals = keys[send], prints[send], ordinals[send]
        for s, at in _by_slot(_slot(keys, slots), slots):
            at = at[np.argsort(where[at], kind="stable")]
            text = _firsts(where[at])  # addresses once for all their anchors
            told = where[at][text], np.diff(np.append(text, len(at)))
            same = np.concatenate([told[0].astype("<i8").view(np.uint8), told[1].astype("<u4").view(np.uint8)]).tobytes()
            out.append((s, ANCHOR, same, (keys[at] & U(0xFFFFFFFF)).astype("<u4").tobytes(), np.concatenate([(prints[at] & U(0xFFFFFFFF)).astype("<u4"), ordinals[at].astype("<u4")]).tobytes()))
        return out

    def run(batches):
        held, size = ([], [], [], []), 0
        for b in batches:
            for part in _text.slices(b):
                raw, at = _text.utf8(part.column("text"))
                _, known = _ids(part.column("doc_id"))
                row = part.column("row").to_numpy()
                sums = Sums(raw)
                doc, key, _, _ = anchors(raw, at, sums)
                if not len(doc):
                    continue
                prints = np.zeros(part.num_rows, U)
                some = np.flatnonzero(np.diff(at))
                prints[some] = sums.of(at[:-1][some], at[1:][some])
                ordinal, keep = _ordinals(doc), known[doc]
                for h, x in zip(held, (row[doc], prints[doc], ordinal, key), strict=True):
                    h.append(x[keep])
                size += len(raw)
                if size >= 8 * HELD:
                    yield _rows(reduced(*held))
                    held, size = ([], [], [], []), 0
        if size:
            yield _rows(reduced(*held))

    return run


def _by_group(batches):
    """(slot, rows) of batches sorted by slot; a row is (kind, a, b, c)."""
    now, rows = None, []
    for b in batches:
        for s, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append(row)
    if rows:
        yield now, rows


def _compare(slots: int):
    """Which anchors are in two texts or more: SHARED rows."""

    def run(batches):
        for s, rows in _by_group(batches):
            out = [(s, *r) for r in rows if r[0] == SHARED]
            row, keys, prints, ordinals = [], [], [], []
            for _, a, b, c in (r for r in rows if r[0] == ANCHOR):
                m = len(a) // 12
                row.append(np.repeat(np.frombuffer(a[: 8 * m], "<i8"), np.frombuffer(a[8 * m :], "<u4")))
                keys.append(np.frombuffer(b, "<u4"))
                both = np.frombuffer(c, "<u4")
                prints.append(both[: len(both) // 2])
                ordinals.append(both[len(both) // 2 :])
            if row:
                row, keys, prints, ordinals = map(np.concatenate, (row, keys, prints, ordinals))
                order = np.argsort(keys, kind="stable")
                row, keys, prints, ordinals = row[order], keys[order], prints[order], ordinals[order]
                first = _firsts(keys)
                size = np.diff(np.append(first, len(keys)))
                met = np.repeat(np.minimum.reduceat(prints, first) != np.maximum.reduceat(prints, first), size) & (row != np.iinfo(np.int64).min)
                out += _shared_rows(row[met], ordinals[met].astype(np.int64), slots)
            if out:
                yield _rows(out)

    return run


def _text_rows(slots: int):
    """Texts by the slot of their row, compressed."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for part in _text.slices(b, most=4 * HELD):
                raw, at = _text.utf8(part.column("text"))
                ids, known = _ids(part.column("doc_id"))
                row = part.column("row").to_numpy()
                out = []
                for s, own in _by_slot(_slot(row, slots), slots):
                    texts = b"".join(raw[at[i] : at[i + 1]].tobytes() for i in own)
                    sizes = np.where(known[own], np.diff(at)[own], -1 - np.diff(at)[own])  # a null id shows in the sign
                    out.append((s, TEXT, np.stack([ids[own], row[own]]).tobytes(), sizes.astype("<i8").tobytes(), packer.compress(texts)))
                yield _rows(out)

    return run


def _texts(packed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, known, offsets, bytes) of a TEXT row."""
    _, a, b, c = packed
    size = np.frombuffer(b, "<i8")
    known = size >= 0
    size = np.where(known, size, -1 - size)
    ids, row = np.frombuffer(a, "<i8").reshape(2, -1)
    return ids, row, known, np.concatenate([[0], np.cumsum(size)]), np.frombuffer(zstandard.ZstdDecompressor().decompress(c, max_output_size=max(1, int(size.sum()))), np.uint8)


def _collapse(prints: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments: those of the smallest id for each print, and those that repeat one of a smaller id."""
    order = np.lexsort((ids, prints))
    first = _firsts(prints[order])
    least = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
    return order[ids[order] == least], order[ids[order] > least]


def _cut_rows(row: np.ndarray, start: np.ndarray, end: np.ndarray, slots: int) -> list[tuple]:
    return [(s, CUT, row[at].tobytes(), start[at].astype("<i8").tobytes(), end[at].astype("<i8").tobytes()) for s, at in _by_slot(_slot(row, slots), slots)]


def _segment_rows(slots: int):
    """Segments of the shared anchors of a slot's texts, by the shard of the anchor."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)  # segments overlap
        for _, rows in _by_group(batches):
            wanted = [r for r in rows if r[0] == SHARED]
            if not wanted:
                continue
            want_row = np.concatenate([np.frombuffer(r[1], "<i8") for r in wanted])
            want_at = np.concatenate([np.frombuffer(r[2], "<u4") for r in wanted]).astype(np.int64)
            order = np.lexsort((want_at, want_row))
            want_row, want_at = want_row[order], want_at[order]
            some, wide = np.unique(want_row), int(want_at.max()) + 2
            pairs = np.searchsorted(some, want_row) * wide + want_at  # (row, ordinal) as one number
            del wanted, order, want_row, want_at
            held = {}
            for packed in (r for r in rows if r[0] == TEXT):
                ids, row, known, at, raw = _texts(packed)
                rank_of = np.minimum(np.searchsorted(some, row), len(some) - 1)
                has = known & (some[rank_of] == row)
                if not has.any():
                    continue
                sums = Sums(raw)
                doc, key, lo, hi = anchors(raw, at, sums)
                ordinal, keep = _ordinals(doc), has[doc]
                doc, key, lo, hi, ordinal = doc[keep], key[keep], lo[keep], hi[keep] + LEAST, ordinal[keep]
                asked = rank_of[doc] * wide + np.minimum(ordinal, wide - 1)
                found = pairs[np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)] == asked
                doc, key, lo, hi = doc[found], key[found], lo[found], hi[found]
                for name, x in (("id", ids[doc]), ("row", row[doc]), ("start", lo - at[doc]), ("size", hi - lo), ("print", sums.of(lo, hi)), ("key", key)):
                    held.setdefault(name, []).append(x)
                held.setdefault("raw", []).append((raw, lo, hi))
            if not held:
                continue
            del pairs, rows
            texts = held.pop("raw")
            col = {k: np.concatenate(held.pop(k)) for k in ("id", "row", "start", "size", "print", "key")}
            chunk = np.concatenate([np.full(len(x[1]), i, np.int32) for i, x in enumerate(texts)])
            los = np.concatenate([x[1] for x in texts])
            one, again = _collapse(col["print"], col["id"])
            yield _rows(_cut_rows(col["row"][again], col["start"][again], col["start"][again] + col["size"][again], slots))
            out, size = [], 0
            shard = _slot(col["key"][one], slots)
            for s, at in _by_slot(shard, slots):
                own = one[at]
                _, text_of = np.unique(col["print"][own], return_index=True)  # a text that its document repeats is sent once
                text = b"".join(texts[chunk[i]][0][los[i] : los[i] + col["size"][i]].tobytes() for i in own[text_of])
                head = packed_head(col["id"][own], col["row"][own], col["print"][own], col["start"][own], col["key"][own], col["size"][own])
                out.append((s, SEGMENT, head, packer.compress(text), b""))
                size += len(head) + len(out[-1][3])
                if size >= HELD:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return run


#: columns of a segment: id, row, print, start in the text (below 4 GB), anchor (32 bits: groups that meet by chance are sorted together), size
_HEAD = ("<i8", "<i8", "<u8", "<u4", "<u4", "<u2")


def packed_head(*columns: np.ndarray) -> bytes:
    return b"".join((x & np.array(0xFFFFFFFF, x.dtype) if t == "<u4" else x).astype(t).tobytes() for x, t in zip(columns, _HEAD, strict=True))


def head_of(b: bytes) -> list[np.ndarray]:
    n, at, out = len(b) // sum(np.dtype(t).itemsize for t in _HEAD), 0, []
    for t in _HEAD:
        out.append(np.frombuffer(b, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def repeated_windows(ids: np.ndarray, size: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the bytes of segments that windows of smaller ids' segments repeat."""
    at = np.concatenate([[0], np.cumsum(size + 1)])
    t = np.ones(at[-1] + 1, np.int32)
    inside = np.arange(at[-1] + 1)
    owner = np.repeat(np.arange(len(size)), size + 1)
    body = inside[:-1] - at[owner] < size[owner]
    t[:-1][body] = raw.astype(np.int32) + 2
    t[-1] = 0
    flat = np.zeros(len(t), np.uint8)
    flat[:-1][body] = raw
    valid = np.zeros(len(t), bool)
    valid[:-1] = inside[:-1] - at[owner] <= size[owner] - LEAST
    order, first = equal_windows(flat, suffix_array(t, 258), valid, LEAST)
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    group = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(ids[owner[order]], group), np.diff(np.append(group, len(order))))
    hit = np.sort(order[least < ids[owner[order]]])
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    begin = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
    a, b = hit[begin], hit[np.append(begin[1:], True)]
    return owner[a], a - at[owner[a]], b - at[owner[a]] + LEAST


def _shards(slots: int):
    """CUT rows of a shard's segments; those found before go through."""

    def run(batches):
        for s, rows in _by_group(batches):
            through = [(s, *r) for r in rows if r[0] == CUT]
            if through:
                yield _rows(through)
            own = [r for r in rows if r[0] == SEGMENT]
            if not own:
                continue
            unpacker = zstandard.ZstdDecompressor()
            heads, known, sizes, raws = [], [], [], []
            for _, a, b, _ in own:
                heads.append(head_of(a))
                own_prints, first = np.unique(heads[-1][2], return_index=True)
                known.append(own_prints)
                sizes.append(heads[-1][5][first].astype(np.int64))
                raws.append(np.frombuffer(unpacker.decompress(b, max_output_size=int(sizes[-1].sum())), np.uint8))
            del own, rows
            # Where the text of each print begins; several rows may bring it.
            known, lie = np.concatenate(known), np.concatenate([[0], np.cumsum(np.concatenate(sizes))[:-1]])
            texts = np.concatenate(raws)
            known, first = np.unique(known, return_index=True)
            lie = lie[first]
            del raws
            ids, row, prints, start, keys, size = (np.concatenate(x) for x in zip(*heads, strict=True))
            del heads
            start, size = start.astype(np.int64), size.astype(np.int64)
            one, again = _collapse(prints, ids)
            yield _rows(_cut_rows(row[again], start[again], start[again] + size[again], slots))
            # Distinct texts by anchor; equal windows have one anchor, so anchors can be sorted in turns.
            one = one[np.lexsort((prints[one], keys[one]))]
            lead = _firsts(prints[one])
            count = np.diff(np.append(lead, len(one)))
            turn, held = [0], 0
            for i, (k, n) in enumerate(zip(keys[one[lead]].tolist(), size[one[lead]].tolist(), strict=True)):
                if held > TURN_BYTES and k != before:
                    turn.append(i)
                    held = 0
                held, before = held + n, k
            for x, y in zip(turn, [*turn[1:], len(lead)], strict=True):
                rep = one[lead[x:y]]
                ends = np.cumsum(size[rep])
                raw = texts[np.arange(ends[-1]) + np.repeat(lie[np.searchsorted(known, prints[rep])] - ends + size[rep], size[rep])]
                seg, a, b = repeated_windows(ids[rep], size[rep], raw)
                # What holds for a text holds wherever its document has it.
                times = count[x + seg]
                at = one[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lead[x + seg], times)]
                yield _rows(_cut_rows(row[at], start[at] + np.repeat(a, times), start[at] + np.repeat(b, times), slots))

    return run


RESULT = "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _kept(with_text: bool):
    """Texts without their cuts; as ``kept``, if asked for, a text from which a character cut in two is gone whole."""

    def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(a, kind="stable")
        a, far = a[order], np.maximum.accumulate(b[order])
        begin = np.concatenate([[True], a[1:] > far[:-1]])
        return a[begin], far[np.append(begin[1:], True)]

    def run(batches):
        names = [f.split()[0] for f in RESULT.split(", ")]
        for _, rows in _by_group(batches):
            cuts = [r for r in rows if r[0] == CUT]
            join = lambda i, cuts=cuts: np.concatenate([np.frombuffer(r[i], "<i8") for r in cuts]) if cuts else np.zeros(0, np.int64)
            cut_row, start, end = join(1), join(2), join(3)
            order = np.argsort(cut_row, kind="stable")
            cut_row, start, end = cut_row[order], start[order], end[order]
            copies = np.unique(np.concatenate([np.frombuffer(r[1], "<i8") for r in rows if r[0] == COPY] or [np.zeros(0, np.int64)]))
            for packed in (r for r in rows if r[0] == TEXT):
                ids, row, known, at, raw = _texts(packed)
                out = []
                for i in range(len(ids)):
                    text = raw[at[i] : at[i + 1]]
                    lo, hi = np.searchsorted(cut_row, row[i]), np.searchsorted(cut_row, row[i], "right")
                    n, removed, spans = len(text), 0, 0
                    if known[i] and n >= LEAST and len(copies) and copies[min(np.searchsorted(copies, row[i]), len(copies) - 1)] == row[i]:
                        kept, removed, spans = b"", n, 1
                    elif known[i] and hi > lo:
                        a, b = merged(start[lo:hi], end[lo:hi])
                        removed, spans = int((b - a).sum()), len(a)
                        kept = b"".join(text[x:y].tobytes() for x, y in zip([0, *b.tolist()], [*a.tolist(), n], strict=True))
                    else:
                        kept = text.tobytes()
                    out.append((int(ids[i]) if known[i] else None, int(row[i]), n, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                types = (pa.int64(),) * 5 + (pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return run


def row_key():
    """The address of a row: a hash of its id and text. Rows of one address are alike in both."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, row (``row_key``), n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` for every row."""
    spark = docs.sparkSession
    tasks = _shared.n_partitions(spark)
    slots = tasks
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row"))
    deal = lambda df: df.repartition(tasks, "slot").sortWithinPartitions("slot", "kind")

    # Rows that repeat the whole text of a smaller id, by fingerprint; the ids are all that moves.
    prints = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LEAST)).select("doc_id", "row", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), F.octet_length("text").alias("n"))
    least = prints.groupBy("x", "y", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last"))
    copies = prints.join(least, ["x", "y", "n"]).where(F.col("doc_id") > F.col("first")).select("row")

    def copy_rows(batches):
        for b in batches:
            row = b.column("row").to_numpy()
            yield _rows([(s, COPY, row[at].tobytes(), b"", b"") for s, at in _by_slot(_slot(row, slots), slots)])

    shared = _shared.map_arrow(deal(_shared.map_arrow(docs, _anchor_rows(slots), ROW)), _compare(slots), ROW)
    shared = _shared.materialize(shared, "anchors", release=True)
    segments = _shared.map_arrow(deal(shared.unionByName(_shared.map_arrow(docs, _text_rows(slots), ROW))), _segment_rows(slots), ROW)
    cuts = _shared.materialize(_shared.map_arrow(deal(segments), _shards(slots), ROW), "cuts", release=True)
    last = cuts.unionByName(_shared.map_arrow(copies, copy_rows, ROW)).unionByName(_shared.map_arrow(docs, _text_rows(slots), ROW))
    out = _shared.map_arrow(deal(last), _kept(with_text), RESULT)
    return out if with_text else out.drop("kept")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
