"""Exact n-gram Jaccard join with signature trees, and its connected components.

1. One pass reduces every text to features: size and fingerprint of its shingle
   set, min-hashes, a token bitmap, and the shingles that are frequent in a
   slice of texts (their counts are summed over all slices).
2. Texts of one shingle set become one class, named by its smallest id.
3. Stars: classes that share a min-hash are compared with the smallest id of
   that group, and verified links are contracted. This is an accelerator: large
   groups of near copies become one component for the price of their size.
4. Every text emits the prefix of its shingles that any partner must meet
   (rare first, so that a common passage is in few prefixes); of the smaller of
   two sets, the partner must meet a shorter one, so rows without a partner of
   fitting size and place go at once. Shingles met by two components form blocks.
   A block becomes a signature tree: nodes hold the OR (and AND) of token bitmaps
   and the range of set sizes, and a dual traversal drops node pairs by the
   largest overlap they could have. A large component met by others is a block of
   its own, once for all shingles; its texts come along and are verified there, so
   that its size adds no candidate rows. Blocks beyond ``CHUNK`` rows are split
   into parts.
5. Surviving pairs of different components are verified on the full sets, for
   each component the likeliest first, and those that the links found put into one
   component no more.

The prefix bound and both tree bounds are necessary conditions of a link, so no
link between components is lost; within a component links add nothing.

Defined cases: a null or empty text has no shingles and is linked with nothing;
a text of fewer than five words has one shingle, its words; a null id has a null
component; rows of one id are one node; extra columns are dropped; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text
from .components import components

U = np.uint64
NUM, DEN = 3, 4  # links: DEN * intersection >= NUM * union
HASHES, AGREE = 6, 3
NARROW, WIDE = 256, 1 << 17  # bits of a bitmap: the power of two from twice the size of the set, within these
HOT_LOCAL, HOT_LEAST, HOT_MOST, HOT_SLICES = 2, 32, 1 << 21, 32
LEAF, FANOUT, CHUNK, APART, STAR_ROWS = 64, 4, 2048, 4, 2000
SHINGLES = 1 << 20  # of a part of a component's block
LINKED = -1  # in place of a candidate's largest overlap
MARKS = 1 << 20
TURNS, CROWD, FEW, PAIRS = 4, 1, 0.1, 2000

_FEATURES = "doc_id long, n int, fp1 long, fp2 long, mh array<long>, bits binary, token long, seen long"


def _schema(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of ``n``."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), NARROW, WIDE)


def _features(k: int):
    salts = _text.mix(np.arange(1, HASHES + 1).astype(U)) | U(1)
    none = lambda t, m: pa.nulls(m, t)

    def frequent(held):
        value, count = np.unique(np.concatenate(held), return_counts=True)
        common = count >= HOT_LOCAL
        hot, times, m = value[common].view(np.int64), count[common], int(common.sum())
        return pa.RecordBatch.from_arrays([none(pa.int64(), m), none(pa.int32(), m), none(pa.int64(), m), none(pa.int64(), m), none(pa.list_(pa.int64()), m), none(pa.binary(), m), pa.array(hot), pa.array(times.astype(np.int64))], _schema(_FEATURES))

    def run(batches):
        held = []
        for b in batches:
            for part in _text.slices(b):
                h, at = _text.shingles(_text.Words(part.column("text")), k)
                n = np.diff(at)
                some = np.flatnonzero(n)
                starts = at[:-1][some]
                rows = part.num_rows
                fp = np.zeros((2, rows), U)
                mh = np.zeros((rows, HASHES), U)
                bits = np.concatenate([[0], np.cumsum(width(n))])
                on = np.zeros(bits[-1], bool)
                if len(some):
                    for i in (0, 1):
                        fp[i, some] = np.add.reduceat(_text.mix(h ^ U(0xABCD + i)), starts)
                    for i, s in enumerate(salts):
                        mh[some, i] = np.minimum.reduceat(_text.mix(h * s), starts)
                    owner = np.repeat(np.arange(rows), n)
                    on[bits[owner] + ((h >> U(20)).astype(np.int64) & (width(n)[owner] - 1))] = True
                    held.append(h)
                mh_rows = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * HASHES), pa.array(mh.reshape(-1).view(np.int64)))
                raw = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((bits // 8).astype(np.int32)), pa.py_buffer(np.packbits(on))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), mh_rows, raw, none(pa.int64(), rows), none(pa.int64(), rows)], _schema(_FEATURES))
                if len(held) >= HOT_SLICES:
                    yield frequent(held)
                    held = []
        if held:
            yield frequent(held)

    return run


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many of the first shingles of a set of ``n`` any linked set must meet."""
    return n - -(-NUM * n // DEN) + 1


def lead_length(n: np.ndarray) -> np.ndarray:
    """The same for linked sets that are not smaller: their prefix meets this one."""
    return n - -(-2 * NUM * n // (DEN + NUM)) + 1


def _prefixes(k: int, hot):
    def run(batches):
        common = hot.value
        for b in batches:
            for part in _text.slices(b):
                h, at = _text.shingles(_text.Words(part.column("text")), k)
                n = np.diff(at)
                doc = np.repeat(np.arange(part.num_rows), n)
                if len(common) and len(h):
                    where = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    last = common[where] == h
                    order = np.lexsort((last, doc)) if last.any() else slice(None)  # stable: hashes stay in order
                    h, doc = h[order], doc[order]
                place = np.arange(len(h)) - np.repeat(at[:-1], n)
                keep = place < np.repeat(prefix_length(n), n)
                lead = place < np.repeat(lead_length(n), n)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(ids[doc[keep]].astype(np.int64)), pa.array((2 * n[doc[keep]] + lead[keep]).astype(np.int64))], ["token", "doc_id", "size"])

    return run


def _paired(run: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows with a row of their run that could be linked by it: the sizes (half of ``size``) fit, and the last bit of the smaller one, its lead, is set."""
    n, lead = size >> 1, (size & 1).astype(bool)
    by = np.lexsort((n, run))
    r, n, lead = run[by], n[by], lead[by]
    fits = lambda small, large: (r[small] == r[large]) & (DEN * n[small] >= NUM * n[large])
    at = np.arange(len(r))
    ok = np.zeros(len(r), bool)
    ok[:-1] = lead[:-1] & fits(at[:-1], at[1:])  # the next larger one; if it does not fit, none does
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(lead, at, -1))[:-1]])
    some = np.flatnonzero(before >= 0)
    ok[some] |= fits(before[some], some)
    out = np.empty(len(r), bool)
    out[by] = ok
    return out


def _met(batches):
    """Of rows sorted by token: those that could be linked by it with a row of another id. Holds one row.

    Of a token whose rows come in several batches, all rows if there are two ids.
    """
    token, doc, size, open_ = None, None, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        t, d, z = (b.column(i).to_numpy() for i in range(3))
        begun = token is not None
        if begun:
            t, d, z = np.concatenate([[token], t]), np.concatenate([[doc], d]), np.concatenate([[size], z])
        same = np.zeros(len(t), bool)
        same[1:] = t[1:] == t[:-1]
        run = np.cumsum(~same) - 1
        met = np.bincount(run, same & np.concatenate([[False], d[1:] != d[:-1]])) > 0
        if open_:
            met[0] = True
        out = met[run] & (_paired(run, z) | (run == run[-1]) | (begun & (run == 0)))
        if open_:
            out[0] = False  # given out with the batch before
        # Rows of a run that has met no other id are all alike: one of them goes on.
        token, doc, size, open_ = int(t[-1]), int(d[-1]), int(z[-1]), bool(met[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(d[out])], ["token", "doc_id"])


class Tree:
    """A signature tree over set sizes ``n`` and token bitmaps ``bits`` (rows of uint64)."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, order: np.ndarray):
        self.order = order
        n, bits = n[order], bits[order]
        cut = np.arange(0, len(n), LEAF)
        level = [(int(a), int(min(a + LEAF, len(n))), None) for a in cut]
        stat = lambda nodes: (np.array([n[a:b].min() for a, b, _ in nodes]), np.array([n[a:b].max() for a, b, _ in nodes]))
        any_, all_ = np.bitwise_or.reduceat(bits, cut), np.bitwise_and.reduceat(bits, cut)
        self.levels = [(level, *stat(level), any_, all_)]
        while len(level) > 1:
            step = np.arange(0, len(level), FANOUT)
            level = [(level[i][0], level[min(i + FANOUT, len(level)) - 1][1], (int(i), int(min(i + FANOUT, len(level))))) for i in step]
            any_, all_ = np.bitwise_or.reduceat(any_, step), np.bitwise_and.reduceat(all_, step)
            self.levels.append((level, *stat(level), any_, all_))
        self.n, self.bits = n, bits


def _possible(n1, least1, m1, n2, least2, m2) -> np.ndarray:
    """Whether sets could be linked: sizes of at most n1, n2 and at least ``least``, of which m1, m2 tokens at least are not in the other."""
    overlap = np.minimum(n1 - m1, n2 - m2)
    return (DEN + NUM) * overlap >= NUM * (least1 + least2)


def _missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of each row of a that no row of b has, for all pairs."""
    return np.bitwise_count(a[:, None, :] & ~b[None, :, :]).sum(2, dtype=np.int64)


def dual(p: Tree, q: Tree, same: bool):
    """Yields (i, j) arrays of rows of p and q that could be linked, by a traversal of node pairs."""
    stack = [(len(p.levels) - 1, 0, len(q.levels) - 1, 0)]
    while stack:
        lp, i, lq, j = stack.pop()
        (np_, least_p, most_p, any_p, all_p), (nq, least_q, most_q, any_q, all_q) = p.levels[lp], q.levels[lq]
        m1, m2 = int(np.bitwise_count(all_p[i] & ~any_q[j]).sum()), int(np.bitwise_count(all_q[j] & ~any_p[i]).sum())
        if not _possible(most_p[i], least_p[i], m1, most_q[j], least_q[j], m2) or DEN * most_p[i] < NUM * least_q[j] or DEN * most_q[j] < NUM * least_p[i]:
            continue
        (a, b, kids), (c, d, others) = np_[i], nq[j]
        if kids is None and others is None:
            x, y = p.bits[a:b], q.bits[c:d]
            ok = _possible(p.n[a:b, None], p.n[a:b, None], _missing(x, y), q.n[None, c:d], q.n[None, c:d], _missing(y, x).T)
            ii, jj = np.nonzero(ok)
            ii, jj = ii + a, jj + c
            if same:
                ii, jj = ii[ii < jj], jj[ii < jj]
            yield p.order[ii], q.order[jj]
        elif others is None or (kids is not None and lp >= lq):
            stack += [(lp - 1, k, lq, j) for k in range(*kids) if not same or lp > lq or p.levels[lp - 1][0][k][0] < d]
        else:
            stack += [(lp, i, lq - 1, k) for k in range(*others) if not same or q.levels[lq - 1][0][k][1] > a]


class Rows:
    """Rows of blocks; bitmaps as matrices by width, and folded to half of it."""

    def __init__(self, batch: pa.RecordBatch):
        self.col = {c: batch.column(c).to_numpy() for c in ("side", "rep", "comp", "n", "mh0")}
        raw, at = _text.utf8(batch.column("bits"))
        self.width = np.diff(at) * 8
        self.place, self.own, self.half = np.zeros(batch.num_rows, np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.own[w] = np.empty((len(rows), w // 64), U)
            flat = self.own[w].view(np.uint8)
            for k, a in enumerate(at[rows].tolist()):
                flat[k] = raw[a : a + w // 8]
            self.half[w // 2] = np.bitwise_or(self.own[w][:, : w // 128], self.own[w][:, w // 128 :])

    def bits(self, rows: np.ndarray, w: int) -> np.ndarray:
        """Bitmaps of rows of width ``w`` or twice that, all in ``w`` bits."""
        out = np.zeros((len(rows), w // 64), U)
        same = self.width[rows] == w
        if same.any():
            out[same] = self.own[w][self.place[rows[same]]]
        if not same.all():
            out[~same] = self.half[w][self.place[rows[~same]]]
        return out

    def fits(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of rows are of two components and could be linked, and their largest overlap in thousandths of the sizes' sum."""
        n, comp = self.col["n"].astype(np.int64), self.col["comp"]
        ok = np.flatnonzero((comp[i] != comp[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])))
        out = [(ok[:0], ok[:0])]
        narrow = np.minimum(self.width[i[ok]], self.width[j[ok]])
        for w in np.unique(narrow).tolist():
            at = ok[narrow == w]
            for lo in range(0, len(at), 4096):
                p = at[lo : lo + 4096]
                a, b = self.bits(i[p], w), self.bits(j[p], w)
                m1, m2 = np.bitwise_count(a & ~b).sum(1, dtype=np.int64), np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
                may = _possible(n[i[p]], n[i[p]], m1, n[j[p]], n[j[p]], m2)
                most = np.minimum(n[i[p]] - m1, n[j[p]] - m2)
                out.append((p[may], (1000 * most // (n[i[p]] + n[j[p]]))[may]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        p, most = self.fits(i, j)
        a, b = self.col["rep"][i[p]], self.col["rep"][j[p]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), most]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b", "most"])

    def large(self, rows: np.ndarray):
        """Pairs of one block by signature trees, one for each side and width."""
        side, w_of, n = self.col["side"][rows], self.width[rows], self.col["n"].astype(np.int64)

        def tree(own, w):
            return Tree(n[own], self.bits(own, w), np.lexsort((self.col["mh0"][own], n[own])))

        sides = [s for s in (0, 1) if (side == s).any()]
        for w in np.unique(w_of).tolist():
            for x, y in ((w, w), (w, 2 * w), (2 * w, w)):
                p, q = rows[(side == sides[0]) & (w_of == x)], rows[(side == sides[-1]) & (w_of == y)]
                one = len(sides) == 1
                if not len(p) or not len(q) or one and x > y:
                    continue
                t = tree(p, w)
                for i, j in dual(t, t if one and x == y else tree(q, w), one and x == y):
                    yield p[i], q[j]


def _whole(rows: Rows, block: np.ndarray, text, k: int) -> pa.RecordBatch:
    """Verified links of a component's block (side 0) with those who meet it: one for each of their components, the likeliest pairs first."""
    h, at = _text.shingles(_text.Words(text), k)
    sets = lambda i: h[at[i - block[0]] : at[i - block[0] + 1]]
    comp, linked, out = rows.col["comp"], set(), []
    for i, j in rows.large(block):
        p, most = rows.fits(i, j)
        for x in p[np.argsort(-most, kind="stable")].tolist():
            a, b = i[x], j[x]
            if comp[b] not in linked and _linked(sets(a), sets(b)):
                linked.add(comp[b])
                out.append(sorted((int(rows.col["rep"][a]), int(rows.col["rep"][b]))))
    both = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(both), LINKED))], ["a", "b", "most"])


def _blocks(k: int):
    """Candidate pairs of blocks, and links of components' blocks; rows come sorted by (token, ci, cj, side)."""
    return lambda batches: _block_pairs(batches, k)


def _block_pairs(batches, shingle: int):

    def done(batch):
        keys = np.stack([batch.column(c).to_numpy() for c in ("token", "ci", "cj")])
        new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
        block = np.cumsum(new) - 1
        size = np.bincount(block)
        rows = Rows(batch)
        # Blocks of one leaf: all their pairs at once, by distance in the sort.
        small = (size <= LEAF)[block] & (keys[1] == keys[2])
        at = np.flatnonzero(small)
        far, i, j = int(size[size <= LEAF].max(initial=1)), [], []
        for d in range(1, far):
            p = at[: len(at) - d] if d < len(at) else at[:0]
            p = p[block[p] == block[np.minimum(p + d, len(block) - 1)]]
            p = p[p + d < len(block)]
            i.append(p)
            j.append(p + d)
        if i:
            yield rows.pairs(np.concatenate(i), np.concatenate(j))
        cut = np.append(np.flatnonzero(new), len(block))
        for k in np.unique(block[~small]):
            own = np.arange(cut[k], cut[k + 1])
            if keys[1, own[0]] < 0:
                if len(np.unique(rows.col["side"][own])) == 2:
                    yield _whole(rows, own, batch.column("text").slice(own[0], len(own)), shingle)
                continue
            for i, j in rows.large(own):
                yield rows.pairs(i, j)

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("token", "ci", "cj")]
        same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in zip(("token", "ci", "cj"), last, strict=True)])
        cut = int(np.flatnonzero(same)[0])  # the last block may go on
        if cut:
            yield from done(_joined([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from done(_joined(held))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _check(k: int):
    """Rows sorted by (a, salt, b), the first of a group being a's own text: (a, b) that are linked."""

    def run(batches):
        key, own = None, []
        for batch in batches:
            for part in _text.slices(batch):
                h, at = _text.shingles(_text.Words(part.column("text")), k)
                a, s, b = (part.column(c).to_pylist() for c in ("a", "salt", "b"))
                out = []
                for i in range(part.num_rows):
                    mine = h[at[i] : at[i + 1]]
                    if b[i] is None:
                        own = [*(own if key == (a[i], s[i]) else ()), mine.copy()]
                        key = (a[i], s[i])
                    elif key == (a[i], s[i]) and any(_linked(x, mine) for x in own):
                        out.append((a[i], b[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _mark(c):
    return F.pmod(F.xxhash64(c), F.lit(MARKS))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the ids, and of others that share a mark with one."""
    marks = ids.select(_mark(F.col("doc_id")).alias("m")).distinct()
    return docs.select("doc_id", "text").withColumn("m", _mark(F.col("doc_id"))).join(F.broadcast(marks), "m", "left_semi").drop("m")


def verify(pairs: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are linked.

    Texts that no pair needs are left out by hashed marks (at most ``MARKS``
    values are broadcast, whatever the input; a false mark costs a row). Texts
    then meet their pair by joins, and an id with many partners is compared in
    several salted groups.
    """
    pairs = _shared.materialize(pairs.distinct(), "pairs")
    tasks = _shared.tasks_for(pairs.sparkSession, pairs.count(), PAIRS)
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("salts"))
    members = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).join(texts.withColumnRenamed("doc_id", "b"), "b")
    leaders = degree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(texts.withColumnRenamed("doc_id", "a"), "a")
    rows = members.select("a", "salt", "b", "text").unionByName(leaders.select("a", "salt", F.lit(None).cast("long").alias("b"), "text"))
    return _shared.map_arrow(rows.repartition("a", "salt").coalesce(tasks).sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()), _check(k), "a long, b long")


def similarity_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    with _shared.scratch(docs.sparkSession):
        return _shared.materialize(_similarity_components(docs, k), "alike", release=True, keep=True)


def _similarity_components(docs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = _shared.materialize(_shared.map_arrow(docs, _features(k), _FEATURES), "features")
    rows = both.where(F.col("token").isNull())
    # Frequent shingles: at most HOT_MOST of them, as each has a share of at least 1 / HOT_MOST of all.
    total = rows.agg(F.sum("n")).first()[0] or 0
    counts = _shared.materialize(rows.select("doc_id", F.col("n").cast("long").alias("n_shingles")), "counts")
    found = both.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(HOT_LEAST, total // HOT_MOST))
    hot = np.sort(found.select("token").toPandas()["token"].to_numpy(np.int64).view(U))
    shared = spark.sparkContext.broadcast(hot)

    real = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = real.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.min("mh").alias("mh"), F.min("bits").alias("bits"))
    classes = _shared.materialize(classes, "classes")
    members = real.select("doc_id", "n", "fp1", "fp2").join(classes.select("n", "fp1", "fp2", "rep"), ["n", "fp1", "fp2"])
    # Rows of one id that differ in text are one node: their classes are linked.
    members = _shared.materialize(members.select("doc_id", "rep").distinct(), "members")

    mins = classes.select("rep", "n", "mh", F.posexplode("mh").alias("i", "token"))
    lead = mins.groupBy("i", "token").agg(F.min(F.struct("rep", "n", "mh")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    agree = sum(((F.col("mh")[i] == F.col("lead.mh")[i]).cast("int") for i in range(HASHES)), F.lit(0))
    fits = (DEN * F.least("n", "lead.n") >= NUM * F.greatest("n", "lead.n")) & (F.col("rep") != F.col("lead.rep")) & (agree >= AGREE)
    stars = mins.join(lead, ["i", "token"]).where(fits).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
    same_id = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = verify(stars, docs, k).unionByName(same_id)
    first = _shared.materialize(components(_shared.materialize(links, "links", release=True)), "first")
    known = classes.select("rep", "n", F.col("mh")[0].alias("mh0"), "bits").join(first, F.col("rep") == F.col("node"), "left").select("rep", "n", "mh0", "bits", F.coalesce("component", "rep").alias("comp"))
    known = _shared.materialize(known, "known")
    for table in (both, classes, first):  # only ``counts``, ``members`` and ``known`` are read from here on
        _shared.discard(table)

    prefixes = _shared.map_arrow(docs.where(F.col("doc_id").isNotNull()), _prefixes(k, shared), "token long, doc_id long, size long")
    met = _shared.map_arrow(prefixes.repartition("token").sortWithinPartitions("token"), _met, "token long, doc_id long")
    held = met.join(members, "doc_id").select("token", "rep").join(known.select("rep", "comp", "n"), "rep").select("token", "rep", "comp", "n")
    held = _shared.materialize(held, "met", release=True)
    pairs = _shared.map_arrow(_dealt(held, known, docs).repartition("token", "ci", "cj").sortWithinPartitions("token", "ci", "cj", "side"), _blocks(k), "a long, b long, most long")
    pairs = _shared.materialize(pairs.groupBy("a", "b").agg(F.min("most").alias("most")), "candidates", release=True)
    comp = _merged(pairs.where(F.col("most") == LINKED), known.select("rep", "comp"), _shared.tasks_for(spark, known.count()))
    comp = _contracted(pairs.where(F.col("most") != LINKED), comp, docs, k)
    named = members.join(comp, "rep").groupBy("doc_id").agg(F.min("comp").alias("component_id"))
    out = counts.join(named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _dealt(held: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of blocks that hold every pair of texts of two components that share a token.

    A token's rows of its largest component, from ``APART`` rows on, are no part of
    the token's own block: the others meet that component as a whole, once for all
    tokens, in a block of the component. So a large group's texts travel once, and
    its size adds rows, not pairs of parts. Rows of a component's block have their
    texts. Blocks beyond ``CHUNK`` rows (a component's: or ``SHINGLES``) are split
    into parts, and all pairs of parts that can hold such pairs are dealt.
    """
    met, held = held, held.distinct()
    each = held.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed = each.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("comps")).where("comps > 1")
    apart = (F.col("top.c") >= APART).cast("int")
    mixed = mixed.select("token", F.when(apart == 1, F.col("top.comp")).alias("large"), (F.col("c") - apart * F.col("top.c")).alias("c"), (F.col("comps") - apart).alias("comps"))
    rows = held.join(mixed, "token").where(F.col("large").isNull() | (F.col("comp") != F.col("large")))
    rows = _shared.materialize(rows.select("token", "rep", "n", "large", "c", "comps"), "mixed", release=True)
    _shared.discard(met)
    place, parts = F.xxhash64("rep"), lambda n: F.ceil(n / CHUNK).cast("int")

    # Of a token's own block the parts (i, j); a block of one part is a pair (0, 0).
    own = rows.where("comps > 1").withColumn("parts", parts(F.col("c"))).withColumn("own", F.pmod(place, "parts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("token", F.least("own", "o").alias("ci"), F.greatest("own", "o").alias("cj"), (F.col("own") > F.col("o")).cast("int").alias("side"), "rep")
    # Of a component's block the parts (-1 - i of those who meet it, j of its own).
    meets = _shared.materialize(rows.where("large is not null").select("large", "rep", "n").distinct(), "meets")
    members = known.select(F.col("comp").alias("large"), "rep", "n")
    split = lambda t, name: t.groupBy("large").agg(F.greatest(parts(F.count("*")), F.ceil(F.sum("n") / SHINGLES).cast("int")).alias(name))
    sizes = split(meets, "n").join(split(members, "m"), "large")
    meets, members = meets.drop("n"), members.drop("n")
    theirs = meets.join(sizes, "large").select(F.col("large").alias("token"), (-1 - F.pmod(place, "n")).cast("int").alias("ci"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("cj"), F.lit(1).alias("side"), "rep")
    mine = members.join(sizes, "large").select(F.col("large").alias("token"), F.explode(F.sequence(-F.col("n"), F.lit(-1))).alias("ci"), F.pmod(place, "m").cast("int").alias("cj"), F.lit(0).alias("side"), "rep")
    whole = theirs.unionByName(mine)
    texts = _texts(docs, meets.unionByName(members.join(sizes, "large", "left_semi")).select(F.col("rep").alias("doc_id")))
    whole = whole.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    rows = own.withColumn("text", F.lit(None).cast("string")).unionByName(whole)
    return rows.join(known, "rep").select("token", "ci", "cj", "side", "rep", "comp", "n", "mh0", "bits", "text")


def _merged(links: DataFrame, comp: DataFrame, tasks: int) -> DataFrame:
    """(rep, comp) after the links (a, b)."""
    ca, cb = comp.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    joined = links.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    new = components(_shared.materialize(joined, "joined"))
    return _shared.materialize(comp.join(new, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("component", "comp").alias("comp")).coalesce(tasks), "comp")


def _contracted(pairs: DataFrame, comp: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, comp) after all links among the candidate pairs (a, b, most).

    While candidates outnumber the texts and a turn finds links, each component
    verifies its likeliest pair only: true links join components, and the pairs
    inside a joined one need no texts. The pairs left over are verified all.
    """
    texts, share = comp.count(), 1.0
    most, tasks = CROWD * texts, _shared.tasks_for(docs.sparkSession, texts)
    for turn in range(TURNS + 1):
        ca, cb = comp.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
        open_ = _shared.materialize(pairs.join(ca, "a").join(cb, "b").where("ca != cb").select("a", "b", "most", "ca", "cb"), "open")
        ends = open_.select(F.col("ca").alias("c"), "most", "a", "b").unionByName(open_.select(F.col("cb").alias("c"), "most", "a", "b"))
        best = _shared.materialize(ends.groupBy("c").agg(F.max(F.struct("most", "a", "b")).alias("m")).select("m.a", "m.b").distinct(), "best")
        left, first = open_.count(), best.count()
        if not left:
            return comp
        last = turn == TURNS or left <= most or share < FEW
        links = _shared.materialize(verify(open_.select("a", "b") if last else best, docs, k), "links")
        comp = _merged(links, comp, tasks)
        if last:
            return comp
        share = links.count() / first
        pairs = open_.select("a", "b", "most").join(best, ["a", "b"], "left_anti")
    raise AssertionError("the last turn returns")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def jaccard_cte(docs: str) -> str:
    """DuckDB CTEs up to ``alike`` (doc_id, n_shingles, component_id); needs WITH RECURSIVE."""
    return rf"""
j_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
j_sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM j_words),
j_size AS (SELECT doc_id, count(*) AS n FROM j_sets GROUP BY doc_id),
j_both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM j_sets a JOIN j_sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
j_links AS (SELECT a, b FROM j_both JOIN j_size x ON x.doc_id = a JOIN j_size y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
j_edges AS (SELECT a, b FROM j_links UNION ALL SELECT b, a FROM j_links),
j_reach AS (SELECT doc_id AS node, doc_id AS seen FROM {docs} UNION SELECT r.node, e.b FROM j_reach r JOIN j_edges e ON e.a = r.seen),
alike AS (
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
  FROM (SELECT node AS doc_id, min(seen) AS component_id FROM j_reach GROUP BY node) LEFT JOIN j_size USING (doc_id))"""


OP4_SQL = f"WITH RECURSIVE {jaccard_cte('documents')} SELECT * FROM alike"
