"""Benchmark decontamination by latent semantic retrieval.

1. Items are cut into pieces of at most ``BLOCK`` words; their words are the
   vocabulary. One pass over the texts keeps of each the places of vocabulary
   words, as a work table, and counts in how many blocks each word occurs.
2. Passages are windows of two blocks of words, a block apart, over whole texts,
   so a piece lies wholly in one. Their TF-IDF rows, with the pieces' own, form a
   matrix whose right singular vectors come from a distributed randomised SVD of
   rank ``RANK``: one pass sums A'(A W) for a random W, and the Nystrom form
   yields the vectors. No word is left out of it, so a paraphrase without a
   piece's rare words is met by the others, and by words that occur with them.
3. In the latent space, each passage is compared with all pieces by cosine.
4. A candidate is checked by the longest common subsequence of words that lie
   within ``SPREAD`` times the length of the piece. An item's coverage is the
   share of its words so found in a document; it is a leak if the coverage is
   ``COVER`` or more, or ``PARTLY`` or more with its answer (the last sentence, or
   the last words of an item of one sentence) found as well. A leak has a piece
   matched by ``PARTLY`` or more, as its pieces are matched by that on the whole;
   where such a piece is found, the item's other pieces are searched in the text.

The benchmark is handled in parts of at most ``PART`` pieces, so what the driver
holds and sends to workers is bounded (``PART * BLOCK`` words by ``RANK``) whatever
its size; an item of any length is a run of pieces of one part.

Defined cases: null or empty texts and items without words match nothing; an
item given twice is reported once for each id; rows of one document id are one
document; a null id is reported as null; extra columns are dropped; an empty
benchmark or corpus gives no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text
from .toxicity import tokens

U = np.uint64
BLOCK, RANK, PART, GROUP = 32, 128, 2048, 256
COSINE, MARGIN, WEIGHT = 0.1, 16, 0.01
COVER, PARTLY, ANSWER, ANSWER_WORDS, SPREAD = 0.75, 0.5, 0.6, 8, 1.5
WORDS, STEP = 1 << 18, 1 << 12  # of texts handled at once; of hits projected at once


class Bench:
    """Items as words, numbered in the order of their hashes; ``pieces`` are (item, first word, end)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        w = tokens(pa.array([r[1] or "" for r in rows], pa.large_string()))
        self.terms, number = np.unique(w.hash, return_inverse=True)
        self.words = [number[a:b].astype(np.int32) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.answers = []
        for (_, text), own in zip(rows, self.words, strict=True):
            last = [s for s in (text or "").replace("?", ".").replace("\n", ".").split(".") if s.strip()]
            n = len(tokens(pa.array([last[-1]], pa.large_string())).hash) if len(last) > 1 else ANSWER_WORDS
            self.answers.append(max(0, len(own) - max(n, min(ANSWER_WORDS, len(own)))))  # its first word
        self.pieces = []
        for i, own in enumerate(self.words):
            k = -(-len(own) // BLOCK)
            cut = np.linspace(0, len(own), k + 1).astype(int)
            self.pieces += [(i, int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.own = [[] for _ in self.words]  # numbers of an item's pieces
        for p, (i, _, _) in enumerate(self.pieces):
            self.own[i].append(p)
        self.length = np.array([b - a for _, a, b in self.pieces], np.int64)

    def piece(self, p: int) -> np.ndarray:
        i, a, b = self.pieces[p]
        return self.words[i][a:b]


class Lookup:
    """Positions of hashes in a sorted vocabulary; a bit table turns most others away."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(terms & U(0xFFFFF)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are terms, their positions)"""
        at = np.flatnonzero(self.bits[(h & U(0xFFFFF)).astype(np.int64)])
        if not len(self.terms):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[place] == h[at]
        return at[ok], place[ok]


_SPOTS = "doc_id long, n int, place binary, term binary, hit long, blocks long"
_SPOT_NAMES = [f.split()[0] for f in _SPOTS.split(", ")]


def _spots(look):
    """Of each text the places of vocabulary words; and (hit, blocks that hold it), where hit -1 counts all blocks."""
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def batch(columns, n):
        return pa.RecordBatch.from_arrays([c if c is not None else pa.nulls(n, t) for c, t in zip(columns, types, strict=True)], _SPOT_NAMES)

    def run(batches):
        size = len(look.value.terms)
        total, all_blocks = np.zeros(size, np.int64), 0
        for b in batches:
            for part in _text.slices(b, most=1 << 20):
                w = tokens(part.column("text"))
                at, term = look.value.of(w.hash)
                doc = w.doc[at]
                place = at - w.first[doc]
                n = -(-w.count // BLOCK)
                block = (np.cumsum(n) - n)[doc] + place // BLOCK
                total += np.bincount(np.unique(block * size + term) % max(1, size), minlength=size)
                all_blocks += int(n.sum())
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own = np.flatnonzero(np.diff(cut))
                if len(own):
                    packed = lambda x, own=own, cut=cut: pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.append(cut[own], cut[-1]).astype("<i4") * 4), pa.py_buffer(x.astype("<i4"))])
                    yield batch([part.column("doc_id").take(pa.array(own)).cast(pa.int64()), pa.array(w.count[own].astype(np.int32)), packed(place), packed(term), None, None], len(own))
        some = np.flatnonzero(total)
        yield batch([None] * 4 + [pa.array(np.append(some, -1)), pa.array(np.append(total[some], all_blocks))], len(some) + 1)

    return run


class Hits:
    """Vocabulary words of some texts: ``doc``, ``place`` and ``term`` of each; ``first`` word of each text among all, ``dense`` terms of all words (-1: no term)."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: _text.utf8(batch.column(name))
        raw, at = column("place")
        self.place, self.term = raw.view("<i4").astype(np.int64), column("term")[0].view("<i4").astype(np.int64)
        self.count = batch.column("n").to_numpy().astype(np.int64)
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(at) // 4)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.dense = np.full(self.first[-1], -1, np.int32)
        self.dense[self.first[self.doc] + self.place] = self.term
        self.blocks = -(-self.count // BLOCK)
        self.block = np.cumsum(self.blocks) - self.blocks  # the first of each text

    @staticmethod
    def of(batches) -> Iterator[tuple[Hits, pa.RecordBatch]]:
        for b in batches:
            at, i = np.concatenate([[0], np.cumsum(b.column("n").to_numpy())]), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + WORDS, "right")) - 1)
                part = b.slice(i, j - i)
                yield Hits(part), part
                i = j


def summed(row: np.ndarray, term: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, named in ascending order, the sum of the matrix rows of its terms."""
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    size = np.bincount(row, minlength=n)
    if not len(row):
        return out
    if size.max() > BLOCK:  # long rows in parts, whose sums are summed
        parts = -(-size // BLOCK)
        begin, first = np.cumsum(size) - size, np.cumsum(parts) - parts
        part = first[row] + (np.arange(len(row)) - begin[row]) // BLOCK
        return summed(np.repeat(np.arange(n), parts), np.arange(parts.sum()), n, summed(part, term, int(parts.sum()), matrix))
    order = np.argsort(-size, kind="stable")
    begin, left = (np.cumsum(size) - size)[order], np.cumsum(np.bincount(size, minlength=BLOCK + 1)[::-1])[::-1]
    for lo in range(0, n, STEP):  # by places of terms in rows: whole matrix rows are added
        own = np.zeros((min(STEP, n - lo), matrix.shape[1]), matrix.dtype)
        for k in range(BLOCK):
            m = min(int(left[k + 1]) - lo, len(own))
            if m <= 0:
                break
            own[:m] += matrix[term[begin[lo : lo + m] + k]]
        out[order[lo : lo + len(own)]] = own
    return out


class Space:
    """TF-IDF weights of the vocabulary and, after fitting, the latent vectors of terms and pieces.

    A passage's row is the sum of its two blocks' rows, so blocks are projected
    once and added; cosines do not depend on the rows' lengths.
    """

    def __init__(self, bench: Bench, frequency: np.ndarray, blocks: int):
        # The root of the idf: a paraphrase may lack the rare words, which would else outweigh all others together.
        self.idf = np.sqrt(np.log((1 + blocks) / (1 + frequency)) + 0.1).astype(np.float32)
        self.row, self.term = np.repeat(np.arange(len(bench.pieces)), bench.length), np.concatenate([bench.piece(p) for p in range(len(bench.pieces))])
        # Of a piece's words, those but the ``skip`` most frequent in the corpus; a match has ``need`` of them.
        need = np.ceil(PARTLY * bench.length).astype(np.int64)
        skip = need // 2
        order = np.lexsort((self.term, frequency[self.term], self.row))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(bench.length) - bench.length, bench.length)
        order = order[rank < np.repeat(bench.length - skip, bench.length)]
        self.rare, self.need = (self.row[order], self.term[order]), (need - skip).astype(np.uint8)
        self.rank = min(len(self.idf), RANK)
        self.random = np.random.default_rng(3).normal(size=(len(self.idf), self.rank)).astype(np.float32)
        self.vectors = self.latent = None

    def blocks(self, h: Hits, matrix) -> tuple[np.ndarray, np.ndarray]:
        """(projected rows of all blocks, whether a block has one after it in its text)"""
        more = np.ones(int(h.blocks.sum()), bool)
        more[np.cumsum(h.blocks) - 1] = False
        return summed(h.block[h.doc] + h.place // BLOCK, h.term, len(more), matrix), more

    def fit(self, product: np.ndarray, passages: int) -> None:
        """Singular vectors from A'(A W), to which the pieces' own rows are added with a weight that keeps them in the space."""
        n, weighted = int(self.row[-1]) + 1, self.random * self.idf[:, None]
        np.add.at(product, self.term, max(1.0, WEIGHT * passages / n) * summed(self.row, self.term, n, weighted)[self.row])
        product *= self.idf[:, None]
        shift = 1e-6 * np.linalg.norm(product) + 1e-12
        y = product + shift * self.random
        core = self.random.T.astype(np.float64) @ y
        vals, vecs = np.linalg.eigh((core + core.T) / 2)
        good = vals > vals.max() * 1e-10
        u, _, _ = np.linalg.svd(y @ (vecs[:, good] / np.sqrt(vals[good])), full_matrices=False)
        self.vectors = (u * self.idf[:, None]).astype(np.float32)
        self.latent = unit(summed(self.row, self.term, n, self.vectors))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sketch(shared):
    """Rows of A'(A W) but for the weight of their term, summed over a task; term -1 counts passages."""

    def run(batches):
        s = shared.value
        held, seen = np.zeros((len(s.idf), s.rank), np.float64), 0
        weighted = s.random * s.idf[:, None]
        for h, _ in Hits.of(batches):
            p, more = s.blocks(h, weighted)
            # A block's row meets the passages that it is in: its own and the one before. A text of one block is a passage.
            own = p.copy()
            two = np.flatnonzero(more)
            own[two] += p[two + 1]
            own[two + 1] += p[two] + np.where(more[two + 1, None], p[two + 1], 0)
            seen += len(two) + int((h.blocks == 1).sum())
            order = np.argsort(h.term, kind="stable")
            used, number = np.unique(h.term[order], return_inverse=True)
            held[used] += summed(number, (h.block[h.doc] + h.place // BLOCK)[order], len(used), own)
        used = np.flatnonzero(held.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array([held[t].astype(np.float32).tobytes() for t in used] + [np.int64(seen).tobytes()], pa.binary())], ["term", "sums"])

    return run


def _add(batches):
    """Sums by term of sorted rows."""
    key, total, out = None, None, []
    for b in batches:
        for t, s in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
            own = np.frombuffer(s, np.int64 if t < 0 else np.float32).astype(np.int64 if t < 0 else np.float64)
            if t == key:
                total = total + own
                continue
            if key is not None:
                out.append((key, total.tobytes()))
            key, total = t, own
    if key is not None:
        out.append((key, total.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["term", "sums"])


@lru_cache(1 << 14)
def _masks(piece: bytes, kind: str) -> dict[int, int]:
    """Positions of each word of a piece, as bits."""
    masks: dict[int, int] = {}
    for i, t in enumerate(np.frombuffer(piece, kind).tolist()):
        masks[t] = masks.get(t, 0) | 1 << i
    return masks


def common(piece: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of two runs of terms, in bit-parallel form."""
    masks = _masks(piece.tobytes(), piece.dtype.str)
    full, v = (1 << len(piece)) - 1, (1 << len(piece)) - 1
    for t in text.tolist():
        m = masks.get(t)
        if m:
            u = v & m
            v = (v + u) | (v - u)
            v &= full
    return len(piece) - v.bit_count()


def matched(bench: Bench, h: Hits, doc: np.ndarray, block: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """``common`` of each piece and the text around its window, for all candidates at once; pieces by groups of ``GROUP``."""
    out = np.zeros(len(doc), np.int64)
    order = np.argsort(piece, kind="stable")
    cuts = np.searchsorted(piece[order], np.arange(0, len(bench.pieces) + GROUP, GROUP))
    for g in np.flatnonzero(np.diff(cuts)):
        low = g * GROUP
        own = range(low, min(low + GROUP, len(bench.pieces)))
        words = np.concatenate([bench.piece(p) for p in own])
        local = np.zeros(len(bench.terms) + 1, np.int32)  # the last stands for -1, no term
        some = np.unique(words)
        local[some] = np.arange(1, len(some) + 1)
        size = bench.length[low : low + len(own)]
        rank = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        bits = np.zeros((len(own), len(some) + 1), U)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(own)), size), local[words]), U(1) << rank.astype(U))
        dense = local[h.dense]
        mine = order[cuts[g] : cuts[g + 1]]
        for lo in range(0, len(mine), STEP):
            at = mine[lo : lo + STEP]
            p, start, end = piece[at] - low, h.first[doc[at]], h.first[doc[at] + 1]
            begin = start + block[at] * BLOCK - MARGIN
            full = (U(1) << size[p].astype(U)) - U(1)
            v = full.copy()
            x = begin + np.arange(2 * BLOCK + 2 * MARGIN)[:, None]
            near = np.where((x >= start) & (x < end), dense[np.clip(x, 0, len(dense) - 1)], 0)
            for t in near:
                u = v & bits[p, t]
                v = ((v + u) | (v - u)) & full
            out[at] = size[p] - np.bitwise_count(v)
    return out


def closest(piece: np.ndarray, text: np.ndarray) -> tuple[int, np.ndarray]:
    """The longest common subsequence within ``SPREAD`` times the piece's length of text, and that text.

    Common words in order are met in any long text; those of a copy or a
    paraphrase are met close together.
    """
    size, step = -(-int(SPREAD * 4) * len(piece) // 4), max(1, len(piece) // 4)
    best = (-1, text[:0])
    for a in range(0, max(1, len(text) - size + step), step):
        n = common(piece, text[a : a + size])
        if n > best[0]:
            best = n, text[a : a + size]
    return best


_FOUND = "doc_id long, item int, piece int, matched int, answer int, cosine double"


def candidates(bench: Bench, space: Space, h: Hits):
    """(text, first block, piece, cosine) of all passages and pieces that the latent space holds alike, if the passage has words enough of the piece."""
    p, more = space.blocks(h, space.vectors)
    two = np.flatnonzero(more)
    p[two] += p[two + 1]
    first = np.sort(np.concatenate([two, h.block[h.blocks == 1]]))  # blocks that passages start with
    own, doc = unit(p[first]), np.searchsorted(h.block, first, "right") - 1
    # Words of each piece in each half block: a match lies in four halves, of the six that the check of a passage looks at.
    half = 2 * h.block[h.doc] + h.place // (BLOCK // 2)
    out = [(doc[:0], doc[:0], doc[:0], np.zeros(0, np.float32))]
    for low in range(0, len(space.latent), GROUP):
        latent, need = space.latent[low : low + GROUP], space.need[low : low + GROUP]
        member = np.zeros((len(space.idf), len(latent)), np.uint8)
        row, term = space.rare
        mine = (row >= low) & (row < low + GROUP)
        member[term[mine], row[mine] - low] = 1
        some = np.flatnonzero(member.any(1)[h.term])
        which, at = half[some], h.term[some]
        has = np.zeros((2 * len(more) + 5, len(latent)), np.uint8)
        has[1 : 2 * len(more) + 1] = summed(which, at, 2 * len(more), member)
        for lo in range(0, len(first), STEP):
            f = first[lo : lo + STEP]
            run = has[2 * f] + has[2 * f + 1] + has[2 * f + 2] + has[2 * f + 3]
            around = run.copy()
            for j in range(2):
                run += has[2 * f + 4 + j] - has[2 * f + j]
                np.maximum(around, run, out=around)
            cosine = own[lo : lo + STEP] @ latent.T
            r, c = np.nonzero((cosine >= COSINE) & (around >= need))
            out.append((doc[lo + r], f[r] - h.block[doc[lo + r]], c + low, cosine[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def matches(bench: Bench, space: Space, h: Hits) -> dict[tuple[int, int], tuple[int, int, float]]:
    """(words, words of the answer, cosine) of the best match of each (text, piece)."""
    best: dict[tuple, tuple] = {}
    leaky = set()  # (text, item) with a piece matched by PARTLY

    def check(d: int, block: int, p: int, cosine: float) -> None:
        i, a, e = bench.pieces[p]
        base = int(h.first[d])
        text = h.dense[max(base, base + block * BLOCK - MARGIN) : min(int(h.first[d + 1]), base + (block + 2) * BLOCK + MARGIN)]
        n, text = closest(bench.words[i][a:e], text)
        if 3 * n < e - a:
            return
        answer = common(bench.words[i][max(a, bench.answers[i]) : e], text) if e > bench.answers[i] else 0
        old = best.get((d, p), (0, 0, 0.0))
        best[d, p] = (max(n, old[0]), max(answer, old[1]), max(cosine, old[2]))
        if n >= PARTLY * (e - a):
            leaky.add((d, i))

    def likely(d, block, p, cosine, share: float) -> None:
        """Check candidates that have ``share`` of the piece's words in order, while they can be better than what was found."""
        bound = matched(bench, h, d, block, p)
        ok = np.flatnonzero(bound >= share * bench.length[p] - 1e-9)
        for x in ok[np.lexsort((-bound[ok], p[ok], d[ok]))].tolist():
            if bound[x] >= best.get((int(d[x]), int(p[x])), (0,))[0]:
                check(int(d[x]), int(block[x]), int(p[x]), float(cosine[x]))

    likely(*candidates(bench, space, h), PARTLY)
    todo = [(np.zeros(0, np.int64),) * 3]
    for t, i in sorted(leaky):  # the other pieces of items found
        if len(bench.own[i]) > 1:
            k, own = np.arange(max(1, h.blocks[t] - 1)), np.array(bench.own[i])
            todo.append((np.full(len(k) * len(own), t), np.tile(k, len(own)), np.repeat(own, len(k))))
    d, block, p = (np.concatenate(x) for x in zip(*todo, strict=True))
    likely(d, block, p, np.zeros(len(d)), 1 / 3)
    return best


def _search(shared):
    def run(batches):
        bench, space = shared.value
        for h, part in Hits.of(batches):
            best = matches(bench, space, h)
            keys = list(best)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())), pa.array([bench.pieces[k[1]][0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([best[k][j] for k in keys], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64())))], [f.split()[0] for f in _FOUND.split(", ")])

    return run


def _parts(benchmark: DataFrame) -> Iterator[Bench]:
    """Items in parts of at most ``PART`` pieces (of one item, if it has more)."""
    rows, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        n = 1 + len(r[1].split()) // BLOCK
        if rows and held + n > PART:
            yield Bench(rows)
            rows, held = [], 0
        rows.append((r[0], r[1]))
        held += n
    if rows:
        yield Bench(rows)


def _leaks(docs: DataFrame, bench: Bench) -> DataFrame:
    """``leaks`` of one part of the benchmark."""
    spark = docs.sparkSession
    spots = _shared.materialize(_shared.map_arrow(docs, _spots(spark.sparkContext.broadcast(Lookup(bench.terms))), _SPOTS), "spots")
    counted = {r[0]: r[1] for r in spots.where("hit is not null").groupBy("hit").agg(F.sum("blocks")).collect()}  # a row per benchmark term
    frequency = np.array([counted.get(t, 0) for t in range(len(bench.terms))])
    space = Space(bench, frequency, counted.get(-1) or 0)
    spots = spots.where("hit is null").select("doc_id", "n", "place", "term")
    sums = _shared.map_arrow(spots, _sketch(spark.sparkContext.broadcast(space)), "term long, sums binary")
    added = _shared.map_arrow(sums.repartition("term").sortWithinPartitions("term"), _add, "term long, sums binary")
    product, passages = np.zeros(space.random.shape), 0
    for r in added.toLocalIterator():  # a row per term
        if r.term < 0:
            passages = int(np.frombuffer(r.sums, np.int64)[0])
        else:
            product[r.term] = np.frombuffer(r.sums, np.float64)
    space.fit(product, passages)
    space.random = None
    found = _shared.map_arrow(spots, _search(spark.sparkContext.broadcast((bench, space))), _FOUND)
    items = spark.createDataFrame([(i, bench.ids[i], len(w), len(w) - a) for i, (w, a) in enumerate(zip(bench.words, bench.answers, strict=True))], "item int, item_id long, words int, answer_words int")
    best = found.groupBy("doc_id", "item", "piece").agg(F.max("matched").alias("matched"), F.max("answer").alias("answer"), F.max("cosine").alias("cosine"))
    whole = best.groupBy("doc_id", "item").agg(F.sum("matched").alias("matched"), F.sum("answer").alias("answer"), F.max("cosine").alias("cosine")).join(F.broadcast(items), "item")
    scored = whole.select("doc_id", "item_id", (F.col("matched") / F.col("words")).alias("coverage"), (F.col("answer") >= ANSWER * F.col("answer_words")).alias("answer_found"), "cosine")
    return scored.where((F.col("coverage") >= COVER) | ((F.col("coverage") >= PARTLY) & F.col("answer_found")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, answer_found, cosine of every leak."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = [_leaks(docs, bench) for bench in _parts(benchmark) if bench.pieces]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, answer_found boolean, cosine double")
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns; a row of null id is judged as a document of its own."""
    row = "leak_row"
    while row in docs.columns:
        row += "_"
    with _shared.scratch(docs.sparkSession):
        bad = _shared.materialize(leaks(docs.where(F.col("doc_id").isNotNull()), benchmark).select("doc_id").distinct(), "leaks", release=True, keep=True)
    kept = docs.where(F.col("doc_id").isNotNull()).join(bad, docs["doc_id"] == bad["doc_id"], "left_anti")
    nameless = _shared.materialize(docs.where(F.col("doc_id").isNull()).withColumn(row, F.monotonically_increasing_id()), "nameless")  # stored: the keys must not change
    if nameless.isEmpty():
        return kept
    bad = _shared.materialize(leaks(nameless.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("bad_row")).distinct(), "leaks")
    return kept.unionByName(nameless.join(bad, nameless[row] == bad["bad_row"], "left_anti").drop(row))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
