"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly.

A word is the bag of its hashed character n-grams (with edge marks) and itself;
a window of words is the mean of its subword embeddings; a two-class softmax
reads the mean. A misspelling that was never seen shares most n-grams with the
word it distorts. A text's score is that of its highest window, so one insult
counts in a long text as in a short one; training follows the same rule (the
window that scores highest carries the document's label).

As the softmax is linear, each subword has one scalar at scoring time and a
window is a difference of prefix sums.

Fitted on a bounded sample: at most ``positives`` and ``negatives`` labelled
rows, those with the smallest hash of the id, with their whole texts. All rows
and whole texts are scored.

Defined cases: null and empty texts score as a window without words (the bias
alone); without labels of both kinds every score is the share of label 1, or 0;
a document with several labels is toxic if any is; labels of null ids are not
learned from, and rows of null id are scored like others and not held out;
repeated rows score alike, and those of a sampled id are learned from once for
each distinct text, ``COPIES`` at most; extra columns are dropped; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared, _text
from .langid import fold

U = np.uint64
SLOTS, WIDTH, GRAMS = 1 << 16, 16, (3, 4, 5)
WINDOW, STRIDE = 12, 6
POSITIVES, NEGATIVES = 1000, 2000
EPOCHS, BATCH, RATE, START = 4, 64, 0.5, 1.0
COPIES = 4
THRESHOLD = 0.3

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[97:123] = _KEEP[128:] = True
_KEEP[[ord(c) for c in "@$*"]] = True


def tokens(column) -> _text.Words:
    """Words of letters, digits, @, $ and *, in lower case."""
    raw, at = _text.utf8(column)
    low = _text._LOWER[raw]
    plain = np.where(_KEEP[low], low, 32).astype(np.uint8)
    return _text.Words(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(plain)]))


def subwords(words: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, owner, inverse): the subword slots of each distinct word, the distinct word that each belongs to, and the distinct word of each token."""
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    start, size = words.start[first], (words.end - words.start)[first]
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.full(begin[-1], ord(">"), np.uint8)
    flat[begin[:-1]] = ord("<")
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(begin[:-1] + 1, size) + inside] = words.raw[np.repeat(start, size) + inside]
    owner_of = np.repeat(np.arange(len(size)), size + 2)
    gram, slots, owners = flat.astype(U), [], []
    for k in range(2, max(GRAMS) + 1):
        gram = gram[: max(0, len(flat) - k + 1)]
        gram = gram * U(0x100000001B3) + flat[k - 1 :]
        if k in GRAMS:
            whole = owner_of[: len(gram)] == owner_of[k - 1 :] if len(gram) else np.zeros(0, bool)
            slots.append(_text.mix(gram[whole] + U(k)) >> U(48))
            owners.append(owner_of[: len(gram)][whole])
    slots.append(_text.mix(words.hash[first] + U(1)) >> U(48))
    owners.append(np.arange(len(first)))
    slots, owners = np.concatenate(slots).astype(np.int64) % SLOTS, np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], owners[order], inverse


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of all windows of documents of ``count`` words; each has at least one."""
    per = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(count)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = np.concatenate([[0], np.cumsum(count)])
    a = at[doc] + k * STRIDE
    return doc, a, np.minimum(a + WINDOW, at[doc + 1])


def encode(column, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``subwords`` of all texts, and their numbers of words; a part of about ``most`` bytes at a time."""
    count, hashes, seen, slots, owners = [], [], np.zeros(0, U), [], []
    for part in _text.slices(pa.RecordBatch.from_arrays([column], ["text"]), most=most):
        w = tokens(part.column("text"))
        count.append(w.count)
        hashes.append(w.hash)
        own, of, _ = subwords(w)
        words = np.unique(w.hash)
        fresh = ~np.isin(words, seen)
        keep = fresh[of]
        slots.append(own[keep].astype(np.int32))
        owners.append(words[of[keep]])
        seen = np.concatenate([seen, words[fresh]])
    words = np.sort(seen)
    empty = [np.zeros(0, np.int64)]
    slots, owner = np.concatenate(slots or empty), np.searchsorted(words, np.concatenate(owners or empty))
    order = np.argsort(owner, kind="stable")
    return slots[order], owner[order], np.searchsorted(words, np.concatenate(hashes or empty)), np.concatenate(count or empty)


def window_margins(slope: np.ndarray, offset: float, slots, owner, inverse, count) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end, margin) of every window."""
    n = int(inverse.max()) + 1 if len(inverse) else 0
    total, size = np.bincount(owner, slope[slots], n), np.bincount(owner, minlength=n)
    sums, sizes = np.concatenate([[0.0], np.cumsum(total[inverse])]), np.concatenate([[0], np.cumsum(size[inverse])])
    doc, a, b = windows(count)
    return doc, a, b, (sums[b] - sums[a]) / np.maximum(1, sizes[b] - sizes[a]) + offset


class Model:
    """Embeddings, softmax weights and bias; ``slope`` is each slot's share of the margin."""

    def __init__(self, emb, soft, bias, prior: float | None = None):
        self.prior = prior
        if prior is None:
            self.slope, self.offset = emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])

    def margins(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, end, margin) of every window."""
        w = tokens(column)
        return window_margins(self.slope, self.offset, *subwords(w), w.count)

    def score(self, column) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(column), self.prior)
        doc, _, _, m = self.margins(column)
        best = np.full(len(column), -np.inf)
        np.maximum.at(best, doc, m)
        return 1 / (1 + np.exp(-np.clip(best, -50, 50)))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Adagrad over mini-batches in a fixed order, on the window of each document that scores highest before the epoch."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(None, None, None, float(y.mean()) if len(y) else 0.0)
    slots, owner, inverse, count = encode(pa.array(texts, pa.large_string()))
    at = np.searchsorted(owner, np.arange((owner[-1] if len(owner) else -1) + 2))
    rng = np.random.default_rng(5)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SLOTS, WIDTH)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_soft, seen_bias = np.full((SLOTS, 1), 1e-8, np.float32), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)
    # Start: the first dimension of a slot is how much oftener it is in documents of label 1, in standard deviations.
    n1, n, first, grams = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.concatenate([[0], np.cumsum(count)]), np.diff(at)
    for i in range(len(y)):
        words = np.unique(inverse[first[i] : first[i + 1]])
        reps = grams[words]
        has = np.unique(slots[np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(at[words], reps)])
        n[has] += 1
        n1[has] += y[i]
    share = y.mean()
    emb[:, 0] += START * np.clip((n1 - n * share) / np.sqrt(n * share * (1 - share) + 1), 0, 8)
    soft[0] += [-1, 1]
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0).astype(np.float32)
    for e in range(epochs):
        now = Model(emb, soft, bias)
        doc, a, b, m = window_margins(now.slope, now.offset, slots, owner, inverse, count)
        order = np.lexsort((-m, doc))
        top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        begin, end = a[top], b[top]
        rate = RATE / (1 + 0.2 * e)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            ids, row = [], []
            for r, d in enumerate(part):
                for t in inverse[begin[d] : end[d]]:
                    ids.append(slots[at[t] : at[t + 1]])
                    row.append(np.full(at[t + 1] - at[t], r))
            if not ids:
                continue
            ids, row = np.concatenate(ids), np.concatenate(row)
            n = np.maximum(1, np.bincount(row, minlength=len(part)))[:, None]
            x = np.stack([np.bincount(row, emb[ids, k], len(part)) for k in range(WIDTH)], 1) / n
            z = x @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[part][:, None] / len(part)
            gx, gs, gb = (p @ soft.T) / n, x.T @ p, p.sum(0)
            used, back = np.unique(ids, return_inverse=True)
            ge = np.stack([np.bincount(back, gx[row, k], len(used)) for k in range(WIDTH)], 1)
            seen[used] += (ge * ge).mean(1, keepdims=True)
            emb[used] -= rate * ge / np.sqrt(seen[used])
            seen_soft += gs * gs
            soft -= 0.2 * rate * (gs / np.sqrt(seen_soft)).astype(np.float32)
            seen_bias += gb * gb
            bias -= 0.2 * rate * (gb / np.sqrt(seen_bias)).astype(np.float32)
    return Model(emb, soft, bias)


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """The bounded sample: (doc_id, toxic, text)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    pick = lambda kind, n: known.where(F.col("toxic") == kind).orderBy("h", "doc_id").limit(n)
    ids = pick(1, positives).unionByName(pick(0, negatives)).drop("h")  # at most positives + negatives rows
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    # An id may repeat: the driver gets a bounded number of rows of each.
    one = found.dropDuplicates(["doc_id", "text"]).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return one.where(F.col("r") <= COPIES).drop("r")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for part in _text.slices(b):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(part.column("text")), pa.float64())], ["doc_id", "score"])

    return _shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).orderBy("doc_id", "text").collect()
    model = fit([r.text for r in rows], [int(r.toxic) for r in rows])
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
