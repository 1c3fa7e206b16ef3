"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1. One linear classifier per bit, over
hashed byte n-grams, predicts that bit; a text's language is the codeword of
least loss-weighted distance to the predicted bits. The weights of the bits come
from their error on training rows. Bits that agree with no codeword, or with two
about as well, flag the text as ambiguous.

Only ``text`` is read to predict. The classifiers are fitted on a bounded
sample: of the ``most_labels`` labels with most rows, the ``per_class`` texts of
each with the smallest hash of the id. Workers reduce these texts, whole, to
their n-gram frequencies (at most ``DIM`` of them each), which is what the driver
gets. Predictions cover all rows and whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; one
label or none in the training rows gives that label or ``und`` everywhere; a null
id is not in the held-out part (its remainder is null), is not learned from, and
is predicted like others; labels of equal score go to the first by name;
repeated rows predict alike; extra columns are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared, _text

U = np.uint64
DIM, ORDERS = 1 << 14, (1, 2, 3)
PER_CLASS, MAX_LABELS = 320, 256
SALTS, FINALISTS = 64, 4
EPOCHS, RATE, DECAY, AMBIGUOUS = 40, 4.0, 1e-5, 0.15


def features(raw: np.ndarray, dim: int = DIM, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(used slots, square-root frequencies of unit length) of one text's byte n-grams; white space and digits are one symbol."""
    b = _FOLD[raw].astype(np.uint32)
    n = len(b)
    ids = []
    gram = b.copy()
    for k in range(1, max(orders) + 1):
        if k > 1:
            if n < k:
                break
            gram = gram[: n - k + 1] * np.uint32(0x01000193) ^ b[k - 1 :]
        if k in orders:
            x = (gram + np.uint32(k)) * np.uint32(0x9E3779B1)
            ids.append(x >> np.uint32(32 - (dim.bit_length() - 1)))
    counts = np.bincount(np.concatenate(ids), minlength=dim) if ids else np.zeros(dim, np.int64)
    used = np.flatnonzero(counts)
    v = np.sqrt(counts[used])
    return used, (v / max(1e-12, np.sqrt((v * v).sum()))).astype(np.float32)


_FOLD = _text._LOWER.copy()
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1; no two columns ask the same question, and none asks nothing.

    Up to 7 labels: the exhaustive code, all 2**(k-1) - 1 ways to part the labels
    in two, whose rows differ in 2**(k-2) bits (4 labels: 7 bits, of which any one
    may be wrong). More labels: of some fixed pseudo-random sets of distinct
    columns, the one whose closest rows are farthest apart.
    """
    if k < 2:
        return np.zeros((k, 0), np.float32)
    if k <= 7:
        columns = np.arange(1, 1 << (k - 1))  # the first label is always +1
        return (1 - 2 * (columns[None, :] >> np.arange(k - 1, -1, -1)[:, None] & 1)).astype(np.float32)
    bits = 15 + 6 * int(np.ceil(np.log2(k)))
    rng, best = np.random.default_rng(7), (-1, None)
    for _ in range(64):
        code, seen = np.zeros((k, bits), np.float32), set()
        while len(seen) < bits:
            c = rng.permutation(np.where(np.arange(k) < k // 2, 1.0, -1.0))
            c *= c[0]
            if c.tobytes() not in seen:
                code[:, len(seen)] = c
                seen.add(c.tobytes())
        apart = (bits - code @ code.T) / 2
        least = int((apart + np.eye(k) * bits).min())
        if least > best[0]:
            best = least, code
    return best[1]


class Model:
    """labels, codewords (k, L), weights (dim, L), bias (L), trust (L): how much each bit counts."""

    def __init__(self, labels, code, w, bias, trust):
        self.labels, self.code, self.w, self.bias, self.trust = labels, code, w, bias, trust

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """(label, score in 0..1, ambiguous) by logistic loss, weighted by the bits' trust."""
        loss = (np.logaddexp(0, -2 * self.code * margins) * self.trust).sum(1) / self.trust.sum()
        p = np.exp(-len(self.trust) * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        far = ((np.sign(margins) != self.code[order[0]]) * self.trust).sum() / self.trust.sum() > 0.25
        close = len(p) > 1 and p[order[0]] - p[order[1]] < AMBIGUOUS
        return int(order[0]), float(p[order[0]]), bool(far or close)

    def predict(self, raw: np.ndarray) -> tuple[str, float, bool]:
        if len(self.labels) < 2:
            return (self.labels[0], 1.0, False) if self.labels else ("und", 0.0, True)
        used, v = features(raw)
        label, score, odd = self.decode(v @ self.w[used] + self.bias)
        return self.labels[label], score, odd


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = EPOCHS) -> Model:
    """Logistic classifiers of the bits, all at once, by mini-batch gradient steps in a fixed order. ``rows``: features of each text."""
    names = sorted(set(labels))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, None, None, None)
    y = code[[names.index(c) for c in labels]]
    w, bias = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)

    def dense(at):
        x = np.zeros((len(at), DIM), np.float32)
        for r, i in enumerate(at):
            x[r, rows[i][0]] = rows[i][1]
        return x

    rng = np.random.default_rng(11)
    for e in range(epochs):
        step = RATE / (1 + 0.1 * e)
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            x = dense(at)
            z = x @ w + bias
            g = -2 * y[at] / (1 + np.exp(2 * y[at] * z)) / len(at)
            w *= 1 - step * DECAY
            w -= step * (x.T @ g)
            bias -= step * g.sum(0)
    wrong = np.stack([np.sign(v @ w[used] + bias) != y[i] for i, (used, v) in enumerate(rows)]).mean(0)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.1).astype(np.float32)
    return Model(names, code, w, bias, trust)


def training_rows(docs: DataFrame, allowed, per_class: int = PER_CLASS, most_labels: int = MAX_LABELS) -> DataFrame:
    """(lang, text) of at most ``per_class`` rows, by hash of the id, of each of the ``most_labels`` labels with most rows."""
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id").alias("h"), "text")
    labels = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).select("lang")
    # Hashes alone are ranked, in salted groups first, which bounds what any one task ranks; the chosen ones then find their texts.
    rough = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h")
    fine = Window.partitionBy("lang").orderBy("h")
    ids = rows.select("lang", "h").distinct().join(F.broadcast(labels), "lang").withColumn("r", F.row_number().over(rough)).where(F.col("r") <= max(1, FINALISTS * per_class // SALTS))
    ids = ids.withColumn("r", F.row_number().over(fine)).where(F.col("r") <= per_class).select("lang", "h")  # at most most_labels * per_class rows
    found = rows.join(F.broadcast(ids), ["lang", "h"])
    again = Window.partitionBy("lang").orderBy("h", "text")  # an id may repeat
    return found.withColumn("r", F.row_number().over(again)).where(F.col("r") <= per_class).select("lang", "text")


def _reduced(batches):
    """Label and features of each text."""
    for b in batches:
        for part in _text.slices(b):
            raw, at = _text.utf8(part.column("text"))
            own = [features(raw[at[i] : at[i + 1]]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([u.astype("<u2").tobytes() for u, _ in own], pa.binary()), pa.array([v.tobytes() for _, v in own], pa.binary())], ["lang", "used", "v"])


def train(docs: DataFrame, allowed) -> Model:
    """The model of the bounded sample of allowed rows."""
    sample = _shared.map_arrow(training_rows(docs, allowed), _reduced, "lang string, used binary, v binary")
    rows = sorted((r.lang, r.used, r.v) for r in sample.collect())  # at most MAX_LABELS * PER_CLASS rows of 6 * DIM bytes
    return fit([(np.frombuffer(u, "<u2").astype(np.int64), np.frombuffer(v, np.float32)) for _, u, v in rows], [r[0] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for part in _text.slices(b):
                raw, at = _text.utf8(part.column("text"))
                has = _text.letters(part.column("text"))
                out = [m.predict(raw[at[i] : at[i + 1]]) if has[i] else ("und", 0.0, True) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return _shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fold(divisor: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, F.coalesce(fold(4) != 2, F.lit(False)))
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
