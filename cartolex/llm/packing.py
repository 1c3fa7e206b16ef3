"""Length buckets chosen by dynamic programming, and batches under a token budget.

The lengths of all sequences are counted into one histogram of at most
``max_len`` entries. Dynamic programming over it finds the bucket boundaries
that waste the fewest padding tokens; every sequence pads to its bucket's
boundary. Inside a bucket, sequences in order of length fill batches of
``budget`` tokens.

The place of a sequence in its bucket is a global rank: the histogram by
(length, shard) gives every small group its offset and only the rank within the
group is a window, so no task holds a bucket.

Defined cases: a text longer than ``max_len`` tokens becomes several sequences
(``piece`` 0, 1, ...) that together hold all its tokens; a null or empty text is
one sequence of the end token alone; rows with the same id are told apart by
their text and, if that is the same too, share ranks arbitrarily but each has
its own; rows of null id are dealt by their place in the table; extra columns
are dropped; an empty table gives no batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from .quality import BLANKS

MAX_LEN, BUCKETS, BUDGET, SHARDS = 2048, 12, 65536, 1024


def word_tokens(text: Column) -> Column:
    """Words and one end token; the default counter."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.trim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return (F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " +"))) + 1).cast("int")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ascending bucket boundaries, at most ``buckets``, of least total padding.

    cost(i, j) = boundary_j * (count in i..j) - (tokens in i..j): with prefix
    sums each layer of the dynamic programme is one matrix of the used lengths.
    Ties take the smallest split.
    """
    if not histogram:
        return []
    size = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[int(x)] for x in size], np.int64)
    count = np.concatenate([[0], np.cumsum(n)])
    m = len(size)
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        now, cut = best.copy(), np.arange(m + 1)
        for j in range(1, m + 1):
            total = best[:j] + size[j - 1] * (count[j] - count[:j])
            i = int(np.argmin(total))
            if total[i] < now[j]:
                now[j], cut[j] = total[i], i
        cuts.append(cut)
        best = now
    out, j = [], m
    for cut in reversed(cuts):
        if j and cut[j] != j:
            out.append(int(size[j - 1]))
            j = int(cut[j])
    return out[::-1]


def sequences(docs: DataFrame, max_len: int = MAX_LEN, tokens=word_tokens) -> DataFrame:
    """(doc_id, piece, n_tokens), none longer than ``max_len``."""
    counted = docs.select("doc_id", tokens(F.col("text")).alias("total"))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / max_len).cast("int"), F.lit(1)) - 1)
    return counted.select("doc_id", "total", F.explode(pieces).alias("piece")).select("doc_id", "piece", F.least(F.lit(max_len), F.col("total") - F.col("piece") * max_len).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shards: int = SHARDS, tokens=word_tokens) -> DataFrame:
    """One row per sequence: doc_id, piece, n_tokens, bucket, padded, batch, slot."""
    spark = docs.sparkSession
    if budget < max_len:
        raise ValueError("budget must hold the longest sequence")
    seqs = _shared.materialize(sequences(docs, max_len, tokens).withColumn("shard", F.pmod(F.coalesce("doc_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")), "sequences")
    # At most max_len * shards rows, counted map-side; the driver sees max_len of them.
    cells = seqs.groupBy("n_tokens", "shard").agg(F.count("*").alias("n"))
    counted = {r[0]: r[1] for r in cells.groupBy("n_tokens").agg(F.sum("n")).collect()}
    edges = boundaries(counted, buckets)
    padded = F.lit(max_len)
    for e in reversed(edges[:-1] if edges else []):
        padded = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(padded)
    if edges:
        padded = F.when(F.col("n_tokens") > edges[-2], F.lit(edges[-1])).otherwise(padded) if len(edges) > 1 else F.lit(edges[0])
    index = F.array_position(F.array(*map(F.lit, edges or [max_len])), F.col("padded")).cast("int") - 1
    # Sequences before each length in its bucket: a driver-sized table; before each shard of a length: a window of ``shards`` rows.
    before, base, seen = {}, 0, -1
    for size in sorted(counted):
        b = next(e for e in edges if size <= e)
        base, seen = (0, b) if b != seen else (base, seen)
        before[size] = base
        base += counted[size]
    starts = spark.createDataFrame(sorted(before.items()), "n_tokens int, base long")
    groups = cells.join(F.broadcast(starts), "n_tokens").withColumn("base", F.col("base") + F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece")
    ranked = seqs.withColumn("place", F.row_number().over(inner) - 1).join(groups, ["n_tokens", "shard"])
    rank = F.col("base") + F.col("place")
    fits = F.floor(F.lit(budget) / F.col("padded"))
    return (
        ranked.withColumn("padded", padded.cast("int")).withColumn("bucket", index)
        .select("doc_id", "piece", "n_tokens", "bucket", "padded", F.floor(rank / fits).cast("long").alias("batch"), (rank % fits).cast("int").alias("slot"))
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


