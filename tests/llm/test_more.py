"""Packing, toxicity and quality: defined cases, and the queries themselves on a small scale."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import corpus, empty

from cartolex.llm import packing, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


def plain_padding(lengths, edges):
    return sum(min(e for e in edges if n <= e) - n for n in lengths)


def best_padding(lengths, buckets):
    """Least padding over all choices of boundaries, by recursion over distinct lengths."""
    size = sorted(set(lengths))
    best = {0: 0}
    for _ in range(buckets):
        now = dict(best)
        for j in range(1, len(size) + 1):
            for i, cost in best.items():
                if i < j:
                    own = cost + sum(size[j - 1] - n for n in lengths if (i == 0 or n > size[i - 1]) and n <= size[j - 1])
                    now[j] = min(now.get(j, own), own)
        best = now
    return best[len(size)]


def test_packing_ties_nulls_and_repeated_rows(spark):
    rows = [(i % 7 if i % 5 else None, " ".join(["w"] * (i % 9))) for i in range(80)] + [(3, None), (3, None), (4, " x " * 55)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, piece int")
    got = packing.pack(docs, max_len=20, buckets=3, budget=60, shards=4).collect()
    want = sorted(n for _, t in rows for total in [len((t or "").split()) + 1] for n in [20] * (total // 20) + ([total % 20] if total % 20 else []))
    assert sorted(r.n_tokens for r in got) == want
    assert sum(r.padded - r.n_tokens for r in got) == best_padding(want, 3)
    seen = {(r.bucket, r.batch, r.slot) for r in got}
    assert len(seen) == len(got)
    for r in got:
        assert 0 <= r.slot < 60 // r.padded and (r.slot == 0 or (r.bucket, r.batch, r.slot - 1) in seen)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_query_on_a_whole_table(spark):
    got = queries.QUERIES["op3_packing"](spark, SF).collect()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: len((r.text or "").split()) + 1 for r in texts}
    found = {}
    for r in got:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_tokens
    assert found == tokens
    lengths = [r.n_tokens for r in got]
    edges = sorted({r.padded for r in got})
    assert sum(r.padded - r.n_tokens for r in got) == plain_padding(lengths, edges) and len(edges) <= packing.BUCKETS
    rng = random.Random(2)
    for _ in range(200):  # no other choice of as many boundaries pads less
        other = sorted({*rng.sample(sorted(set(lengths)), min(len(edges) - 1, len(set(lengths)))), max(lengths)})
        assert plain_padding(lengths, other) >= plain_padding(lengths, edges)


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_lm_score", "op7_language_id", "op8_toxicity", "op9_html_text"])
def test_queries_return_what_their_contracts_say(spark, name):
    columns = {
        "op1_decontamination": {"doc_id", "item_id"},
        "op2_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op9_html_text": {"page_id", "url", "text", "n_chars"},
    }[name]
    out = queries.QUERIES[name](spark, SF)
    assert columns <= set(out.columns)
    rows = out.collect()
    table = "pages" if name == "op9_html_text" else "documents"
    if name != "op1_decontamination":
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name == "op7_language_id":
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        held = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_toxicity_sample_and_scores(spark):
    clean, bad = "a quiet walk by the river and home again ", "you filthy wortless scumbag get lost "
    rows = [(i, (bad if i % 4 == 0 else clean) * (1 + i % 3)) for i in range(160)]
    rows += [(8, bad + "x")] * 30 + [(8, bad + str(k)) for k in range(9)] + [(None, bad), (None, None), (500, ""), (501, None), (502, clean * 3000 + bad + clean * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(None, 1), (8, 0), (9, None)], "doc_id long, toxic int")
    sample = toxicity.training_rows(docs, labels).collect()
    assert all(sum(r.doc_id == d for r in sample) <= toxicity.COPIES for d in {r.doc_id for r in sample})
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in sample)
    model = toxicity.fit([r.text for r in sample], [int(r.toxic) for r in sample], epochs=8)
    got = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    score = dict(got)
    assert all((score[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(160) if i != 8)
    assert score[502] >= toxicity.THRESHOLD and score[500] == score[501] == pytest.approx(1 / (1 + np.exp(-model.offset)))
    assert toxicity.score(empty(spark), model).count() == 0
    alone = toxicity.fit(["a"], [1])
    assert [r.score for r in toxicity.score(docs.limit(2), alone).collect()] == [1.0, 1.0]


def test_quality_repeated_rows_and_ablations(spark):
    texts = [t for t in corpus(4) if t] + ["w " * 40, "w " * 40, "", None]
    docs = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    book = quality.ledger(docs)
    kept = quality.apply_policy(book)
    assert kept.count() == len(texts)
    mask = quality.POLICIES[quality.CURRENT] | quality.BASE_MASK
    bits = [r.failures & mask for r in book.collect()]
    got = {r.rule: (r.n_failed, r.n_regained) for r in quality.ablations(book).collect()}
    assert got == {r.name: (sum(b >> r.bit & 1 for b in bits), sum(b == 1 << r.bit for b in bits)) for r in quality.RULES if mask >> r.bit & 1}
    assert quality.ablations(book.where(F.lit(False))).count() == 0
