"""The n-gram model against a dictionary version of the same formulas."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_llm import WORD, corpus, empty, frame

from cartolex.llm import kneser

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "</s>"]


class Plain:
    """Interpolated modified Kneser-Ney from dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {k: Counter() for k in range(1, order + 1)}
        self.words = Counter()
        for t in texts:
            own = tokens(t)
            self.words.update(own)
            padded = ["<s>"] * (order - 1) + own
            self.counts[order].update(tuple(padded[i : i + order]) for i in range(len(own)))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cuts, self.after = {}, {}
        for k, counts in self.counts.items():
            of = Counter(counts.values())
            self.cuts[k] = kneser.discounts(*(of[i] for i in (1, 2, 3, 4)))
            self.after[k] = defaultdict(list)
            for g, n in counts.items():
                self.after[k][g[:-1]].append(n)

    def cut(self, k, n):
        return 0 if n == 0 else self.cuts[k][min(n, 3) - 1]

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.words) + 1)
        seen = self.after[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        n = self.counts[k][gram]
        return (n - self.cut(k, n) + sum(self.cut(k, m) for m in seen) * self.p(gram[1:])) / sum(seen)

    def score(self, text):
        own = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(own[i : i + self.order]))) for i in range(len(own) - self.order + 1))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    texts = corpus(3)
    texts += texts[20:24]  # repeated rows count each time
    held = ["the end of " + texts[0][:200], texts[6], "unseen words only", None]
    plain = Plain(texts, order)
    model = kneser.train(frame(spark, texts), order, shards=5)
    got = {r.doc_id: r for r in kneser.score(frame(spark, texts + held), model).collect()}
    for i, t in enumerate(texts + held):
        own = tokens(t)
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(plain.words[w] > 0 for w in own), sum(plain.words.values()))
        base = sum(math.log10((plain.words[w] + 0.5) / (sum(plain.words.values()) + 0.5 * (len(plain.words) + 1))) for w in own)
        assert got[i].base_score == pytest.approx(base)


def test_probabilities_sum_to_one(spark):
    texts = ["the cat sat on the mat", "the cat ran", "a dog sat", "the dog ran on", None]
    model = kneser.train(frame(spark, texts), 3, 4)
    vocabulary = sorted({w for t in texts for w in (t or "").split()})
    for context in ("the cat", "sat on", "unseen cat", "un seen"):
        column = pa.array([f"{context} {w}" for w in [*vocabulary, "unknown"]] + [context])
        _, grams, doc = kneser.token_stream(column, 3)
        at = np.flatnonzero(np.diff(doc, prepend=-1)) + 2  # the third token; of the last text, the end
        assert (10 ** model.log10(grams[at])).sum() == pytest.approx(1.0)


def test_counts_of_any_size_and_hot_contexts(spark, monkeypatch):
    big = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert kneser.unpack_counts(kneser.pack_counts(big)).tolist() == big.tolist()
    words = np.array([0, 1, (1 << 48) - 1], np.uint64)
    assert kneser.unpack48(kneser.pack48(words).reshape(-1)).tolist() == words.tolist()
    texts = ["hot " + x for x in ("a", "b", "c") for _ in range(400)]
    monkeypatch.setattr(kneser, "HELD", 50)
    plain, model = Plain(texts, 3), kneser.train(frame(spark, texts), 3, 3)
    got = kneser.score(frame(spark, ["hot a", "hot d"]), model).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx([plain.score("hot a"), plain.score("hot d")])


def test_empty_table_and_null_ids(spark):
    none = empty(spark)
    model = kneser.train(none)
    assert kneser.score(none, model).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "")], "doc_id long, text string")
    got = kneser.score(rows, model).collect()
    assert [r.score for r in got] == [0.0] * 3 and sorted(r.n_tokens for r in got) == [1, 3, 3] and {r.n_known for r in got} == {0}


def test_query_takes_trigrams(spark, tmp_path):
    texts = [f"{a} b {c} d {a} b {c}" for a, c in ("ac", "xy", "ay", "ac", "xc") * 4]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in kneser.op2_lm_score(spark, str(tmp_path)).collect()}
    plain = Plain([t for i, t in enumerate(texts) if not got[i].held_out], 3)
    assert {r.held_out for r in got.values()} == {True, False}
    assert [got[i].score for i in range(len(texts))] == pytest.approx([plain.score(t) for t in texts])


def test_arrays_are_small_and_work_files_go(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 200)) for _ in range(300)]
    monkeypatch.setattr(kneser._shared, "work_path", lambda _, label: f"file://{tmp_path}/{label}")
    kneser.train(frame(spark, texts), 3, shards=2)
    files = [f for f in tmp_path.rglob("*") if f.is_file()]
    grams = len({tuple(g) for t in texts for own in [["", "", *tokens(t)]] for g in zip(own, own[1:], own[2:], strict=False)})
    assert sum(f.stat().st_size for f in files) < 14 * grams  # hashes and counts by themselves: 22 of trigrams and bigrams
    assert not [f for f in files if "down" in f.name]


def test_keys_are_found_by_all_bits():
    rng = np.random.default_rng(6)
    for bits, n, shards in ((32, 5000, 1), (44, 30000, 3), (64, 30000, 4), (40, 20000, 2), (64, 3, 1), (52, 30000, 7)):
        key = rng.integers(0, 1 << bits, n, dtype=np.uint64) & np.uint64((1 << bits) - 2)
        key = np.unique(np.concatenate([key, key ^ np.uint64(1), key ^ np.uint64(0x300)]))
        key = key[kneser.shard_of(key, shards, bits) == 0]
        query = np.sort(np.concatenate([key, key ^ np.uint64(2), key ^ np.uint64(0x500), np.array([0, (1 << bits) - 1], np.uint64)]))
        which, at = kneser.find_keys(kneser.code_keys(key, bits, shards), query)
        there = np.flatnonzero(np.isin(query, key))
        assert which.tolist() == there.tolist() and key[at].tolist() == query[there].tolist()


def test_counts_and_rows_come_back():
    rng = np.random.default_rng(7)
    for table in (rng.zipf(1.3, (1, 5000)), rng.zipf(1.2, (5, 90000)), np.array([[1 << 61, 0, 300]])):
        table = np.minimum(table, 1 << 61).astype(np.int64)
        assert np.array_equal(kneser.counts_at(kneser.code_counts(table), np.arange(table.shape[1])), table)
    ids, counts = rng.integers(0, 1 << 32, (500, 3), dtype=np.uint64), rng.zipf(1.3, (4, 500))
    counts = np.minimum(counts, 1 << 61).astype(np.int64)
    got, n = kneser.unpack_rows(kneser.pack_rows(ids, counts))
    rows = lambda i, c: sorted(map(tuple, np.concatenate([i.astype(object), c.T.astype(object)], 1).tolist()))
    assert rows(got, n) == rows(ids, counts)


def test_order_of_keys_is_stable_and_exact():
    rng = np.random.default_rng(8)
    top = np.uint64(1) << np.uint64(63)
    for key in (
        rng.integers(0, 1 << 64, 5000, dtype=np.uint64), rng.integers(0, 50, 5000, dtype=np.uint64), np.sort(rng.integers(0, 9, 99, dtype=np.uint64)),
        rng.integers(0, 2, 5000, dtype=np.uint64) * top + rng.integers(0, 40, 5000, dtype=np.uint64),  # alike in all leading bits that fit beside a place
        np.array([(1 << 64) - 1, 0], np.uint64), np.zeros(3, np.uint64), np.zeros(0, np.uint64),
    ):
        assert kneser.in_order(key).tolist() == np.argsort(key, kind="stable").tolist()
        some, back = kneser.distinct(key)
        assert some.tolist() == sorted(set(key.tolist())) and some[back].tolist() == key.tolist()


@pytest.mark.parametrize("vocabulary", [5000, 1 << 30])  # keys of all bits of ids, and of hashes
@pytest.mark.parametrize("k", [1, 2, 3])
def test_parts_hold_sums_of_all_rows(vocabulary, k):
    rng = np.random.default_rng(9)
    model = kneser.Model("", 3, 4, [vocabulary // 2, vocabulary - vocabulary // 2], 1)
    ids, n = rng.integers(0, 12, (3000, k)) * (vocabulary // 12), rng.integers(1, 6, 3000)
    contexts, times = defaultdict(Counter), Counter()
    for row, x in zip(map(tuple, ids.tolist()), n.tolist(), strict=True):
        contexts[row].update({0: x, min(x, 3): 1})
        times[row] += 1
    for counts, want in ((n, {g: [c[i] for i in range(4)] for g, c in contexts.items()}), (None, {g: [c] for g, c in times.items()})):
        got = {}
        for s, part in enumerate(kneser._parts(ids.astype("<u4"), counts, model)):
            rows, sums = kneser.unpack_rows(part) if part else (np.zeros((0, k), np.uint64), np.zeros((1, 0)))
            assert (kneser.shard_of(model.key(rows), 3, model.bits(k)) == s).all()
            assert not set(got) & set(map(tuple, rows.tolist()))
            got |= dict(zip(map(tuple, rows.tolist()), sums.T.tolist(), strict=True))
        assert got == want


@pytest.mark.parametrize("words, order", [(300, 3), (70_000, 4)])  # n-grams of numbers of words in 64 bits, and by keys
def test_ngrams_of_a_batch(monkeypatch, words, order):
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{i}" for i in rng.permutation(words)[: words // 2 + 7 * j]) for j in range(4)] + [" ".join(f"w{i}" for i in range(words)), None]
    seen: dict[int, int] = {}
    monkeypatch.setattr(kneser.Model, "ids", lambda self, w: np.array([seen.setdefault(x, len(seen)) if x != 1 else 0 for x in w.tolist()], np.uint64))
    seen[1] = 0
    model = kneser.Model("", 3, order, [words + 1], 1)
    got = Counter()
    for batch in kneser._count_grams(model)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]):
        for part in batch.column(1).to_pylist():
            ids, n = kneser.unpack_rows(part)
            got.update(dict(zip(map(tuple, ids.tolist()), n[0].tolist(), strict=True)))
    hashes = {w: h for t in texts for w, h in zip(tokens(t), (kneser.tokens_of(pa.array([t]))[0] >> np.uint64(16)).tolist(), strict=True)}
    own = [["<s>"] * (order - 1) + tokens(t) for t in texts]
    assert got == Counter(tuple(seen[hashes[w]] if w != "<s>" else 0 for w in t[i : i + order]) for t in own for i in range(len(t) - order + 1))


def test_counting_takes_few_sorts(tmp_path):
    """CPU time of a level against that of sorting as many numbers; merging by hash tables and sorting places took several times as long."""
    rng = np.random.default_rng(11)
    for level in (2, 3):
        (tmp_path / str(level)).mkdir()
    model = kneser.Model(str(tmp_path), 8, 3, [1 << 22], 1)
    shard = [i for i in rng.integers(0, 1 << 22, (8, 100_000, 3), dtype=np.uint64)]
    batch = [pa.RecordBatch.from_arrays([pa.array([0] * 8, pa.int32()), pa.array([kneser.pack_rows(i, np.ones((1, len(i)), np.int64)) for i in shard])], ["shard", "a"])]
    numbers = rng.integers(0, 1 << 64, 800_000, dtype=np.uint64)

    def least(f):
        out = []
        for _ in range(3):
            start = time.process_time()
            f()
            out.append(time.process_time() - start)
        return min(out)

    ratio = least(lambda: list(kneser._level(model, 3)(batch))) / least(lambda: np.sort(numbers))
    print(f"a level in the time of {ratio:.1f} sorts")
    assert ratio < 45
