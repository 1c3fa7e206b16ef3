import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cartolex.llm import _text, decontam, htmltext, jaccard, packing, quality, suffixdedup, toxicity, warc
from cartolex.llm.components import components
from cartolex.llm.induced import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 150))) for _ in range(n)]
    texts[5] = texts[4]
    texts[7] = texts[6] + " extra words here"
    texts[8] = texts[6].upper()
    passage = " ".join(rng.choices(words, k=30))
    for i in (10, 11, 12, 13):
        texts[i] = texts[i] + " " + passage + " " + texts[i][:40]
    return [*texts, None, "", " \t\n", "é" * 70, "é" * 70 + "x", "one two", "one two", "One TWO"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 7, 9) for i, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_words_match_a_regex():
    texts = corpus()
    w = _text.Words(pa.array(texts, pa.string()))
    want = [x.lower() if x.isascii() else x for t in texts for x in WORD.findall(t or "")]
    assert [bytes(w.raw[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == want
    assert len(set(w.hash.tolist())) == len(set(want))


def test_jaccard(spark):
    texts = corpus()
    got = {r.doc_id: r for r in jaccard.similarity_components(frame(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 4 * len(a & sets[j]) >= 3 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_signature_tree_loses_nothing():
    rng = np.random.default_rng(0)
    n = 400
    sizes = rng.integers(5, 60, n)
    sets = [set(rng.integers(0, 90, s).tolist()) for s in sizes]
    sizes = np.array([len(s) for s in sets])
    on = np.zeros((n, 256), bool)
    for i, s in enumerate(sets):
        on[i, [x * 7 % 256 for x in s]] = True
    tree = jaccard.Tree(sizes.astype(np.int64), np.packbits(on, axis=1).view(np.uint64), np.lexsort((sizes,)))
    found = {tuple(sorted(p)) for i, j in jaccard.dual(tree, tree, True) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert want <= found


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 35), (40, 40)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 35: 30, 40: 40}


def cut(texts):
    first, out = {}, []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if b[i : i + 50] in first:
                gone[i : i + 50] = True
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], 1)
        own = {}
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if b else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), own))
    return out


def test_suffix_dedup(spark):
    texts = corpus(3)
    texts.append((texts[10] + " tail ") * 3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == {i: r[:4] for i, r in enumerate(cut(texts))}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(100):
        t = np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 60))), 0)
        assert suffix_array(t, 6).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_quality(spark):
    texts = corpus() + ["a b c d e f a b c d e f g", "x\nx\n\ny", "# # # | <>"]
    for r in quality.apply_policy(quality.ledger(frame(spark, texts))).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen, again = {}, set()
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                again.update(i + k for i in at for k in range(5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    book = quality.ledger(frame(spark, texts)).cache()
    rules = {r.rule: r for r in quality.ablations(book).collect()}
    assert rules["few_words"].n_failed == sum(len(WORD.findall(t or "")) < 10 for t in texts)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_warc(spark, tmp_path, chunk):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/\n", "<p>x</p>"), (4, "u", ""), (None, "u", "<p>x</p>"), (6, "u", "é" * 500)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/w"
    warc.write_archive(df, path, chunk)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()), key=str)
    digest = lambda t: warc.base32(hashlib.sha1(t.encode()).digest())
    x, none, long = "<p>x</p>", "", "é" * 500
    want = [(1, 8, digest(x), "revisit", 3), (2, 0, digest(none), "revisit", 4), (3, 8, digest(x), "response", None), (4, 0, digest(none), "response", None), (None, 8, digest(x), "response", None), (6, 1000, digest(long), "response", None)]
    assert got == sorted(want, key=str)
    rows = spark.read.parquet(path)
    assert max(len(r.data) for r in rows.select("data").collect()) <= max(chunk, 500) + 4
    warc.export_archive(spark, path, rows.select("archive").first()[0], str(tmp_path / "x.warc"))
    assert (tmp_path / "x.warc").read_bytes().startswith(b"WARC/1.1\r\n")


def test_packing(spark):
    assert packing.boundaries({1: 5, 2: 5, 9: 1, 10: 4}, 2) == [2, 10]
    rng = random.Random(2)
    h = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(9)}
    cost = lambda cuts: sum(n * (min(c for c in cuts if c >= s) - s) for s, n in h.items())
    from itertools import combinations

    best = min(cost([*c, max(h)]) for c in combinations([s for s in h if s != max(h)], 2))
    assert cost(packing.boundaries(h, 3)) == best
    texts = corpus()
    rows = packing.pack(frame(spark, texts), max_len=40, buckets=3, budget=100).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= r.padded <= 40
    assert total == {i: len(WORD.findall(t or "")) + 1 for i, t in enumerate(texts)}
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for own in batches.values():
        assert sum(r.padded for r in own) <= 100 and sorted(r.slot for r in own) == list(range(len(own)))


def test_toxicity_finds_words_and_misspellings():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(5)) for _ in range(200)]
    texts, labels = [], []
    for i in range(300):
        t = rng.choices(words, k=rng.randint(5, 200))
        if i % 3 == 0:
            t.insert(rng.randrange(len(t)), rng.choice(["dreadfulword", "horridthing"]))
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:200], labels[:200])
    p = model.score(pa.array(texts[200:]))
    y = np.array(labels[200:])
    assert ((p >= toxicity.THRESHOLD) == y).mean() > 0.95
    assert model.score(pa.array([" ".join(words[:100]) + " dreadfulwird"]))[0] > 0.3
    assert model.score(pa.array([None, ""], pa.string())).shape == (2,)
    assert toxicity.fit([], []).score(pa.array(["x"]))[0] == 0.0


def test_decontamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(6)) for _ in range(600)]
    items = [(i, " ".join(rng.choices(words, k=40)) + ". " + " ".join(rng.choices(words, k=8)) + ".") for i in range(6)] + [(9, None), (10, "")]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 300))) for _ in range(30)]
    texts[3] += " " + items[2][1]
    paraphrase = items[4][1].split()
    for k in range(3, 48, 6):
        paraphrase[k] = "changed"
    texts[8] = texts[8] + " " + " ".join(paraphrase) + " " + texts[9]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, [*texts, None, ""]), bench).collect()}
    assert got == {(3, 2), (8, 4)}
    assert decontam.clean(frame(spark, texts), bench).count() == 28
    assert decontam.leaks(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontam.common(np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 3, 8, 4], np.uint64)) == 3


def test_decontamination_wants_close_words(spark):
    rng = random.Random(8)
    common, rare = "the of to and is was that it for on".split(), ["".join(rng.choice("abcdeghilmnorstu") for _ in range(7)) for _ in range(40)]
    item = rng.choices(common, k=14) + rare[:4]
    scattered = [x for w in item for x in (w, *rng.choices(rare[10:], k=5))]
    bench = spark.createDataFrame([(1, " ".join(item) + ".")], "item_id long, text string")
    texts = [" ".join(rng.choices(common + rare[10:], k=200)) for _ in range(20)] + [" ".join(scattered), "x y z " + " ".join(item) + " z y"]
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), bench).collect()] == [(21, 1)]
    assert decontam.closest(np.arange(4, dtype=np.uint64), np.array([0, 9, 1, 9, 2, 9, 3, 0, 1, 2], np.uint64))[0] == 3


def test_html(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<p>Four<div class=comments><p>nice</div></article><footer>foot</footer><script>x='<p>'</script>"
    plain = "<body><div class=top>Site</div><div class=text><p>Words of page {0} that differ.</p></div><div class=foot>Same end</div></body>"
    rows = [(1, "http://a.org/1", page), (2, "http://a.org/2", None), (3, None, "text only <i>here</i>"), *((10 + i, f"http://b.org/{i}", plain.format(i)) for i in range(5))]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[1] == "Title & more One two three Four"
    assert got[2] == "" and got[3] == "text only here"
    assert all(got[10 + i] == f"Words of page {i} that differ." for i in range(5))


def test_html_slots_of_several_blocks(spark):
    page = (
        "<body><ul class=m>{links}</ul><div class=c7><p>Same first words</p><p>Same second words</p><ul><li>and<li>points</ul></div>"
        "<div class=c8><p>Own words {0}.</p><p>Same in all.</p><ul><li>Point {0}<li>more</ul></div></body>"
    )
    links = lambda i: "".join(f"<li><a href=/{i}/{k}>Topic {i * k}</a>" for k in range(6))
    rows = [(i, f"http://b.org/{i}", page.format(i, links=links(i))) for i in range(5)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words {i}. Same in all. Point {i} more" for i in range(5)}


def test_toxicity_fits_on_whole_texts(spark):
    docs = spark.createDataFrame([(i, "plain words " * 4000 + f"dreadfulword {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert rows and all(r.text.endswith(f"dreadfulword {r.doc_id}") for r in rows)


def test_clean_judges_rows_of_null_id_one_by_one(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(6)) for _ in range(300)]
    item, other = (" ".join(rng.choices(words, k=40)) for _ in range(2))
    rows = [(None, f"a b {item} c"), (None, other), (None, other), (None, None), (None, f"a b {item} c"), (1, f"x {item}"), (2, other), (0, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, other), (None, other), (None, None), (2, other), (0, "y z")], key=str)


def test_decontamination_without_the_rare_words(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdeghilmnorstu") for _ in range(n))
    common, rare = [word(5) for _ in range(150)], [word(8) for _ in range(400)]
    items, texts = [], [" ".join(rng.choices(common, k=200)) for _ in range(30)]
    for i in range(12):
        own = [w for a, b in zip(rng.sample(common, 24), rng.sample(rare, 24), strict=True) for w in (a, b)][: 30 if i % 2 else 48]
        items.append((i, " ".join(own)))
        kept = [w if w in common or k >= len(own) - 8 else word(9) for k, w in enumerate(own)]  # the answer stays
        texts.append(" ".join([*rng.choices(common, k=60), *kept, *rng.choices(common, k=40)]))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = lambda t: np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint64)
    want = set()
    for d, text in enumerate(texts):
        for i, item in items:
            own, said = words(item), words(text)
            cuts = np.linspace(0, len(own), -(-len(own) // decontam.BLOCK) + 1).astype(int)
            found = [decontam.closest(own[a:b], said) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            n = sum(m for (m, _), a, b in zip(found, cuts[:-1], cuts[1:], strict=True) if 3 * m >= b - a)
            answer = decontam.common(own[-8:], found[-1][1])
            if n >= 0.75 * len(own) or n >= 0.5 * len(own) and answer >= 0.6 * 8:
                want.add((d, i))
    assert {(30 + i, i) for i in range(12)} <= want and got == want


@pytest.mark.parametrize("element", ["article", "main", "div", ""])
def test_html_slots_in_an_article(spark, element):
    body = "<div class=x1><p>Same words</p><p>on all pages</p></div><h1>Title {0}</h1><p>Own words {0}.</p><p>More {0}.</p><ul class=x2><li><a href=/a>Topic {0}</a><li><a href=/b>Other</a></ul>"
    page = "<body><nav>Site</nav>" + (f"<{element}>{body}</{element}>" if element else body) + "<footer>Foot {0}</footer></body>"
    rows = [(i, f"http://b.org/{i}", page.format(i)) for i in range(5)] + [(10 + i, f"http://c.org/{i}", "<article><h1>One</h1><p>page</p></article>") for i in range(4)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Own words {i}. More {i}." for i in range(5)} | {10 + i: "One page" for i in range(4)}


def test_empty_tables(spark):
    none = empty(spark)
    assert jaccard.similarity_components(none).count() == 0
    assert suffixdedup.remove_repeats(none).count() == 0
    assert quality.ledger(none).count() == 0
    assert packing.pack(none).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
