"""Defined cases of the operators: repeated ids, nulls, ties, hot groups, split paths."""

import hashlib

import numpy as np
import pytest
from test_llm import corpus, empty, frame, shingles

from cartolex.llm import _shared, htmltext, jaccard, suffixdedup, warc

PAGE = "<body><div class=x{c}>Site</div><div class=m><p>Words of {i} that differ.</p><p>More of {i}.</p></div><div class=f>Same end</div></body>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, host string, key long")


def test_vectors_tell_pages_apart():
    both = lambda a, b: (htmltext._mixed(a, 1) + htmltext._mixed(b, 1)) & htmltext._ALL
    assert both(10, 11) != both(12, 13)
    assert len({htmltext._mixed(p, c) for p in range(-50, 50) for c in range(1, 20)}) == 1900


def test_html_repeated_rows_null_ids_and_dealing_by_host(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.format(c=1, i=i)) for i in range(8)] + [(3, "http://a.org/3", PAGE.format(c=1, i=3))] * 2
    rows += [(None, "http://a.org/n", PAGE.format(c=1, i=90)), (None, None, None), (20, "http://b.org/", "<p>alone " + "w " * 40_000)]
    df = pages(spark, rows)
    want = sorted((r[0] if r[0] is not None else -1, f"Words of {k} that differ. More of {k}.") for r, k in zip(rows, [*range(8), 3, 3, 90], strict=False))
    want = sorted([*want, (-1, ""), (20, "alone " + "w " * 39_999 + "w")])
    for options in ({}, {"small": 0, "large": 2}):
        got = htmltext.extract(df, **options).collect()
        assert sorted((r.page_id if r.page_id is not None else -1, r.text) for r in got) == want
        assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(df.limit(0), small=0).count() == 0


def test_warc_repeated_rows_and_long_payloads(spark, tmp_path):
    long = "é" * 5000
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (5, "u", long), (6, "u", long), (6, "v", "other")]
    path = str(tmp_path / "w")
    warc.write_archive(pages(spark, rows), path, chunk_bytes=700)
    got = warc.read_archive(spark, path).collect()
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, 4, "response", None), (1, 4, "revisit", 2), (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 10000, "revisit", 6), (6, 5, "response", None), (6, 10000, "response", None)]
    assert {r.payload_digest for r in got if r.payload_bytes == 10000} == {warc.base32(hashlib.sha1(long.encode()).digest())}
    none = str(tmp_path / "none")
    warc.write_archive(pages(spark, rows).limit(0), none)
    assert warc.read_archive(spark, none).count() == 0


def brute_cuts(rows):
    """(id, text) -> what is left, by a set of all 50-byte strings of smaller ids."""
    out = {}
    for i, text in rows:
        raw = (text or "").encode()
        smaller = {o[k : k + 50] for j, t in rows if i is not None and j is not None and j < i for o in [(t or "").encode()] for k in range(len(o) - 49)}
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in smaller:
                gone[k : k + 50] = b"\1" * 50
        out[i, text] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return out


def test_suffix_dedup_judges_rows_of_one_id_one_by_one(spark):
    a, b, c, *_ = (t for t in corpus(5) if t and len(t) > 200)
    rows = [(1, a), (5, a), (5, b), (6, c[:90] + a[40:160]), (6, c + "x"), (6, c + "x"), (None, a), (None, None), (7, None), (7, ""), (8, b[:49]), (9, b[:50])]
    got = suffixdedup.remove_repeats(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, row string"), with_text=True).collect()
    want = brute_cuts(rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.kept_sha256) for r in got) == sorted((-1 if i is None else i, hashlib.sha256(want[i, t]).hexdigest()) for i, t in rows)
    assert sorted(r.kept for r in got) == sorted(want[r].decode() for r in rows)


@pytest.mark.parametrize("turn", [1, 500])
def test_suffix_dedup_hot_anchor_in_turns(spark, monkeypatch, turn):
    """A passage that all documents share, in different surroundings; the shards in turns of a few bytes."""
    monkeypatch.setattr(suffixdedup, "TURN_BYTES", turn)
    passage = "a passage that every document of this table holds, word by word, and some more of it"
    rows = [(i, f"{i * 7919 % 1000:03d}{hashlib.md5(str(i).encode()).hexdigest()} {passage} {hashlib.sha1(str(i).encode()).hexdigest()}") for i in range(120)]
    got = {r.doc_id: r.kept_sha256 for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_cuts(rows)
    assert got == {i: hashlib.sha256(want[i, t]).hexdigest() for i, t in rows}


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if i is not None and j is not None and sets[x] and sets[y] and 4 * len(sets[x] & sets[y]) >= 3 * len(sets[x] | sets[y]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("leaf, chunk, turns", [(64, 2048, 6), (2, 3, 0), (2, 3, 6)])
def test_jaccard_repeated_ids_and_split_blocks(spark, monkeypatch, leaf, chunk, turns):
    """Chains of near copies whose ends are not linked, ids with several texts, null ids; blocks split at every size."""
    for name, value in (("LEAF", leaf), ("CHUNK", chunk), ("TURNS", turns), ("CROWD", 0), ("FEW", 0)):
        monkeypatch.setattr(jaccard, name, value)
    texts = [t for t in corpus(9, 80) if t]
    rows = list(enumerate(texts))
    base = max(texts, key=len).split()
    for k in range(25):  # each changes one word more
        base = [*base[:-1]]
        base[(k * 5) % len(base)] = f"new{k}"
        rows.append((200 + k, " ".join(base)))
    rows += [(3, texts[10]), (3, texts[20]), (3, texts[3]), (None, texts[0]), (None, None), (300, None), (301, "")]
    got = jaccard.similarity_components(spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, token string, rep long")).collect()
    want = plain_components(rows)
    assert len(got) == len(rows)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)


def test_jaccard_of_a_large_group_with_a_common_passage(spark):
    """Near copies of one text, and a passage that a third of the others share."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:20], f"a{i}", *words[21:90], f"b{i}"])) for i in range(300)]
    rows += [(1000 + i, " ".join([*words[200:230], *(f"c{i}x{k}" for k in range(60))])) for i in range(150)]
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}


def test_jaccard_candidates_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """A group of near copies, and texts that are alike to all of it but linked with none: no candidate for each pair."""
    words = [f"w{i}" for i in range(100)]
    group = [(i, " ".join([*words, f"a{i}"])) for i in range(150)]
    near = [(300 + i, " ".join([*words[:79], *(f"b{i}x{k}" for k in range(13))])) for i in range(20)]
    last = [(200, " ".join([*words, "a0", "c"])), (201, " ".join([*words[12:], "d"]))]
    seen, own = {}, _shared.materialize

    def counted(df, label, **options):
        out = own(df, label, **options)
        seen[label] = max(seen.get(label, 0), out.count())
        return out

    monkeypatch.setattr(_shared, "materialize", counted)
    rows = group + near + last
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)
    assert got[200] == got[201] == 0 and got[300] == 300
    assert max(seen["candidates"], seen.get("open", 0)) < 300  # of 3,000 pairs of the group and those near it, and 190 of those


def test_paired_rows_keep_every_pair_that_a_token_can_link():
    rng = np.random.default_rng(4)
    for _ in range(50):
        run, n = np.sort(rng.integers(0, 12, 60)), rng.integers(1, 30, 60)
        lead = rng.integers(0, 2, 60)
        x, y = n[:, None], n[None, :]
        may = (run[:, None] == run) & (4 * x >= 3 * y) & (lead[:, None] == 1) & ((x < y) | (x == y) & (lead == 1)) & ~np.eye(60, dtype=bool)
        assert jaccard._paired(run, 2 * n + lead)[(may | may.T).any(1)].all()


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.similarity_components(empty(spark)).count() == 0
    got = jaccard.similarity_components(frame(spark, [None, ""])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(0, 0, 0), (1, 0, 1)]


def test_join_deletes_tables_that_are_read(spark, monkeypatch, tmp_path):
    seen, whole = [], jaccard._dealt

    def dealt(held, known, docs):
        seen.append({p.name.split("-")[0] for p in tmp_path.iterdir()})
        out = whole(held, known, docs)
        seen.append({p.name.split("-")[0] for p in tmp_path.iterdir()})
        return out

    monkeypatch.setattr(jaccard._shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(jaccard, "_dealt", dealt)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    got = jaccard.similarity_components(frame(spark, [text, text + " end", "other words that are not like the rest", text, None])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {0: (14, 0), 1: (15, 0), 2: (4, 2), 3: (14, 0), 4: (0, 4)}
    assert {"members", "known", "met"} <= seen[0] and not {"features", "classes", "first"} & seen[0]
    assert "mixed" in seen[1] and "met" not in seen[1]
