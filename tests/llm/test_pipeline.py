"""Each stage of the pipeline, and the whole, against plain Python on a small table."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_cases import brute_cuts, plain_components

import corpus_pipeline
from cartolex.llm import decontam, packing, quality

SCHEMA = "doc_id long, text string, lang string, n_chars int, row string, kept string, own string, cut_text string, cut_id long, leak_row string"


def texts():
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(40) + ". " + say(9) + ".") for i in range(8)] + [(50, None), (51, "")]
    rows = [(i, say(rng.randint(5, 160))) for i in range(120)]
    passage = "é" + say(30) + " ünd"
    rows += [(200 + i, say(50) + " " + passage[i:] + " " + say(40)) for i in range(6)]  # repeated passages, some cut within a character
    rows += [(300 + i, " ".join([*rows[i + 9][1].split(), f"tail{i}"])) for i in range(10)]  # near copies
    rows += [(320, rows[3][1]), (3, rows[4][1] + " and more"), (3, rows[3][1])]
    changed = items[2][1].split()
    changed[5] = changed[20] = "changed"
    rows += [(400, say(60) + " " + items[1][1] + " " + say(60)), (401, say(70) + " " + " ".join(changed) + " " + say(50))]
    rows += [(None, say(80)), (None, say(40) + " " + items[3][1]), (None, None), (410, None), (411, ""), (412, "w " * 60), (None, rows[7][1])]
    rows.append((500, say(9000)))
    return rows, items


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or ""), "r", "k", "o", "c", 1, "l") for i, t in rows], SCHEMA)


def key(row):
    return -1 if row[0] is None else row[0], row[1] or ""


def plain_quality(rows):
    table = pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    con = duckdb.connect()
    con.register("documents", table)
    good = {i for (i,) in con.sql(f"WITH {quality.quality_cte('documents')} SELECT doc_id FROM quality WHERE kept").fetchall()}
    return [r for i, r in enumerate(rows) if i in good]


def plain_near(rows):
    component = plain_components(rows)
    return [r for r in rows if r[0] is None or component[r[0]] == r[0]]


def plain_repeats(rows):
    left = brute_cuts(rows)
    return [(i, left[i, t].decode("utf-8", "ignore")) for i, t in rows]


def plain_leaks(rows, items):
    bad = set()
    for r, (_, text) in enumerate(rows):
        for _, item in items:
            if not (text or "").split() or not (item or "").split():
                continue
            bench = decontam.Bench([(0, item)])
            w = decontam.tokens(pa.array([text]))
            at, term = decontam.Lookup(bench.terms).of(w.hash)
            said = np.full(len(w.hash), -1, np.int32)
            said[at] = term
            found = [decontam.closest(bench.piece(p), said) for p in range(len(bench.pieces))]
            n = sum(m for (m, _), size in zip(found, bench.length, strict=True) if 3 * m >= size)
            answer = sum(decontam.common(bench.words[0][max(a, bench.answers[0]) : e], t) for (_, t), (_, a, e) in zip(found, bench.pieces, strict=True) if e > bench.answers[0])
            size = len(bench.words[0])
            if n >= 0.75 * size or n >= 0.5 * size and answer >= 0.6 * (size - bench.answers[0]):
                bad.add(r)
    ids = {rows[r][0] for r in bad} - {None}
    return [x for r, x in enumerate(rows) if r not in bad and x[0] not in ids]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rows, items = texts()
    top = tmp_path_factory.mktemp("sf")
    frame(spark, rows).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_and_run_equal_plain_python(spark, folder):
    rows, items = texts()
    plain = [plain_quality, plain_near, plain_repeats, lambda r: plain_leaks(r, items)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain, strict=False):
        docs = frame(spark, rows)
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        got = out.collect()
        before, rows = len(rows), version(rows)
        assert sorted(key((r.doc_id, r.text)) for r in got) == sorted(map(key, rows)), name
        assert all(r.lang == "en" and r.row == "r" and r.kept == "k" and r.cut_id == 1 and r.n_chars == len(r.text or "") for r in got)
        assert len(rows) < before or name == "repeated_passages"
    packed = corpus_pipeline.packing(spark, frame(spark, rows), folder)
    tokens = sum(r.n_tokens for r in packed.collect())
    assert tokens == sum(len((t or "").split()) + 1 for _, t in rows)
    whole = corpus_pipeline.run(spark, folder)
    columns = sorted(set(whole.columns) - {"slot", "batch"})
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, packed.select(columns).collect()))


def test_quality_rules_send_no_row(spark, folder):
    out = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert not any("split" in line for line in plan.splitlines() if "Filter" in line)


def test_empty_table(spark, folder):
    docs = frame(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
    assert packing.pack(docs).count() == 0
