"""Error-correcting output codes and the language identifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import empty

from cartolex.llm import langid

EN, DE, SV = "the quick house and with that this ", "der schnelle und nicht die haus mit ", "det snabba huset och inte med som "


def features(text):
    return langid.features(np.frombuffer(text.encode(), np.uint8))


@pytest.mark.parametrize("k", [2, 3, 4, 5, 7, 8, 30])
def test_columns_are_distinct_questions(k):
    code = langid.codewords(k)
    assert (np.abs(code.sum(0)) < k).all()  # none is constant
    both = np.concatenate([code, -code], 1)
    assert len(np.unique(both, axis=1).T) == 2 * code.shape[1]  # none repeats another or its negation
    apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert min(apart) >= (3 if k > 3 else 1)


@pytest.mark.parametrize("k", [4, 6, 12])
def test_one_wrong_bit_is_corrected(k):
    code = langid.codewords(k)
    model = langid.Model([str(i) for i in range(k)], code, None, None, np.ones(code.shape[1], np.float32))
    for i in range(k):
        for bit in range(code.shape[1]):
            margins = 2 * code[i].copy()
            margins[bit] *= -1
            assert model.decode(margins)[0] == i


def test_ambiguity_is_flagged():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, None, None, np.ones(7, np.float32))
    assert not model.decode(3 * code[1])[2]
    assert model.decode((code[1] + code[2]) / 2)[2]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 7) for r in rows], "doc_id long, text string, lang string, source string, h long")


def test_language(spark):
    rows = [(i, (EN, DE, SV)[i % 3] * (1 + i % 5), ("en", "de", "sv")[i % 3]) for i in range(60)]
    rows += [(90, None, "en"), (91, "123 !", None), (None, EN, "de"), (92, "", "sv"), (93, EN * 3000, None), (1, DE, "de"), (1, DE, "de")]
    df = docs(spark, rows)
    allowed = F.coalesce(langid.fold(4) != 2, F.lit(False))
    model = langid.train(df, allowed)
    assert model.labels == ["de", "en", "sv"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, model).collect()]
    assert len(got) == len(rows)
    want = {r[1]: r[2] for r in rows[:60]}
    for doc, pred, score in got:
        assert 0 <= score <= 1
        text = [r[1] for r in rows if r[0] == doc]
        if doc in (90, 91, 92):
            assert (pred, score) == ("und", 0.0)
        elif doc == 93 or doc is None:
            assert pred == "en"
        elif doc != 1:
            assert pred == want[text[0]]


def test_sample_is_bounded(spark):
    rows = [(i, EN + str(i), f"l{i % 7}") for i in range(300)] + [(5, EN, "l5")] * 50 + [(900 + i, EN, "rare") for i in range(3)] + [(999, "1 2 3", "l0"), (998, None, "l0")]
    got = langid.training_rows(docs(spark, rows), F.lit(True), per_class=10, most_labels=3).groupBy("lang").count().collect()
    counts = {f"l{i}": sum(r[2] == f"l{i}" and r[0] < 990 for r in rows) for i in range(7)}
    most = sorted(counts, key=lambda c: (-counts[c], c))[:3]
    assert {r[0]: r[1] for r in got} == dict.fromkeys(most, 10)


def test_few_labels_and_empty_tables(spark):
    none = empty(spark)
    model = langid.train(none, F.lit(True))
    assert model.labels == [] and langid.identify(none, model).count() == 0
    assert model.predict(np.frombuffer(b"x", np.uint8)) == ("und", 0.0, True)
    one = langid.fit([features(EN)], ["en"])
    assert one.predict(np.frombuffer(DE.encode(), np.uint8)) == ("en", 1.0, False)
