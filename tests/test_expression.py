import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartolex.functions import expression as ex
from cartolex.functions.color import parse
from cartolex.functions.legacy import convert
from cartolex.plans.style import Style, StyleError, dependency, run_style


def evaluate(spark, cases):
    """Values and error flags of constant-row expressions over one small table."""
    df = spark.createDataFrame([("abc", 5.0, None, ["x", "y", "z"])], "s string, n double, missing double, tags array<string>")
    out = []
    for i, e in enumerate(cases):
        node = ex.compile_expr(e, ex.Context(df.schema, zoom=3))
        out += [node.value.alias(f"v{i}"), (F.lit(False) if node.err is None else ex.truth(node.err)).alias(f"e{i}")]
    row = df.select(*out).first()
    return [("error" if row[f"e{i}"] else row[f"v{i}"]) for i in range(len(cases))]


def test_values(spark):
    cases = [
        (["+", 1, ["get", "n"]], 6.0),
        (["/", 1, 0], math.inf),
        (["%", -5, 3], 1.0),
        (["%", 5, -3], -1.0),
        (["round", -2.5], -3.0),
        (["max", 1, ["get", "n"]], 5.0),
        (["+", ["get", "missing"], 1], "error"),
        (["coalesce", ["get", "missing"], 7], 7.0),
        (["all", False, ["==", ["number", ["get", "s"]], 1]], False),
        (["any", True, ["boolean", ["get", "s"]]], True),
        (["upcase", "é"], "é"),
        (["concat", "a", ["get", "n"], ["get", "missing"]], "a5"),
        (["slice", ["get", "s"], -2], "bc"),
        (["index-of", "c", ["get", "s"]], 2.0),
        (["at", 1, ["get", "tags"]], "y"),
        (["at", 9, ["get", "tags"]], "error"),
        (["in", "", ["get", "s"]], True),
        (["in", "z", ["get", "tags"]], True),
        (["to-number", "1d"], "error"),
        (["to-number", "x", " 4 "], 4.0),
        (["match", ["get", "s"], ["abc", "d"], 1, 2], 1.0),
        (["case", [">", ["get", "n"], 3], "big", "small"], "big"),
        (["step", ["zoom"], 0, 3, 1, 5, 2], 1.0),
        (["interpolate", ["linear"], ["get", "n"], 0, 0, 10, 100], 50.0),
        (["interpolate", ["exponential", 2], ["zoom"], 1, 0, 5, 15], 3.0),
        (["let", "a", 2, ["*", ["var", "a"], ["var", "a"]]], 4.0),
        (["==", "ue", "ü", ["collator", {"locale": "de"}]], True),
        (["to-string", ["rgb", 255, 0, 0]], "rgba(255,0,0,1)"),
        (["to-rgba", ["interpolate-hcl", ["linear"], 0, 0, "red", 1, "blue"]], None),
        (["ln", 0], -math.inf),
    ]
    got = evaluate(spark, [c for c, _ in cases])
    for (case, want), have in zip(cases, got, strict=True):
        if want is None:
            assert [round(x, 2) for x in have] == [255.0, 0.0, 0.0, 1.0], case
        elif isinstance(want, float):
            assert have == pytest.approx(want), case
        else:
            assert have == want, case


@pytest.mark.parametrize("bad", [["nope"], ["==", 1], ["match", ["get", "s"], "a", 1, "a", 2, 3], ["+", "a", 1], ["interpolate", ["linear"], ["zoom"], 2, 1, 1, 2], ["let", "a b", 1, 2], ["var", "x"], ["<", 1, "a"], ["array"], []])
def test_compile_errors(spark, bad):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ex.CompileError):
        ex.compile_expr(bad, ex.Context(df.schema, zoom=1))


def test_colors():
    assert parse("#f00") == (1.0, 0.0, 0.0, 1.0)
    assert parse("rgba(255, 0, 0, 50%)") == (1.0, 0.0, 0.0, 0.5)
    assert parse("hsl(120, 100%, 50%)") == pytest.approx((0.0, 1.0, 0.0, 1.0))
    assert parse("no color") is None


def test_legacy():
    assert convert({"type": "identity", "property": "a"}) == ["number", ["get", "a"]]
    assert convert({"stops": [[0, "x{a}"]]}, "string", False) == ["concat", "x", ["to-string", ["get", "a"]]]


def test_dependency():
    assert dependency(["literal", ["zoom"]]) == "constant"
    assert dependency(["+", ["zoom"], ["get", "a"]]) == "zoom_and_data"


def test_style(spark):
    with pytest.raises(StyleError):
        Style.parse({"version": 7})
    style = Style.parse({"version": 8, "layers": [
        {"id": "a", "type": "fill", "source": "s", "filter": [">", ["get", "v"], 1], "paint": {"fill-opacity": ["number", ["get", "name"]], "nope": 1}},
        {"id": "b", "type": "fill", "source": "s", "filter": ["in", "class", "a", "b"]},
        {"id": "c", "type": "circle"},
    ]})
    assert [(d.layer, d.property) for d in style.diagnostics] == [("a", "nope"), ("c", "type")]
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 3.0, "y"), (3, 2.0, "z")], "feature_seq int, v double, name string")
    rows = run_style(style, {"s": df}, 4, ["feature_seq"]).orderBy("rank").collect()
    assert [(r.layer_id, r.feature_seq, r.eval_errors) for r in rows] == [("a", 2, 1), ("a", 3, 1)]  # the broken filter drops layer b
    assert run_style(style.with_filter("a", None), {"s": df}, 4, ["feature_seq"]).count() == 3


def test_numbers_as_text(spark):
    cases = [(12345678.5, "12345678.5"), (1e-5, "0.00001"), (-2.5e-7, "-0.00000025"), (1e21, "1" + "0" * 21), (1.5e16, "15000000000000000"), (-0.1, "-0.1"), (1e15, "1" + "0" * 15), (0.0, "0")]
    df = spark.createDataFrame([(a, b) for a, b in cases], "n double, want string")
    node = ex.compile_expr(["to-string", ["get", "n"]], ex.Context(df.schema))
    assert [r for r in df.select("want", node.value.alias("got")).collect() if r.want != r.got] == []


def test_shortest_digits(spark):
    """Python's digits, for numbers of which Java before 19 writes more digits or others."""
    cases = [295149e15, -295151e15, 1.873988e21, 8.41e21, 2e23, 1.5407940180730414e18, 7.258534178141347e16, 3.8611770477906935e25, 999999999999999936.0, 2.0**-44, 2.0**-24, 2.0**90, 2.0**127, 5.0**23 * 2.0**75, 8.487983164e-314, 5e-324, 0.1 + 0.2, 1.7976931348623157e308]
    df = spark.createDataFrame([(x, format(Decimal(repr(x)), "f").removesuffix(".0")) for x in cases], "n double, want string")
    cx = ex.Context(df.schema)
    text, listed = (ex.compile_expr(e, cx) for e in (["to-string", ["get", "n"]], ["to-string", ["semiliteral", [["get", "n"]]]]))
    rows = df.select("want", text.value.alias("got"), listed.value.alias("listed")).collect()
    assert [r for r in rows if r.want != r.got or r.listed != f"[{r.want}]"] == []


def test_number_format(spark):
    cases = [
        (0.49999995, {"currency": "JPY"}, "¥0"), (0.5, {"currency": "JPY"}, "¥1"), (-0.4, {"currency": "JPY"}, "¥0"), (999.5, {"currency": "JPY"}, "¥1,000"), (4503599627370495.5, {"currency": "JPY"}, "¥4,503,599,627,370,496"),
        (1.005, {"currency": "USD"}, "$1.01"), (-1234567.895, {"currency": "USD"}, "-$1,234,567.90"), (1e30, {"currency": "USD"}, "$1" + ",000" * 10 + ".00"), (295149e15, {"unit": "meter"}, "295,149" + ",000" * 5 + " m"),
        (999.9995, {"unit": "kilometer"}, "1,000 km"), (12.04, {"unit": "kilometer"}, "12.04 km"), (1234567.0, {"min-fraction-digits": 1, "max-fraction-digits": 4}, "1,234,567.0"), (0.12345, {"min-fraction-digits": 1, "max-fraction-digits": 4}, "0.1235"), (1e-7, {"max-fraction-digits": 20}, "0.0000001"),
    ]
    df = spark.createDataFrame([([x for x, *_ in cases],)], "n array<double>")
    cx = ex.Context(spark.createDataFrame([], "n double").schema)
    for i, (x, options, want) in enumerate(cases):
        got = df.select(df.n[i].alias("n")).select(ex.compile_expr(["number-format", ["get", "n"], options], cx).value).first()[0]
        assert got == want, (x, options)
    missing = spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "n double").select(ex.compile_expr(["number-format", ["get", "n"], {"unit": "mile"}], cx).value)
    assert [r[0] for r in missing.collect()] == [None] * 3


def test_number_format_is_small(spark):
    """Each text is built in few places: the optimizer copies a column wherever a step reads it."""
    df = spark.createDataFrame([], "n double")
    node = ex.compile_expr(["number-format", ["get", "n"], {"unit": "kilometer"}], ex.Context(df.schema))
    assert df.select(node.value)._jdf.queryExecution().optimizedPlan().toString().count("format_number(") <= 8


def test_new_operators(spark):
    area = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}
    got = evaluate(spark, [
        ["join", ["get", "tags"], ["get", "s"]],
        ["interpolate", ["linear"], ["get", "n"], 0, ["number", ["get", "s"]], 5, 1, 6, 2],
        ["interpolate", ["linear"], ["get", "n"], 0, ["number", ["get", "s"]], 1, 1, 6, 2],
        ["number-format", 5, {"currency": "JPY"}],
        ["number-format", 1234.5, {"unit": "meter"}],
        ["number-format", 1, {"currency": "XXX"}],
        ["has", ["concat", "miss", "ing"]],
        ["to-string", ["semiliteral", [1, ["get", "n"]]]],
        ["within", area],
        ["distance", area],
        ["case", ["==", ["get", "n"], 5], "hotpink", ["rgb", 0, 0, 0]],
    ])
    assert got[:9] == ["xabcyabcz", "error", 1.8, "¥5", "1,234.5 m", "error", False, "[1,5]", False]
    assert got[9] == "error" and round(got[10]["g"] * 255) == 105
    for bad in (["format"], ["format", "a", {"vertical-align": "middle"}], ["within", {"type": "Point"}], ["semiliteral", [["get", "n"], "a"]], ["distance", 5], ["object"]):
        with pytest.raises(ex.CompileError):
            ex.compile_expr(bad, ex.Context(spark.createDataFrame([], "n double").schema))


def test_diagnostics_of_constants_and_expressions(spark):
    style = Style.parse({"version": 8, "layers": [{"id": "a", "type": "line", "paint": {"line-width": True, "line-color": "#12", "line-opacity": ["*"], "line-dasharray": [1, "x"]}, "layout": {"line-cap": "round", "line-join": ["var", "q"]}}, {"id": "b", "type": "fill", "source": "s", "filter": ["==", ["nop"], 1]}]})
    said = style.check({"s": spark.createDataFrame([], "n double").schema})
    assert {(d.layer, d.property) for d in said} == {("a", "line-color"), ("a", "line-dasharray"), ("a", "line-join"), ("a", "line-width"), ("b", "filter")}
    assert [x.id for x in style.layers] == ["a", "b"] and style.layers[0].settings == {"line-cap": "round", "line-opacity": ["*"]}
