"""Queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions import expression as ex
from cartolex.functions import geo
from cartolex.functions.legacy import convert
from cartolex.operators import archives, layout
from cartolex.plans.style import Layer, Style, dependency, layer_query, property_column, run_style, zoom_pair
from cartolex.sources import png, symbols
from cartolex.streaming.supply import supply_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(name: str, source: str, keys: list[str], exprs: dict, sql: str | None, rounded: tuple[str, ...] = (), **context) -> None:
    """A query that projects expressions beside key columns."""

    @query(name, sql)
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        cx = ex.Context(df.schema, **context)
        out = []
        for alias, e in exprs.items():
            node = ex.compile_expr(e, cx)
            value = node.value if node.err is None else F.when(~ex.truth(node.err), node.value)
            if alias in rounded:
                value = F.round(value, 9)
            out.append(value.alias(alias))
        return df.select(*keys, *out)


def filtered(name: str, source: str, keys: list[str], e, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return df.where(ex.as_filter(ex.compile_expr(e, ex.Context(df.schema)))).select(*keys)


LINE = ["l_orderkey", "l_linenumber"]
get = lambda k: ["get", k]

filtered("expr_eq_filter", "lineitem", LINE, ["==", get("l_returnflag"), "A"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
filtered("expr_cmp_filter", "lineitem", LINE, ["all", [">=", get("l_quantity"), 10], ["<", get("l_quantity"), 25]], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 25")
filtered("expr_all_any_not", "orders", ["o_orderkey"], ["any", ["all", ["==", get("o_orderstatus"), "F"], [">", get("o_totalprice"), 200000]], ["!", ["in", get("o_orderpriority"), ["literal", ["1-URGENT", "2-HIGH", "5-LOW"]]]]],
         "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))")
filtered("expr_in_array", "part", ["p_partkey"], ["in", get("p_size"), ["literal", [1, 7, 14, 21, 49]]], "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 14, 21, 49)")
filtered("expr_in_string", "part", ["p_partkey"], ["in", "EL", ["upcase", get("p_type")]], "SELECT p_partkey FROM part WHERE strpos(translate(p_type, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'EL') > 0")
filtered("filter_error_is_false", "events", ["event_id"], [">", ["to-number", ["slice", get("props"), 6, -1]], 50], r"SELECT event_id FROM events WHERE regexp_matches(trim(substr(props, 7, length(props) - 7)), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') AND TRY_CAST(trim(substr(props, 7, length(props) - 7)) AS DOUBLE) > 50")

project("expr_match", "lineitem", LINE, {"label": ["match", get("l_linestatus"), "O", "open", ["F", "P"], "done", "none"]}, "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'open' WHEN l_linestatus IN ('F', 'P') THEN 'done' ELSE 'none' END AS label FROM lineitem")
project("expr_case", "lineitem", LINE, {"band": ["case", ["<", get("l_quantity"), 10], "small", ["<", get("l_quantity"), 30], "medium", "large"]}, "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band FROM lineitem")
project("expr_coalesce", "events", ["event_id"], {"kind": ["coalesce", get("missing"), get("event_type"), "none"]}, "SELECT event_id, coalesce(event_type, 'none') AS kind FROM events")
project("expr_let_var", "lineitem", LINE, {"net": ["let", "d", ["-", 1, get("l_discount")], ["*", get("l_extendedprice"), ["var", "d"]]]}, "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 9) AS net FROM lineitem", ("net",))
project("expr_step", "orders", ["o_orderkey"], {"tier": ["step", get("o_totalprice"), "low", 50000, "mid", 150000, "high", 300000, "top"]}, "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'top' WHEN o_totalprice >= 150000 THEN 'high' WHEN o_totalprice >= 50000 THEN 'mid' ELSE 'low' END AS tier FROM orders")
project("expr_interp_linear", "orders", ["o_orderkey"], {"w": ["interpolate", ["linear"], get("o_totalprice"), 1000, 1, 100000, 5, 400000, 20]},
        "SELECT o_orderkey, round(CASE WHEN o_totalprice <= 1000 THEN 1 WHEN o_totalprice < 100000 THEN 1 + (o_totalprice - 1000) / 99000 * 4 WHEN o_totalprice < 400000 THEN 5 + (o_totalprice - 100000) / 300000 * 15 ELSE 20 END, 9)::DOUBLE AS w FROM orders", ("w",))
project("expr_interp_exp", "orders", ["o_orderkey"], {"w": ["interpolate", ["exponential", 1.5], ["/", get("o_totalprice"), 100000], 0, 0, 6, 12]},
        "SELECT o_orderkey, round(CASE WHEN p <= 0 THEN 0 WHEN p < 6 THEN (pow(1.5, p) - 1) / (pow(1.5, 6) - 1) * 12 ELSE 12 END, 9)::DOUBLE AS w FROM (SELECT o_orderkey, o_totalprice / 100000 AS p FROM orders)", ("w",))
project("expr_interp_bezier", "orders", ["o_orderkey"], {"w": ["interpolate", ["cubic-bezier", 0.42, 0, 0.58, 1], ["/", get("o_totalprice"), 100000], 0, 0, 5, 10]}, """
WITH RECURSIVE h AS (
  SELECT o_orderkey, o_totalprice / 100000 / 5 AS t, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS n FROM orders
  UNION ALL
  SELECT o_orderkey, t, CASE WHEN 3 * 0.42 * m * (1 - m) * (1 - m) + 3 * 0.58 * m * m * (1 - m) + m * m * m < t THEN m ELSE lo END, CASE WHEN 3 * 0.42 * m * (1 - m) * (1 - m) + 3 * 0.58 * m * m * (1 - m) + m * m * m < t THEN hi ELSE m END, n + 1
  FROM (SELECT *, (lo + hi) / 2 AS m FROM h WHERE n < 30))
SELECT o_orderkey, round(CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 10 ELSE 10 * (3 * m * m * (1 - m) + m * m * m) END, 9)::DOUBLE AS w FROM (SELECT *, (lo + hi) / 2 AS m FROM h WHERE n = 30)""", ("w",))  # fmt: skip
project("expr_arith", "lineitem", LINE, {"a": ["+", get("l_quantity"), get("l_tax"), 1], "b": ["-", 1, ["*", get("l_quantity"), 2, get("l_discount")]], "c": ["^", get("l_quantity"), 2], "d": ["%", get("l_extendedprice"), 7]},
        "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax + 1, 9) AS a, round(1 - l_quantity * 2 * l_discount, 9) AS b, round(pow(l_quantity, 2), 9) AS c, round(l_extendedprice - 7 * floor(l_extendedprice / 7), 9) AS d FROM lineitem", ("a", "b", "c", "d"))
project("expr_div_zero", "lineitem", LINE, {"q": ["==", ["/", get("l_quantity"), ["-", get("l_linenumber"), 3]], ["/", 1, 0]]},
        "SELECT l_orderkey, l_linenumber, (l_linenumber = 3 AND l_quantity > 0) AS q FROM lineitem")
project("expr_mod_floor", "lineitem", LINE, {"m": ["%", ["-", get("l_quantity"), 25], 7], "n": ["%", ["-", get("l_quantity"), 25], -7]},
        "SELECT l_orderkey, l_linenumber, x - 7 * floor(x / 7) AS m, x + 7 * floor(x / -7) AS n FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x FROM lineitem)")
project("expr_trig", "lineitem", LINE, {"s": ["sin", get("l_quantity")], "c": ["cos", get("l_quantity")], "t": ["atan", get("l_quantity")]}, "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c, round(atan(l_quantity), 9) AS t FROM lineitem", ("s", "c", "t"))
project("expr_log", "lineitem", LINE, {"a": ["ln", get("l_quantity")], "b": ["log10", get("l_extendedprice")], "c": ["log2", get("l_quantity")], "d": ["sqrt", get("l_quantity")]}, "SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 9) AS a, round(log10(l_extendedprice), 9) AS b, round(log2(l_quantity), 9) AS c, round(sqrt(l_quantity), 9) AS d FROM lineitem", ("a", "b", "c", "d"))
project("expr_minmax", "lineitem", LINE, {"lo": ["min", get("l_quantity"), 20, ["*", get("l_linenumber"), 5]], "hi": ["max", get("l_quantity"), 20]}, "SELECT l_orderkey, l_linenumber, least(l_quantity, 20, l_linenumber * 5.0)::DOUBLE AS lo, greatest(l_quantity, 20)::DOUBLE AS hi FROM lineitem")
project("expr_round", "lineitem", LINE, {"r": ["round", ["-", ["/", get("l_quantity"), 2], 10]], "f": ["floor", ["/", get("l_extendedprice"), -3]], "c": ["ceil", ["/", get("l_extendedprice"), 3]], "a": ["abs", ["-", get("l_quantity"), 25]]},
        "SELECT l_orderkey, l_linenumber, (sign(l_quantity / 2 - 10) * floor(abs(l_quantity / 2 - 10) + 0.5))::DOUBLE AS r, floor(l_extendedprice / -3)::DOUBLE AS f, ceil(l_extendedprice / 3)::DOUBLE AS c, abs(l_quantity - 25) AS a FROM lineitem")
project("expr_string_ops", "customer", ["c_custkey"],
        {"cat": ["concat", get("c_mktsegment"), "-", get("c_nationkey")], "up": ["upcase", get("c_name")], "down": ["downcase", get("c_mktsegment")], "n": ["length", get("c_name")], "sl": ["slice", get("c_name"), -4], "ix": ["index-of", "#", get("c_name")], "jn": ["join", ["split", get("c_name"), "#"], "+"]},
        "SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS cat, translate(c_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS down, length(c_name)::DOUBLE AS n, right(c_name, 4) AS sl, (strpos(c_name, '#') - 1)::DOUBLE AS ix, replace(c_name, '#', '+') AS jn FROM customer")
project("expr_to_string", "orders", ["o_orderkey"], {"s": ["to-string", ["floor", get("o_totalprice")]], "k": ["to-string", get("o_custkey")]}, "SELECT o_orderkey, floor(o_totalprice)::BIGINT::VARCHAR AS s, o_custkey::VARCHAR AS k FROM orders")
project("expr_to_number", "events", ["event_id"], {"v": ["to-number", get("event_type"), ["slice", get("props"), 6, -1], -1]}, r"SELECT event_id, CASE WHEN regexp_matches(trim(substr(props, 7, length(props) - 7)), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN trim(substr(props, 7, length(props) - 7))::DOUBLE ELSE -1 END AS v FROM events")
project("expr_to_boolean", "events", ["event_id"], {"b": ["to-boolean", ["-", get("user_id"), 5]], "s": ["to-boolean", get("event_type")]}, "SELECT event_id, user_id <> 5 AS b, event_type <> '' AS s FROM events")
project("expr_typeof", "region", ["r_regionkey"], {"a": ["typeof", ["literal", [1, 2]]], "b": ["typeof", 1], "c": ["typeof", "x"]}, "SELECT r_regionkey, 'array<number, 2>' AS a, 'number' AS b, 'string' AS c FROM region")
project("expr_number_format", "orders", ["o_orderkey"], {"f": ["number-format", get("o_totalprice"), {"min-fraction-digits": 1, "max-fraction-digits": 2}], "u": ["number-format", get("o_totalprice"), {"currency": "USD"}]},
        "SELECT o_orderkey, CASE WHEN right(u, 1) = '0' THEN left(u, length(u) - 1) ELSE u END AS f, '$' || u AS u FROM (SELECT o_orderkey, format('{:,}', p // 100) || '.' || lpad((p % 100)::VARCHAR, 2, '0') AS u FROM (SELECT o_orderkey, (o_totalprice::DECIMAL(18, 2) * 100)::BIGINT AS p FROM orders))")
project("expr_collate_de", "customer", ["c_custkey"], {"same": ["==", get("c_mktsegment"), "buÌlding", ["collator", {"locale": "de"}]], "less": ["<", get("c_mktsegment"), "FURNITURE", ["collator", {"locale": "de"}]]}, "SELECT c_custkey, c_mktsegment = 'BUILDING' AS same, c_mktsegment < 'FURNITURE' AS less FROM customer")
project("expr_collate_sv", "nation", ["n_nationkey"], {"after": [">", "Åland", get("n_name"), ["collator", {"locale": "sv"}]]}, "SELECT n_nationkey, TRUE AS after FROM nation")  # å follows z
project("expr_color_match", "lineitem", LINE, {"c": ["to-rgba", ["match", get("l_returnflag"), "A", ["rgb", 255, 0, 0], "R", ["rgba", 0, 51, 0, 0.5], ["to-color", "blue"]]]},
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN [255.0, 0.0, 0.0, 1.0] WHEN l_returnflag = 'R' THEN [0.0, 51.0, 0.0, 0.5] ELSE [0.0, 0.0, 255.0, 1.0] END::DOUBLE[] AS c FROM lineitem")
project("expr_interp_lab", "orders", ["o_orderkey"], {"c": ["to-string", ["interpolate-lab", ["linear"], get("o_totalprice"), 0, "red", 500000, "blue"]], "h": ["to-string", ["interpolate-hcl", ["linear"], get("o_totalprice"), 0, "#f00", 500000, "#00f"]]}, None)
project("expr_number_text", "orders", ["o_orderkey"], {"a": ["to-string", ["/", ["+", get("o_orderkey"), 12345678], 2]], "b": ["to-string", ["/", get("o_orderkey"), 8192]], "c": ["concat", "k", ["*", get("o_orderkey"), 1e15]]},
        """SELECT o_orderkey, rtrim(rtrim(((o_orderkey + 12345678)::DECIMAL(38, 1) / 2)::DECIMAL(38, 1)::VARCHAR, '0'), '.') AS a,
        rtrim(rtrim((o_orderkey::DOUBLE / 8192)::DECIMAL(38, 13)::VARCHAR, '0'), '.') AS b, 'k' || (o_orderkey::HUGEINT * 1000000000000000)::VARCHAR AS c FROM orders""")  # fmt: skip
project("expr_join_column", "orders", ["o_orderkey"], {"j": ["join", ["split", get("o_orderpriority"), "-"], get("o_orderstatus")]}, "SELECT o_orderkey, replace(o_orderpriority, '-', o_orderstatus) AS j FROM orders")
project("expr_interp_errors", "lineitem", LINE, {"v": ["interpolate", ["linear"], get("l_linenumber"), 1, 10, 3, 30, 5, ["to-number", get("l_returnflag")], 6, 60]},
        "SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber <= 3 THEN l_linenumber * 10 WHEN l_linenumber >= 6 THEN 60 END)::DOUBLE AS v FROM lineitem")
project("expr_format", "orders", ["o_orderkey"], {"t": ["to-string", ["format", get("o_orderpriority"), {"font-scale": 1.2}, " / ", ["to-string", get("o_custkey")], {"text-color": "red"}]]}, "SELECT o_orderkey, o_orderpriority || ' / ' || o_custkey AS t FROM orders")
project("expr_semiliteral", "lineitem", LINE, {"a": ["semiliteral", [1, ["*", get("l_linenumber"), 2], ["get", "l_quantity"]]], "n": ["length", ["semiliteral", [get("l_returnflag"), "x"]]]}, "SELECT l_orderkey, l_linenumber, [1.0, l_linenumber * 2.0, l_quantity]::DOUBLE[] AS a, 2.0::DOUBLE AS n FROM lineitem")
project("expr_object", "region", ["r_regionkey"], {"a": ["typeof", ["object", ["literal", {"k": 1}]]], "b": ["get", "k", ["literal", {"k": 5}]], "c": ["has", "q", ["literal", {"k": 5}]]}, "SELECT r_regionkey, 'object' AS a, 5.0::DOUBLE AS b, FALSE AS c FROM region")
project("expr_computed_get", "nation", ["n_nationkey"], {"h": ["has", ["concat", "n_na", "me"]], "m": ["has", ["concat", "no", "ne"]], "t": ["get", ["concat", "n_na", "me"]]}, "SELECT n_nationkey, TRUE AS h, FALSE AS m, n_name AS t FROM nation")
project("expr_typeof_columns", "events", ["event_id"], {"a": ["typeof", get("event_type")], "b": ["typeof", get("value")], "c": ["typeof", get("nothing")]}, "SELECT event_id, CASE WHEN event_type IS NULL THEN 'null' ELSE 'string' END AS a, CASE WHEN value IS NULL THEN 'null' ELSE 'number' END AS b, 'null' AS c FROM events")
project("expr_color_names", "orders", ["o_orderkey"], {"c": ["to-rgba", ["match", get("o_orderstatus"), "F", ["to-color", "hotpink"], "O", ["to-color", "steelblue"], ["to-color", "whitesmoke"]]]},
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN [255.0, 105.0, 180.0, 1.0] WHEN 'O' THEN [70.0, 130.0, 180.0, 1.0] ELSE [245.0, 245.0, 245.0, 1.0] END::DOUBLE[] AS c FROM orders")
project("expr_units", "lineitem", LINE, {"m": ["number-format", get("l_quantity"), {"unit": "kilometer"}], "j": ["number-format", get("l_extendedprice"), {"currency": "JPY"}]},
        "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT || ' km' AS m, '¥' || format('{:,}', floor(l_extendedprice::DECIMAL(18, 2) + 0.5)::BIGINT) AS j FROM lineitem")
project("prop_error_is_default", "events", ["event_id"], {"v": ["coalesce", ["number", get("value"), 0], 0], "e": ["to-number", get("event_type"), -1]}, "SELECT event_id, coalesce(value, 0) AS v, -1.0::DOUBLE AS e FROM events")

for _name, _f, _sql in (
    ("legacy_exponential", {"property": "o_totalprice", "base": 1, "stops": [[0, 1], [100000, 3]]}, "round(CASE WHEN o_totalprice <= 0 THEN 1 WHEN o_totalprice < 100000 THEN 1 + o_totalprice / 100000 * 2 ELSE 3 END, 9)::DOUBLE"),
    ("legacy_interval", {"type": "interval", "property": "o_totalprice", "stops": [[0, 1], [100000, 3], [200000, 4]]}, "CASE WHEN o_totalprice >= 200000 THEN 4 WHEN o_totalprice >= 100000 THEN 3 ELSE 1 END::DOUBLE"),
    ("legacy_categorical", {"type": "categorical", "property": "o_orderstatus", "stops": [["F", 1], ["O", 2]], "default": 0}, "CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END::DOUBLE"),
    ("legacy_identity", {"type": "identity", "property": "o_custkey"}, "o_custkey::DOUBLE"),
):
    project(_name, "orders", ["o_orderkey"], {"v": convert(_f)}, f"SELECT o_orderkey, {_sql} AS v FROM orders", ("v",) if _name == "legacy_exponential" else ())

FLAGSHIP = Layer("open-lines", "line", "items", None, 0, 24, ["all", ["==", get("l_returnflag"), "A"], ["<", get("l_quantity"), 25]],
                 {"line-sort-key": get("l_extendedprice"), "line-cap": ["match", get("l_linestatus"), "O", "round", "butt"], "line-width": ["interpolate", ["linear"], get("l_discount"), 0, 1, 0.1, 8]})


@query("layer_query", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_orderkey * 8 + l_linenumber AS seq,
  CASE WHEN l_linestatus = 'O' THEN 'round' ELSE 'butt' END AS line_cap,
  round(CASE WHEN l_discount <= 0 THEN 1 WHEN l_discount < 0.1 THEN 1 + l_discount / 0.1 * 7 ELSE 8 END, 6)::DOUBLE AS line_width, (l_orderkey % 16)::INT AS tile
  FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 25)
SELECT 0 AS layer_idx, 'open-lines' AS layer_id, l_orderkey, l_linenumber, tile, 0 AS eval_errors, line_cap, line_width,
  row_number() OVER (PARTITION BY tile ORDER BY l_extendedprice, seq) - 1 AS rank,
  round(1 - 1 / 2.0 - 0.5 * row_number() OVER (PARTITION BY tile ORDER BY l_extendedprice, seq) / (count(*) OVER (PARTITION BY tile) + 2), 9)::DOUBLE AS depth FROM f""")  # fmt: skip
def _layer_query(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("tile", (F.col("l_orderkey") % 16).cast("int")).withColumn("feature_seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    out = layer_query(df, FLAGSHIP, 0, 1, 12.0, ["line-cap", "line-width"], LINE, ["tile"])
    return out.withColumn("line_width", F.round("line_width", 6)).withColumn("depth", F.round("depth", 9))


@query("layer_sort_rank", "SELECT o_orderkey, (o_custkey % 8)::INT AS tile, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def _sort_rank(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("tile", (F.col("o_custkey") % 8).cast("int"))
    return layer_query(df, Layer("o", "fill", settings={"fill-sort-key": get("o_totalprice")}), 0, 1, 3.0, [], ["o_orderkey"], ["tile"], "o_orderkey").select("o_orderkey", "tile", "rank")


@query("layer_zoom_gate", "SELECT n_nationkey, 'b' AS layer_id FROM nation UNION ALL SELECT n_nationkey, 'c' FROM nation")
def _zoom_gate(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    layers = [Layer("a", "fill", minzoom=0, maxzoom=5), Layer("b", "fill", minzoom=5, maxzoom=9), Layer("c", "fill"), Layer("d", "fill", settings={"visibility": "none"})]
    parts = [p for i, x in enumerate(layers) if (p := layer_query(df, x, i, len(layers), 5.0, [], ["n_nationkey"], [], "n_nationkey")) is not None]
    return parts[0].unionByName(parts[1]).select("n_nationkey", "layer_id")


STYLE = {"version": 8, "sources": {"orders": {"type": "vector"}}, "layers": [
    {"id": "big", "type": "fill", "source": "orders", "filter": [">", ["get", "o_totalprice"], 250000], "paint": {"fill-opacity": 0.5}, "layout": {"fill-sort-key": ["get", "o_totalprice"]}},
    {"id": "urgent", "type": "line", "source": "orders", "filter": ["==", ["get", "o_orderpriority"], "1-URGENT"], "paint": {"line-width": ["step", ["get", "o_totalprice"], 1, 100000, 2]}},
    {"id": "sky", "type": "sky"},
]}


@query("style_union", """
SELECT 0 AS layer_idx, 'big' AS layer_id, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank, NULL::DOUBLE AS width FROM orders WHERE o_totalprice > 250000
UNION ALL
SELECT 1, 'urgent', o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1, CASE WHEN o_totalprice >= 100000 THEN 2 ELSE 1 END::DOUBLE FROM orders WHERE o_orderpriority = '1-URGENT'""")  # fmt: skip
def _style_union(spark, sf_dir):
    out = run_style(Style.parse(STYLE), {"orders": table(spark, sf_dir, "orders")}, 10.0, ["o_orderkey"], seq="o_orderkey")
    return out.select("layer_idx", "layer_id", "o_orderkey", "rank", F.get_json_object("properties", "$.line_width").cast("double").alias("width"))


PAINTED = Layer("p", "fill", settings={"fill-color": ["match", get("o_orderstatus"), "F", "red", "O", ["to-color", get("o_orderpriority")], "blue"], "fill-opacity": ["/", get("o_totalprice"), 100000]})


@query("layer_paint", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::DOUBLE AS r, round(least(greatest(o_totalprice / 100000, 0), 1), 9)::DOUBLE AS a
FROM orders WHERE o_orderstatus <> 'O'""")  # fmt: skip
def _layer_paint(spark, sf_dir):
    """Features whose colour fails are skipped; alpha is the opacity held to 0..1."""
    out = layer_query(table(spark, sf_dir, "orders"), PAINTED, 0, 1, 5.0, [], ["o_orderkey"], [], "o_orderkey", paint=True)
    return out.select("o_orderkey", F.col("color.r").alias("r"), F.round("color.a", 9).alias("a"))


@query("symbol_gate", "SELECT c_custkey, 'at' AS layer_id FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'along' FROM customer WHERE c_custkey % 3 > 0")
def _symbol_gate(spark, sf_dir):
    kind = F.array(*map(F.lit, ("Point", "LineString", "Polygon")))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.get(kind, (F.col("c_custkey") % 3).cast("int")).alias("g"))
    layers = [Layer("at", "symbol"), Layer("along", "symbol", settings={"symbol-placement": "line"})]
    parts = [layer_query(df, x, i, 2, 5.0, [], ["c_custkey"], [], "c_custkey", "g") for i, x in enumerate(layers)]
    return parts[0].unionByName(parts[1]).select("c_custkey", "layer_id")


@query("property_defaults", "SELECT event_id, CASE WHEN event_type = 'click' THEN 3 ELSE 1 END::DOUBLE AS width, 'butt' AS cap, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS errors FROM events")
def _property_defaults(spark, sf_dir):
    """Errors, and expressions that do not compile, become the property's default."""
    layer = Layer("d", "line", settings={"line-width": ["to-number", ["match", get("event_type"), "click", "3", "none"]], "line-cap": ["+", get("event_type"), 1]})
    df = table(spark, sf_dir, "events")
    (width, err), (cap, _) = (property_column(layer, n, ex.Context(df.schema, zoom=1)) for n in ("line-width", "line-cap"))
    return df.select("event_id", width.alias("width"), cap.alias("cap"), err.cast("int").alias("errors"))


BROKEN = {"version": 8, "sources": {"orders": {"type": "vector"}}, "layers": [
    {"id": "a", "type": "line", "source": "orders", "paint": {"line-width": "wide", "line-color": "nocolor", "line-opacity": ["nop", 1], "line-blur": 3}, "layout": {"line-cap": "flat"}},
    {"id": "b", "type": "fill", "source": "orders", "filter": ["==", 1], "paint": {"fill-opacity": 0.5}},
    {"id": "c", "type": "fill", "source": "orders", "paint": {"fill-antialias": ["get", "x"], "fill-opacity": ["+", ["get", "o_orderstatus"], 1], "fill-color": "#123"}},
    {"id": "d", "type": "sky", "source": "orders"},
]}


@query("style_diagnostics", """
SELECT * FROM (VALUES ('a', 'line-width'), ('a', 'line-color'), ('a', 'line-opacity'), ('a', 'line-blur'), ('a', 'line-cap'), ('b', 'filter'), ('c', 'fill-antialias'), ('c', 'fill-opacity'), ('d', 'type')) t(layer, property)""")  # fmt: skip
def _style_diagnostics(spark, sf_dir):
    said = Style.parse(BROKEN).check({"orders": table(spark, sf_dir, "orders").schema})
    return spark.createDataFrame([(d.layer, d.property) for d in said], "layer string, property string")


@query("zoom_pair", "SELECT o_orderkey, 5 * (1 + o_custkey % 3)::DOUBLE AS lo, 6 * (1 + o_custkey % 3)::DOUBLE AS hi FROM orders")
def _zoom_pair(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    layer = Layer("w", "line", settings={"line-width": ["interpolate", ["linear"], ["zoom"], 0, 0, 20, ["*", 20, ["+", 1, ["%", get("o_custkey"), 3]]]]})
    lo, hi = zoom_pair(layer, "line-width", df.schema, 5.5)
    return df.select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


@query("dep_class", "SELECT * FROM (VALUES ('constant'), ('zoom_only'), ('data_driven'), ('zoom_and_data')) t(class)")
def _dep_class(spark, sf_dir):
    each = [["literal", 1], ["interpolate", ["linear"], ["zoom"], 0, 1, 2, 3], get("x"), ["step", ["zoom"], get("x"), 3, 2]]
    return spark.createDataFrame([(dependency(e),) for e in each], "class string")


LONLAT = "((c_custkey * 37) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 53) % 170 - 84.95)::DOUBLE AS lat"
WORLD = f"SELECT c_custkey, lon, lat, (lon + 180) / 360 AS wx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS wy FROM (SELECT c_custkey, {LONLAT} FROM customer)"
TILES = f"SELECT c_custkey, least(greatest(floor(wx * 256), 0), 255)::INT AS x, least(greatest(floor(wy * 256), 0), 255)::INT AS y FROM ({WORLD})"


def customers(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    df = df.select("c_custkey", ((F.col("c_custkey") * 37) % 360 - 180).cast("double").alias("lon"), ((F.col("c_custkey") * 53) % 170 - 84.95).cast("double").alias("lat"))
    wx, wy = geo.to_world(F.col("lon"), F.col("lat"))
    return df.withColumns({"wx": wx, "wy": wy})


def tiles(spark, sf_dir) -> DataFrame:
    x, y = geo.tile_of(F.col("wx"), F.col("wy"), 8)
    return customers(spark, sf_dir).select("c_custkey", x.alias("x"), y.alias("y"))


query("tile_assign", TILES)(tiles)


BOX = {"type": "Polygon", "coordinates": [[[-100.5, -40.25], [60.5, -40.25], [60.5, 55.75], [-100.5, 55.75], [-100.5, -40.25]]]}


@query("expr_within", f"SELECT c_custkey, lon > -100.5 AND lon < 60.5 AND lat > -40.25 AND lat < 55.75 AS inside, (lon > -100.5 AND lon < 60.5 AND lat > -40.25 AND lat < 55.75) AND (lon + 30 > -100.5 AND lon + 30 < 60.5) AS line FROM (SELECT c_custkey, {LONLAT} FROM customer)")
def _expr_within(spark, sf_dir):
    c = customers(spark, sf_dir).withColumns({"p": F.lit("Point"), "l": F.lit("LineString")})
    at = lambda x: F.struct(x.alias("lon"), F.col("lat"))
    point = ex.compile_expr(["within", BOX], ex.Context(c.schema, geometry_column="p", vertices=F.array(at(F.col("lon")))))
    line = ex.compile_expr(["within", {"type": "Feature", "geometry": BOX}], ex.Context(c.schema, geometry_column="l", vertices=F.array(at(F.col("lon")), at(F.col("lon") + 30))))
    return c.select("c_custkey", point.value.alias("inside"), line.value.alias("line"))


@query("expr_distance", f"""
WITH p AS (SELECT c_custkey, {LONLAT} FROM customer), r AS (SELECT *, cos(radians(lat)) AS c FROM p),
k AS (SELECT *, 1 / (1 - 0.0066943799901413165 * (1 - c * c)) AS w2 FROM r)
SELECT c_custkey, round(least(
  sqrt(pow((CASE WHEN lon - 10 > 180 THEN lon - 370 WHEN lon - 10 < -180 THEN lon + 350 ELSE lon - 10 END) * pi() / 180 * 6378137 * sqrt(w2) * c, 2) + pow((lat - 50) * pi() / 180 * 6378137 * sqrt(w2) * w2 * (1 - 0.0066943799901413165), 2)),
  abs(lat + 20) * pi() / 180 * 6378137 * sqrt(w2) * w2 * (1 - 0.0066943799901413165)), 3) AS meters FROM k""")  # fmt: skip
def _expr_distance(spark, sf_dir):
    c = customers(spark, sf_dir)
    shapes = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [10, 50]}, {"type": "LineString", "coordinates": [[-200, -20], [200, -20]]}]}
    n = ex.compile_expr(["distance", shapes], ex.Context(c.schema, vertices=F.array(F.struct("lon", "lat"))))
    return c.select("c_custkey", F.round(n.value, 3).alias("meters"))


@query("tile_rect", f"SELECT c_custkey, x / 256.0::DOUBLE AS x0, y / 256.0::DOUBLE AS y0, (x + 1) / 256.0::DOUBLE AS x1, (y + 1) / 256.0::DOUBLE AS y1 FROM ({TILES})")
def _tile_rect(spark, sf_dir):
    r = geo.tile_rect(F.lit(8), F.col("x"), F.col("y"))
    return tiles(spark, sf_dir).select("c_custkey", *(c.alias(n) for c, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)))


@query("tile_parent", f"SELECT c_custkey, 7 AS z, (x // 2)::INT AS x, (y // 2)::INT AS y FROM ({TILES})")
def _tile_parent(spark, sf_dir):
    z, x, y = geo.parent(F.lit(8), F.col("x"), F.col("y"))
    return tiles(spark, sf_dir).select("c_custkey", z.alias("z"), x.alias("x"), y.alias("y"))


@query("tile_contains_join", f"WITH t AS ({TILES}), h AS (SELECT DISTINCT x // 16 AS hx, y // 16 AS hy FROM t WHERE c_custkey % 3 = 0) SELECT c_custkey, hx::INT AS have_x, hy::INT AS have_y FROM t JOIN h ON x // 16 = hx AND y // 16 = hy")
def _contains(spark, sf_dir):
    t = tiles(spark, sf_dir)
    have = t.where("c_custkey % 3 = 0").select(F.shiftright("x", 4).alias("x"), F.shiftright("y", 4).alias("y")).distinct()
    return archives.overzoom(t, have, 8, 4).select("c_custkey", "have_x", "have_y")


@query("tile_cover_view", "WITH v AS (SELECT n_nationkey AS view, n_nationkey / 20.0 - 0.2 AS x0, n_nationkey / 50.0 AS y0 FROM nation) SELECT view, 4 AS z, ((ux % 16 + 16) % 16)::INT AS x, y::INT AS y, (row_number() OVER (PARTITION BY view ORDER BY y, ux) - 1)::INT AS ordinal FROM (SELECT view, unnest(range(floor(x0 * 16)::BIGINT, floor((x0 + 0.3) * 16)::BIGINT + 1)) AS ux, y0 FROM v) JOIN (SELECT unnest(range(16)) AS y) ON y BETWEEN floor(y0 * 16) AND floor((y0 + 0.25) * 16)")
def _cover(spark, sf_dir):
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("view"), (F.col("n_nationkey") / F.lit(20.0) - 0.2).alias("x0"), (F.col("n_nationkey") / F.lit(50.0)).alias("y0"))
    return archives.cover(v.withColumns({"x1": F.col("x0") + 0.3, "y1": F.col("y0") + 0.25}), 4)


@query("hilbert_id", f"""
WITH RECURSIVE w AS (
  SELECT c_custkey, x::BIGINT AS x, y::BIGINT AS y, 128::BIGINT AS s, 0::BIGINT AS d FROM ({TILES})
  UNION ALL
  SELECT c_custkey, (CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 255 - y ELSE y END ELSE x END), (CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 255 - x ELSE x END ELSE y END), s // 2, d + s * s * xor(3 * rx, ry)
  FROM (SELECT *, CASE WHEN x & s > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & s > 0 THEN 1 ELSE 0 END AS ry FROM w WHERE s > 0))
SELECT c_custkey, d + 21845 AS tile_id FROM w WHERE s = 0""")  # fmt: skip
def _hilbert(spark, sf_dir):
    return tiles(spark, sf_dir).select("c_custkey", geo.hilbert_id(8, F.col("x"), F.col("y")).alias("tile_id"))


SQUARE = [[(-100.5, -40.25), (60.5, -40.25), (60.5, 55.75), (-100.5, 55.75)], [(-20.5, 0.25), (-20.5, 20.5), (10.5, 20.5), (10.5, 0.25)]]


@query("within_polygon", f"SELECT c_custkey, (lon > -100.5 AND lon < 60.5 AND lat > -40.25 AND lat < 55.75) AND NOT (lon >= -20.5 AND lon <= 10.5 AND lat >= 0.25 AND lat <= 20.5) AS inside FROM (SELECT c_custkey, {LONLAT} FROM customer)")
def _within(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", geo.within(F.col("lon"), F.col("lat"), [SQUARE]).alias("inside"))


@query("distance_point", f"""
WITH p AS (SELECT c_custkey, {LONLAT} FROM customer), r AS (SELECT *, cos(radians(lat)) AS c FROM p),
k AS (SELECT *, 1 / (1 - 0.0066943799901413165 * (1 - c * c)) AS w2 FROM r)
SELECT c_custkey, round(sqrt(pow((CASE WHEN lon - 10 > 180 THEN lon - 370 WHEN lon - 10 < -180 THEN lon + 350 ELSE lon - 10 END) * pi() / 180 * 6378137 * sqrt(w2) * c, 2)
  + pow((lat - 50) * pi() / 180 * 6378137 * sqrt(w2) * w2 * (1 - 0.0066943799901413165), 2)), 3) AS meters FROM k""")  # fmt: skip
def _distance(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", F.round(geo.distance_to_points(F.col("lon"), F.col("lat"), [(10.0, 50.0)]), 3).alias("meters"))


@query("ring_area", "SELECT p_partkey, 2.0 * (1 + p_size) * (2 + p_partkey % 7)::DOUBLE AS area2 FROM part")
def _ring_area(spark, sf_dir):
    w, h = (1 + F.col("p_size")).cast("double"), (2 + F.col("p_partkey") % 7).cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", geo.ring_area2(F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))).alias("area2"))


@query("dash_runs", "SELECT p_partkey AS id, k::INT AS k, k * 5.0::DOUBLE AS t0, least(k * 5.0 + 3, p_size + 0.5)::DOUBLE AS t1 FROM part, unnest(range(greatest(ceil((p_size + 0.5) / 5)::BIGINT, 1))) t(k)")
def _dash_runs(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 0.5).cast("double").alias("length"), F.lit(1.0).alias("width"))
    return layout.dash_table(lines, [3, 2])


@query("dash_pattern", """
WITH l AS (SELECT p_partkey AS id, (p_size * 3 + 0.5)::DOUBLE AS length, (1 + p_partkey % 2)::DOUBLE AS width FROM part), r(i, a, n) AS (VALUES (0, 0, 2), (1, 3, 1), (2, 6, 1))
SELECT id, (c * 3 + i)::INT AS k, (c * 8 + a) * width AS t0, least((c * 8 + a + n) * width, length) AS t1 FROM (SELECT *, unnest(range(greatest(ceil(length / (8 * width)), 1)::BIGINT)) AS c FROM l), r WHERE (c * 8 + a) * width < length""")  # fmt: skip
def _dash_pattern(spark, sf_dir):
    """An odd number of lengths counts twice: 2 1 1 2 1 1."""
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 3 + 0.5).cast("double").alias("length"), (1 + F.col("p_partkey") % 2).cast("double").alias("width"))
    return layout.dash_table(lines, [2, 1, 1])


@query("line_anchors")
def _line_anchors(spark, sf_dir):
    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(k, i, *a) for k, n in zip(b.p_partkey, b.p_size, strict=True) for i, a in enumerate(layout.anchors_along([(0, 0), (10.0 * n, 0), (10.0 * n, 50)], 100))]
            yield pd.DataFrame(out, columns=["p_partkey", "n", "x", "y", "angle"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, n int, x double, y double, angle double")


@query("collide_labels")
def _collide(spark, sf_dir):
    c = customers(spark, sf_dir)
    x, y = F.col("wx") * 4096, F.col("wy") * 4096
    labels = c.select((F.col("c_custkey") % 16).alias("view"), F.col("c_custkey").alias("label"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 16).alias("y1"), (F.col("c_custkey") % 97 == 0).alias("allow"), F.lit(False).alias("ignore"))
    return layout.collide(labels, ["label"])


@query("batch_merge", """
WITH r AS (SELECT o_orderkey // 100 AS layer, o_orderstatus AS pipe, o_orderkey AS a, o_orderkey + 1 AS b FROM orders),
m AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(pipe) OVER w = pipe THEN 0 ELSE 1 END AS n FROM r WINDOW w AS (PARTITION BY layer ORDER BY a)),
i AS (SELECT *, sum(n) OVER (PARTITION BY layer ORDER BY a) AS island FROM m)
SELECT layer, pipe, min(a) AS a, max(b) AS b FROM i GROUP BY layer, island, pipe""")  # fmt: skip
def _batch_merge(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("layer"), F.col("o_orderstatus").alias("pipe"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return layout.merge_ranges(r, ["pipe"], "a", "b", ["layer"])


@query("dem_decode", "SELECT s_suppkey, round((s_suppkey % 7 * 65536 + s_nationkey * 256 + s_suppkey % 256) * 0.1 - 10000, 6)::DOUBLE AS mapbox, (s_suppkey % 7 * 256.0 + s_nationkey + (s_suppkey % 256) / 256.0 - 32768)::DOUBLE AS terrarium FROM supplier")
def _dem(spark, sf_dir):
    r, g, b = F.col("s_suppkey") % 7, F.col("s_nationkey"), F.col("s_suppkey") % 256
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(layout.decode_elevation(r, g, b), 6).alias("mapbox"), layout.decode_elevation(r, g, b, "terrarium").alias("terrarium"))


_AT = lambda n, dx, dy: f"JOIN g {n} ON {n}.t = g.t AND {n}.x = least(greatest(g.x + {dx}, 0), g.w - 1) AND {n}.y = least(greatest(g.y + {dy}, 0), 3)"


@query("hillshade", f"""
WITH s AS (SELECT (s_nationkey % 5)::INT AS t, s_acctbal AS e, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey % 5) // 4 AS w FROM supplier),
g AS (SELECT t, w, i, (i % w)::INT AS x, (i // w)::INT AS y, e FROM s WHERE i < 4 * w),
d AS (SELECT g.t, g.i, ((c.e + 2 * f.e + i.e) - (a.e + 2 * d.e + g2.e)) * 0.5 / 60 AS dx, ((g2.e + 2 * h.e + i.e) - (a.e + 2 * b.e + c.e)) * 0.5 / 60 AS dy FROM g
  {_AT('a', -1, -1)} {_AT('b', 0, -1)} {_AT('c', 1, -1)} {_AT('d', -1, 0)} {_AT('f', 1, 0)} {_AT('g2', -1, 1)} {_AT('h', 0, 1)} {_AT('i', 1, 1)}),
l AS (SELECT t, i, sin(radians(45)) AS z, least(greatest(sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(90 - 335) - atan2(dy, -dx)), 0), 1) AS v FROM d)
SELECT t AS tile, i::INT AS i, round(CASE WHEN v < z THEN (v - z) / z ELSE (v - z) / (1 - z) END, 6)::DOUBLE AS shade FROM l""")  # fmt: skip
def _hillshade(spark, sf_dir):
    row = F.struct(F.col("s_suppkey"), F.col("s_acctbal"))
    grid = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).cast("int").alias("x")).agg(F.sort_array(F.collect_list(row)).alias("r"), F.expr("cast(count(*) div 4 as int)").alias("w"))
    heights = F.slice(F.transform("r", lambda s: s["s_acctbal"]), F.lit(1), 4 * F.col("w"))
    tile = grid.select(F.lit(0).alias("z"), "x", F.lit(0).alias("y"), "w", F.lit(4).alias("h"), heights.alias("elevation"))
    out = layout.hillshade_table(tile, 30.0).select(F.col("x").alias("tile"), F.posexplode("shade").alias("i", "shade"))
    return out.withColumn("shade", F.round("shade", 6))


@query("color_relief", "SELECT s_suppkey, round(CASE WHEN s_acctbal <= 0 THEN 0 WHEN s_acctbal < 5000 THEN s_acctbal / 5000 WHEN TRUE THEN 1 END, 6)::DOUBLE AS r FROM supplier")
def _relief(spark, sf_dir):
    c = layout.relief_color(F.col("s_acctbal"), [(0, (0, 0, 0, 1)), (5000, (1, 0, 0, 1)), (9000, (1, 1, 0, 1))])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(c["r"], 6).alias("r"))


@query("missing_images", "SELECT DISTINCT p_brand AS name FROM part EXCEPT SELECT p_brand FROM part WHERE p_size < 3")
def _missing(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return archives.missing_images(p.select(F.col("p_brand").alias("name")), p.where("p_size < 3").select(F.col("p_brand").alias("name")).distinct())


@query("archive_pick", f"""
WITH t AS ({TILES}), a(name, lo, hi, max_zoom, area) AS (VALUES ('world', 0, 255, 6, 4.0), ('west', 0, 127, 10, 2.0), ('middle', 64, 191, 10, 1.0))
SELECT c_custkey, name FROM (SELECT c_custkey, name, row_number() OVER (PARTITION BY c_custkey ORDER BY max_zoom DESC, area, name) AS r FROM t JOIN a ON x BETWEEN lo AND hi) WHERE r = 1""")  # fmt: skip
def _pick(spark, sf_dir):
    a = spark.createDataFrame([("world", 0, 255, 6, 4.0), ("west", 0, 127, 10, 2.0), ("middle", 64, 191, 10, 1.0)], "name string, lo int, hi int, max_zoom int, area double")
    t = tiles(spark, sf_dir)
    both = t.join(F.broadcast(a), t["x"].between(a["lo"], a["hi"]))  # three archives
    return archives.pick_archive(both, ["c_custkey"], [F.col("max_zoom").desc(), F.col("area"), F.col("name")]).select("c_custkey", "name")


STATUS = {"click": "ok", "view": "not_ready", "purchase": "empty"}


@query("supply_state", "SELECT tile, max(req_id) AS req_id, arg_max(status, req_id) AS status FROM (SELECT user_id % 50 AS tile, event_id AS req_id, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'not_ready' WHEN 'purchase' THEN 'empty' ELSE 'failed' END AS status FROM events) WHERE status <> 'not_ready' GROUP BY tile")
def _supply(spark, sf_dir):
    kind = F.lit("failed")
    for k, v in STATUS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return supply_batch(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("tile"), F.col("event_id").alias("req_id"), kind.alias("status")))


@query("png_pixels", """
WITH p AS (SELECT n_nationkey, (3 + n_nationkey % 3)::INT AS w, (2 + n_nationkey % 4)::INT AS h FROM nation)
SELECT n_nationkey, w AS width, h AS height, (SELECT sum((n_nationkey * 7 + x * 13 + y * 29 + c * 17) % 256) FROM range(w) a(x), range(h) b(y), range(4) d(c))::BIGINT AS total FROM p""")  # fmt: skip
def _png(spark, sf_dir):
    """Images written by rule, read back."""

    def write(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            data = []
            for n in b.column("n_nationkey").to_pylist():
                y, x, c = np.meshgrid(np.arange(2 + n % 4), np.arange(3 + n % 3), np.arange(4), indexing="ij")
                data.append(png.encode(((n * 7 + x * 13 + y * 29 + c * 17) % 256).astype(np.uint8), n % 3))
            yield pa.RecordBatch.from_arrays([b.column("n_nationkey"), pa.array(data, pa.binary())], ["n_nationkey", "data"])

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    read = png.decode_images(n.mapInArrow(write, "n_nationkey long, data binary"), ["n_nationkey"])
    byte = F.transform(F.sequence(F.lit(1), F.octet_length("rgba")), lambda i: F.conv(F.hex(F.substring(F.col("rgba"), i, F.lit(1))), 16, 10).cast("long"))
    return read.select("n_nationkey", "width", "height", F.aggregate(byte, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


SPRITE = '{"Brand#11": {"x": 0, "y": 0, "width": 16, "height": 16}, "Brand#23": {"x": 16, "y": 0, "width": 8, "height": 8, "pixelRatio": 2, "sdf": true}, "Brand#45": {"x": 60, "y": 0, "width": 16, "height": 8}}'


@query("icon_sprite", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 16 WHEN 'Brand#23' THEN 8 ELSE -1 END::INT AS width, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#23' THEN 2 ELSE 0 END::DOUBLE AS ratio FROM part")
def _icons(spark, sf_dir):
    cells = symbols.sprite_table(spark, SPRITE, (64, 64))  # the third cell lies outside
    return symbols.with_icons(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), cells, "p_brand").select("p_partkey", F.coalesce("sprite.width", F.lit(-1)).alias("width"), F.coalesce("sprite.pixel_ratio", F.lit(0.0)).alias("ratio"))


def glyph_range(points: range) -> bytes:
    """A glyph range whose advances follow from the code points."""
    field = lambda n, v: bytes([n << 3]) + _var(v) if isinstance(v, int) else bytes([n << 3 | 2]) + _var(len(v)) + v
    own = [field(3, field(1, c) + field(3, 1) + field(4, 2) + field(5, 2 * (c % 3) - 1 if c % 3 else 0) + field(6, 7) + field(7, 5 + c % 9)) for c in points]
    return field(1, field(1, b"Plain") + b"".join(own))


def _var(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@query("glyph_table", "SELECT c::INT AS code_point, CASE c % 3 WHEN 1 THEN -1 WHEN 2 THEN -2 ELSE 0 END::INT AS left_, -4 AS top, (5 + c % 9)::INT AS advance FROM range(32, 320) t(c)")
def _glyphs(spark, sf_dir):
    ranges = spark.createDataFrame([(glyph_range(range(32, 256)),), (glyph_range(range(256, 320)),)], "data binary")
    return symbols.glyph_table(ranges).select("code_point", F.col("left").alias("left_"), "top", "advance")


@query("text_advance", """
WITH c AS (SELECT c_custkey, unnest(string_split(c_name, '')) AS c FROM customer)
SELECT c_custkey, sum(CASE WHEN ord(c) BETWEEN 48 AND 126 THEN 5 + ord(c) % 9 ELSE 12 END)::DOUBLE AS advance FROM c GROUP BY c_custkey""")  # fmt: skip
def _text_advance(spark, sf_dir):
    glyph = symbols.glyph_table(spark.createDataFrame([(glyph_range(range(48, 127)),)], "data binary"))
    return symbols.text_advance(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), glyph, ["c_custkey"], "c_name")


@query("geojson_shapes", f"""
SELECT c_custkey, kind, n::BIGINT AS n, round(total, 9)::DOUBLE AS total FROM (
  SELECT c_custkey, 'point' AS kind, 1 AS n, lon AS total FROM (SELECT c_custkey, {LONLAT} FROM customer)
  UNION ALL SELECT c_custkey, 'polygon', 4, 4 * lon + 4 FROM (SELECT c_custkey, {LONLAT} FROM customer))""")  # fmt: skip
def _geojson(spark, sf_dir):
    c, pair = customers(spark, sf_dir), lambda dx, dy: F.concat(F.lit("["), F.col("lon") + dx, F.lit(","), F.col("lat") + dy, F.lit("]"))
    ring = F.concat_ws(",", pair(0, 0), pair(2, 0), pair(2, 1), pair(0, 1))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":'), pair(0, 0), F.lit('}},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring, F.lit("]]}}]}"))
    found = symbols.geojson_table(c.select("c_custkey", text.alias("t")), ["c_custkey"], "t")
    flat = F.flatten("parts")
    return found.select("c_custkey", "kind", F.size(flat).cast("long").alias("n"), F.round(F.aggregate(flat, F.lit(0.0), lambda a, p: a + p["lon"]), 9).alias("total"))
