"""JSON expressions compiled to Spark Columns.

A node lowers to a value, an error flag and a static type. Errors are kept apart
from nulls: the flag is ``None`` where an error is impossible, so arithmetic on
non-null columns costs nothing beside itself. Nothing that can throw under ANSI
is emitted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import color as colors
from . import geo

NUMBER, STRING, BOOLEAN, NULL, COLOR, VALUE = "number", "string", "boolean", "null", "color", "value"


class CompileError(ValueError):
    """The expression is not valid, statically."""


@dataclass(frozen=True)
class Array:
    item: Any
    length: int | None = None


@dataclass
class Node:
    value: Column | None
    err: Column | None
    type: Any
    const: Any = None
    is_const: bool = False
    nullable: bool = False
    names: dict = field(default_factory=dict)


@dataclass
class Context:
    """What an expression may read: columns by property name, zoom (a number or Column), and optional inputs."""

    schema: T.StructType
    zoom: float | Column | None = None
    id_column: str | None = None
    geometry_column: str | None = None
    global_state: dict | None = None
    state_column: str | None = None
    images: frozenset[str] = frozenset()
    bound: dict[str, Node] = field(default_factory=dict)
    inputs: dict[str, Column] = field(default_factory=dict)  # elevation, heatmap-density, line-progress
    vertices: Column | None = None  # of the feature: array of struct lon, lat (all points of points, the run of a line)


_OPS: dict[str, tuple[int, int | None, Callable]] = {}


def op(name: str, least: int, most: int | None = -1):
    def add(f):
        for n in name.split():
            _OPS[n] = (least, least if most == -1 else most, f)
        return f

    return add


def any_of(*errs: Column | None) -> Column | None:
    some = [e for e in errs if e is not None]
    return reduce(lambda a, b: a | b, some) if some else None


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def literal(x: Any) -> Node:
    if x is None:
        return Node(F.lit(None), None, NULL, None, True, True)
    if isinstance(x, bool):
        return Node(F.lit(x), None, BOOLEAN, x, True)
    if isinstance(x, int | float):
        return Node(F.lit(float(x)), None, NUMBER, float(x), True)
    if isinstance(x, str):
        return Node(F.lit(x), None, STRING, x, True)
    if isinstance(x, list):
        parts = [literal(y) for y in x]
        kinds = {p.type for p in parts if not isinstance(p.type, Array)} | {"array" for p in parts if isinstance(p.type, Array)}
        if len(kinds) <= 1 and kinds <= {NUMBER, STRING, BOOLEAN}:
            kind = next(iter(kinds), VALUE)
            value = F.array(*(p.value for p in parts)) if parts else F.array().cast("array<string>")
            return Node(value, None, Array(kind, len(x)), x, True)
        return Node(None, None, Array(VALUE, len(x)), x, True)
    if isinstance(x, dict):
        return Node(None, None, "object", x, True)
    raise CompileError(f"no literal: {x!r}")


def compile_node(x: Any, cx: Context) -> Node:
    """Lower one JSON expression."""
    if not isinstance(x, list):
        if isinstance(x, dict):
            raise CompileError("a bare object is not an expression; use literal")
        return literal(x)
    if not x or not isinstance(x[0], str):
        raise CompileError("an expression is an array whose head is a name")
    name, args = x[0], x[1:]
    if name not in _OPS:
        raise CompileError(f"unknown operator {name!r}")
    least, most, f = _OPS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise CompileError(f"{name}: {len(args)} arguments")
    return f(name, args, cx)


# -- typing helpers ---------------------------------------------------------


def numeric(n: Node) -> Node:
    """A number, or an error where it is null."""
    if n.type == NUMBER:
        return Node(n.value, any_of(n.err, n.value.isNull() if n.nullable else None), NUMBER, n.const, n.is_const)
    if n.type in (VALUE, NULL):
        if n.type == NULL:
            return Node(F.lit(None).cast("double"), F.lit(True), NUMBER)
        raise CompileError("a property of unknown type needs number")
    raise CompileError(f"expected number, found {n.type}")


def textual(n: Node) -> Node:
    if n.type != STRING:
        raise CompileError(f"expected string, found {n.type}")
    return Node(n.value, any_of(n.err, n.value.isNull() if n.nullable else None), STRING, n.const, n.is_const)


def logical(n: Node) -> Node:
    if n.type != BOOLEAN:
        raise CompileError(f"expected boolean, found {n.type}")
    return Node(n.value, any_of(n.err, n.value.isNull() if n.nullable else None), BOOLEAN, n.const, n.is_const)


_SQL = {NUMBER: "double", STRING: "string", BOOLEAN: "boolean"}


def sql_type(t: Any) -> str:
    if isinstance(t, Array):
        return f"array<{sql_type(t.item)}>"
    return _SQL.get(t) or (colors.DDL if t == COLOR else "string")


def unify(nodes: list[Node], what: str) -> Any:
    """The type of all nodes; strings beside colours are read as colours."""
    if {COLOR, STRING} <= {n.type for n in nodes if isinstance(n.type, str)}:
        nodes[:] = [as_color(n) if n.type == STRING else n for n in nodes]
    kinds = [n.type for n in nodes if n.type != NULL]
    for k in kinds[1:]:
        if k != kinds[0] and not (isinstance(k, Array) and isinstance(kinds[0], Array)):
            raise CompileError(f"{what}: {kinds[0]} and {k}")
    return kinds[0] if kinds else NULL


def cast(n: Node, kind: Any) -> Column:
    return F.lit(None).cast(sql_type(kind)) if n.type == NULL else n.value


# -- access -----------------------------------------------------------------


@op("literal", 1)
def _literal(_, args, cx):
    return literal(args[0])


def property_type(t: T.DataType) -> Any:
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, T.ArrayType):
        return Array(property_type(t.elementType))
    return VALUE


@op("get has", 1, 2)
def _get(name, args, cx):
    if len(args) == 2:
        held = compile_node(args[1], cx)
        if held.type != "object" or not held.is_const or not isinstance(args[0], str):
            raise CompileError(f"{name}: the object must be a literal and the key a string")
        return literal(args[0] in held.const) if name == "has" else literal(held.const.get(args[0]))
    if isinstance(args[0], str):
        if args[0] not in cx.schema.names:
            return literal(False) if name == "has" else Node(F.lit(None), None, NULL, None, False, True)
        f = cx.schema[args[0]]
        c = F.col(f"`{args[0]}`")
        if name == "has":
            return Node(c.isNotNull(), None, BOOLEAN)
        kind = property_type(f.dataType)
        if kind == NUMBER:
            c = c.cast("double")
        elif kind == VALUE:
            c, kind = c.cast("string"), STRING
        return Node(c, None, kind, nullable=f.nullable)
    key = textual(compile_node(args[0], cx))
    if not cx.schema.names:
        return Node(F.lit(False), key.err, BOOLEAN) if name == "has" else Node(F.lit(None), key.err, NULL, nullable=True)
    if name == "has":
        there = F.create_map(*(y for n in cx.schema.names for y in (F.lit(n), F.col(f"`{n}`").isNotNull())))
        return Node(truth(F.try_element_at(there, key.value)), key.err, BOOLEAN)
    # One type if all properties have it, text otherwise.
    own = [(f.name, _get("get", [f.name], cx)) for f in cx.schema.fields if property_type(f.dataType) in (STRING, NUMBER, BOOLEAN)]
    kinds = {n.type for _, n in own}
    kind = kinds.pop() if len(kinds) == 1 else STRING
    bag = F.create_map(*(y for n, v in own for y in (F.lit(n), v.value if v.type == kind else F.when(v.value.isNotNull(), to_text(v)))))
    return Node(F.try_element_at(bag, key.value), key.err, kind, nullable=True)


@op("id", 0)
def _id(_, args, cx):
    if cx.id_column is None:
        return literal(None)
    return Node(F.col(cx.id_column).cast("double"), None, NUMBER, nullable=True)


@op("geometry-type", 0)
def _geometry_type(_, args, cx):
    if cx.geometry_column is None:
        return Node(F.lit(None).cast("string"), F.lit(True), STRING)
    g = F.lower(F.col(cx.geometry_column))
    v = F.when(g.isin("point", "multipoint"), "Point").when(g.isin("linestring", "multilinestring"), "LineString").when(g.isin("polygon", "multipolygon"), "Polygon")
    return Node(v, v.isNull(), STRING)


@op("zoom", 0)
def _zoom(_, args, cx):
    if cx.zoom is None:
        raise CompileError("zoom is not available here")
    return Node(cx.zoom, None, NUMBER) if isinstance(cx.zoom, Column) else literal(float(cx.zoom))


@op("elevation heatmap-density line-progress", 0)
def _input(name, args, cx):
    return Node(cx.inputs.get(name, F.lit(0.0)), None, NUMBER)


@op("global-state", 1)
def _global(_, args, cx):
    if not isinstance(args[0], str):
        raise CompileError("global-state: the key is a literal")
    return literal((cx.global_state or {}).get(args[0]))


@op("feature-state", 1)
def _state(_, args, cx):
    key = textual(compile_node(args[0], cx))
    if cx.state_column is None:
        return Node(F.lit(None), key.err, NULL, nullable=True)
    return Node(F.element_at(F.col(cx.state_column), key.value), key.err, STRING, nullable=True)


@op("properties", 0)
def _properties(_, args, cx):
    return Node(F.struct(*(F.col(f"`{n}`") for n in cx.schema.names)), None, "object")


@op("image", 1)
def _image(_, args, cx):
    n = textual(compile_node(args[0], cx))
    there = n.value.isin(*sorted(cx.images)) if cx.images else F.lit(False)
    return Node(F.struct(n.value.alias("name"), there.alias("available")), n.err, "resolvedImage")


_SECTION = {"font-scale": NUMBER, "text-font": Array(STRING), "text-color": COLOR, "vertical-align": STRING}
_ALIGN = ("bottom", "center", "top")


@op("format", 1, None)
def _format(_, args, cx):
    """Sections of text or image, each with its options; to-string joins their texts."""
    sections, errs, at = [], [], 0
    if isinstance(args[0], dict):
        raise CompileError("format: content first")
    while at < len(args):
        n = compile_node(args[at], cx)
        if isinstance(n.type, Array) or n.type == "object":
            raise CompileError(f"format: {n.type}")
        options = args[at + 1] if at + 1 < len(args) and isinstance(args[at + 1], dict) else None
        at += 1 if options is None else 2
        given = {}
        for name, kind in _SECTION.items():
            o = compile_node(options[name], cx) if options and name in options else literal(None)
            if kind == COLOR and o.type == STRING:
                o = as_color(o)
            if o.type != NULL and not (isinstance(kind, Array) and isinstance(o.type, Array) and o.type.item == STRING) and o.type != kind:
                raise CompileError(f"format: {name} is {o.type}")
            if name == "vertical-align" and o.is_const and o.type == STRING and o.const not in _ALIGN:
                raise CompileError(f"format: no alignment {o.const!r}")
            given[name] = cast(o, kind)
            errs.append(o.err)
        image = n.type == "resolvedImage"
        errs.append(n.err)
        sections.append(F.struct(
            (F.lit("") if image else to_text(n)).alias("text"), (n.value["name"] if image else F.lit(None).cast("string")).alias("image"), given["font-scale"].alias("scale"),
            F.array_join(given["text-font"], ",").alias("fontStack"), given["text-color"].alias("textColor"), given["vertical-align"].alias("verticalAlign"),
        ))
    return Node(F.array(*sections), any_of(*errs), "formatted")


@op("semiliteral", 1)
def _semiliteral(_, args, cx):
    """An array or object whose items are expressions."""
    if isinstance(args[0], dict):
        nodes = {k: _item(v, cx) for k, v in args[0].items()}
        if all(n.is_const for n in nodes.values()):
            return Node(None, None, "object", {k: n.const for k, n in nodes.items()}, True)
        return Node(F.struct(*(cast(n, n.type).alias(k) for k, n in nodes.items())), any_of(*(n.err for n in nodes.values())), "object")
    if not isinstance(args[0], list):
        return literal(args[0])
    nodes = [_item(v, cx) for v in args[0]]
    if all(n.is_const for n in nodes):
        return literal([n.const for n in nodes])
    kinds = {n.type for n in nodes if n.type != NULL}
    if len(kinds) > 1 or not kinds <= {NUMBER, STRING, BOOLEAN}:
        raise CompileError("semiliteral: items of several types")
    kind = kinds.pop()
    return Node(F.array(*(cast(n, kind) for n in nodes)), any_of(*(n.err for n in nodes)), Array(kind, len(nodes)))


def _item(x: Any, cx: Context) -> Node:
    if isinstance(x, list) and x and isinstance(x[0], str) and x[0] in _OPS:
        return compile_node(x, cx)
    return _semiliteral("semiliteral", [x], cx) if isinstance(x, list | dict) else literal(x)


def _shapes(x: Any) -> tuple[list, list, list]:
    """(points, lines, polygons) of a GeoJSON value."""
    points, lines, polygons = [], [], []
    if not isinstance(x, dict):
        raise CompileError("a GeoJSON object is expected")
    kind, at = x.get("type"), x.get("coordinates")
    for part in x.get("features", x.get("geometries", [])) or []:
        for own, more in zip((points, lines, polygons), _shapes(part), strict=True):
            own += more
    if kind == "Feature":
        return _shapes(x.get("geometry"))
    try:
        pair = lambda p: (float(p[0]), float(p[1]))
        run = lambda r: [pair(p) for p in r]
        if kind == "Point":
            points.append(pair(at))
        elif kind == "MultiPoint":
            points += run(at)
        elif kind == "LineString":
            lines.append(run(at))
        elif kind == "MultiLineString":
            lines += [run(r) for r in at]
        elif kind == "Polygon":
            polygons.append([run(r) for r in at])
        elif kind == "MultiPolygon":
            polygons += [[run(r) for r in p] for p in at]
        elif kind not in ("FeatureCollection", "GeometryCollection"):
            raise CompileError(f"no GeoJSON type {kind!r}")
    except (TypeError, IndexError, ValueError, KeyError) as e:
        raise CompileError("bad coordinates") from e
    return points, lines, polygons


@op("within", 1)
def _within(_, args, cx):
    """Points: all inside; lines: inside one polygon and across none of its edges."""
    polygons = _shapes(args[0])[2]
    if not polygons:
        raise CompileError("within: no polygon")
    if cx.vertices is None:
        return Node(F.lit(False), None, BOOLEAN)
    v, kind = cx.vertices, F.lower(F.col(cx.geometry_column)) if cx.geometry_column else F.lit("point")
    points = F.forall(v, lambda p: geo.within(p["lon"], p["lat"], polygons))
    pieces = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def inside(polygon):
        edges = [(p, q) for ring in polygon for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p != q]
        crossed = lambda s: reduce(lambda m, n: m | n, (geo.crosses(s["a"], s["b"], p, q) for p, q in edges), F.lit(False))
        return F.forall(v, lambda p: geo.within(p["lon"], p["lat"], [polygon])) & ~F.exists(pieces, crossed)

    lines = reduce(lambda m, n: m | n, (inside(p) for p in polygons))
    value = F.when(kind.isin("point", "multipoint"), points).when(kind.isin("linestring", "multilinestring"), lines).otherwise(False)
    return Node(truth(value) & (F.size(v) > 0), None, BOOLEAN)


@op("distance", 1)
def _distance(_, args, cx):
    """Metres from the nearest point of a point feature to literal shapes; other features are errors."""
    points, lines, polygons = _shapes(args[0])
    if not points and not lines and not polygons:
        raise CompileError("distance: no shapes")
    if cx.vertices is None:
        return Node(F.lit(None).cast("double"), F.lit(True), NUMBER)

    def one(p):
        each = [geo.distance_to_points(p["lon"], p["lat"], points)] if points else []
        each += [geo.distance_to_line(p["lon"], p["lat"], line) for line in lines]
        for polygon in polygons:
            rings = [geo.distance_to_line(p["lon"], p["lat"], [*ring, ring[0]]) for ring in polygon]
            each.append(F.when(geo.within(p["lon"], p["lat"], [polygon]), 0.0).otherwise(rings[0] if len(rings) == 1 else F.least(*rings)))
        return each[0] if len(each) == 1 else F.least(*each)

    v = cx.vertices
    kind = F.lower(F.col(cx.geometry_column)) if cx.geometry_column else F.lit("point")
    nearest = F.array_min(F.transform(v, one))
    return Node(nearest, truth(~kind.isin("point", "multipoint")) | nearest.isNull(), NUMBER)


@op("let", 3, None)
def _let(_, args, cx):
    if len(args) % 2 == 0:
        raise CompileError("let: names and values, then a body")
    bound, errs = dict(cx.bound), []
    for name, value in zip(args[:-1:2], args[1:-1:2], strict=True):
        if not isinstance(name, str) or not name or not all(c.isalnum() or c == "_" for c in name):
            raise CompileError(f"let: bad name {name!r}")
        bound[name] = compile_node(value, cx)
        errs.append(bound[name].err)
    body = compile_node(args[-1], Context(**{**cx.__dict__, "bound": bound}))
    return Node(body.value, any_of(*errs, body.err), body.type, body.const, body.is_const, body.nullable)


@op("var", 1)
def _var(_, args, cx):
    if args[0] not in cx.bound:
        raise CompileError(f"var: {args[0]!r} is not bound")
    return cx.bound[args[0]]


# -- comparison and logic ---------------------------------------------------


@op("== !=", 2, 3)
def _equal(name, args, cx):
    a, b = compile_node(args[0], cx), compile_node(args[1], cx)
    for n in (a, b):
        if isinstance(n.type, Array) or n.type in ("object", COLOR):
            raise CompileError(f"{name}: cannot compare {n.type}")
    err = any_of(a.err, b.err)
    if len(args) == 3:
        same = collated(a, b, args[2], cx, "==")
    elif NULL in (a.type, b.type):
        other = b if a.type == NULL else a
        same = F.lit(True) if other.type == NULL else other.value.isNull()
    elif a.type != b.type:
        if not a.is_const and not b.is_const and not a.nullable and not b.nullable:
            raise CompileError(f"{name}: {a.type} and {b.type}")
        same = a.value.isNull() & b.value.isNull() if a.nullable and b.nullable else F.lit(False)
    else:
        same = a.value.eqNullSafe(b.value) if a.nullable or b.nullable else a.value == b.value
        if a.type == NUMBER and not a.is_const and not b.is_const:
            same = same & ~truth(F.isnan(a.value))
    return Node(same if name == "==" else ~same, err, BOOLEAN)


_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@op("< <= > >=", 2, 3)
def _compare(name, args, cx):
    a, b = compile_node(args[0], cx), compile_node(args[1], cx)
    if len(args) == 3:
        return Node(collated(textual(a), textual(b), args[2], cx, name), any_of(a.err, b.err), BOOLEAN)
    strict = {NUMBER: numeric, STRING: textual}.get(a.type)
    if strict is None or a.type != b.type:
        raise CompileError(f"{name}: {a.type} and {b.type}")
    x, y = strict(a), strict(b)
    v = _COMPARE[name](x.value, y.value)
    if a.type == NUMBER:
        for n in (x, y):
            if not n.is_const:
                v = v & ~F.isnan(n.value)
    return Node(v, any_of(x.err, y.err), BOOLEAN)


#: Letters of Latin-1 and Latin Extended-A by their base letter.
FOLD = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł",
    "n": "ñńņňŉ", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sort_keys(c: Column, locale: str) -> tuple[Column, Column, Column]:
    """Primary (letters), secondary (marks) and tertiary (case, lower first) keys."""
    low = F.lower(c)
    plain = low
    if locale.startswith("de"):
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
            plain = F.replace(plain, F.lit(a), F.lit(b))
    if locale.startswith("sv"):
        for a, b in (("å", "z\u0001"), ("ä", "z\u0002"), ("ö", "z\u0003")):
            plain = F.replace(plain, F.lit(a), F.lit(b))
    source = "".join(v for v in FOLD.values())
    target = "".join(k * len(v) for k, v in FOLD.items())
    return F.translate(plain, source, target), low, F.translate(c, _UPPER + _UPPER.lower(), "1" * 26 + "0" * 26)


def collated(a: Node, b: Node, spec: Any, cx: Context, how: str) -> Column:
    if not (isinstance(spec, list) and spec and spec[0] == "collator" and len(spec) == 2 and isinstance(spec[1], dict)):
        raise CompileError("expected a collator")
    options = spec[1]
    locale = str(options.get("locale", "en"))
    x, y = sort_keys(a.value, locale), sort_keys(b.value, locale)
    levels = [True, bool(options.get("diacritic-sensitive", False)), bool(options.get("case-sensitive", False))]
    pairs = [(p, q) for p, q, on in zip(x, y, levels, strict=True) if on]
    if how == "==":
        return reduce(lambda m, n: m & n, (p == q for p, q in pairs))
    out = F.lit("=" in how)
    for p, q in reversed(pairs):
        out = F.when(p == q, out).otherwise(_COMPARE[how[0]](p, q))
    return out


@op("resolved-locale", 1)
def _locale(_, args, cx):
    spec = args[0]
    return literal(spec[1].get("locale", "en") if isinstance(spec, list) and len(spec) == 2 and isinstance(spec[1], dict) else "en")


@op("is-supported-script", 1)
def _script(_, args, cx):
    return Node(F.lit(True), textual(compile_node(args[0], cx)).err, BOOLEAN)


@op("!", 1)
def _not(_, args, cx):
    n = logical(compile_node(args[0], cx))
    return Node(~n.value, n.err, BOOLEAN)


@op("all any", 0, None)
def _all(name, args, cx):
    out = Node(F.lit(name == "all"), None, BOOLEAN, name == "all", True)
    for n in [logical(compile_node(a, cx)) for a in reversed(args)]:
        on = truth(n.value)
        if name == "all":
            out = Node(on & out.value, any_of(n.err, None if out.err is None else on & out.err), BOOLEAN)
        else:
            out = Node(on | out.value, any_of(n.err, None if out.err is None else ~on & out.err), BOOLEAN)
    return out


@op("case", 3, None)
def _case(_, args, cx):
    if len(args) % 2 == 0:
        raise CompileError("case: conditions and outputs, then a fallback")
    tests = [logical(compile_node(a, cx)) for a in args[:-1:2]]
    outs = [compile_node(a, cx) for a in args[1:-1:2]] + [compile_node(args[-1], cx)]
    kind = unify(outs, "case")
    value, err = cast(outs[-1], kind), outs[-1].err
    for t, o in zip(reversed(tests), reversed(outs[:-1]), strict=True):
        on = truth(t.value)
        value = F.when(on, cast(o, kind)).otherwise(value)
        if err is not None or o.err is not None:
            err = F.when(on, F.lit(False) if o.err is None else o.err).otherwise(F.lit(False) if err is None else err)
        err = any_of(t.err, err)
    return Node(value, err, kind, nullable=any(o.nullable or o.type == NULL for o in outs))


@op("match", 4, None)
def _match(_, args, cx):
    if len(args) % 2:
        raise CompileError("match: an input, labels and outputs, then a fallback")
    x = compile_node(args[0], cx)
    labels, seen = [], set()
    for group in args[1:-1:2]:
        group = group if isinstance(group, list) else [group]
        if not group:
            raise CompileError("match: no labels")
        for v in group:
            if isinstance(v, bool) or not isinstance(v, str | int | float) or isinstance(v, float) and v != int(v) or not isinstance(v, str) and abs(v) > 2**53 - 1:
                raise CompileError(f"match: bad label {v!r}")
            if v in seen or seen and isinstance(v, str) != isinstance(next(iter(seen)), str):
                raise CompileError(f"match: label {v!r} repeats or is of another type")
            seen.add(v)
        labels.append(group)
    outs = [compile_node(a, cx) for a in args[2:-1:2]] + [compile_node(args[-1], cx)]
    kind = unify(outs, "match")
    fits = x.type == (STRING if isinstance(next(iter(seen)), str) else NUMBER)
    value, err = cast(outs[-1], kind), outs[-1].err
    if fits:
        if x.type == STRING and len(seen) > 64 and all(o.is_const for o in outs):
            table = F.create_map(*(y for g, o in zip(labels, outs[:-1], strict=True) for v in g for y in (F.lit(v), cast(o, kind))))
            value = F.coalesce(F.try_element_at(table, x.value), value)
        else:
            for g, o in zip(reversed(labels), reversed(outs[:-1]), strict=True):
                on = truth(x.value.isin(*[float(v) if x.type == NUMBER else v for v in g]))
                value = F.when(on, cast(o, kind)).otherwise(value)
                if err is not None or o.err is not None:
                    err = F.when(on, F.lit(False) if o.err is None else o.err).otherwise(F.lit(False) if err is None else err)
    return Node(value, any_of(x.err, err), kind, nullable=any(o.nullable or o.type == NULL for o in outs))


@op("coalesce", 1, None)
def _coalesce(_, args, cx):
    nodes = [compile_node(a, cx) for a in args]
    kind = unify(nodes, "coalesce")
    value, err = cast(nodes[-1], kind), nodes[-1].err
    for n in reversed(nodes[:-1]):
        here = cast(n, kind)
        value = F.coalesce(here, value)
        err = any_of(n.err, None if err is None else here.isNull() & err)
    return Node(value, err, kind, nullable=all(n.nullable or n.type == NULL for n in nodes))


@op("in", 2)
def _in(_, args, cx):
    needle, hay = compile_node(args[0], cx), compile_node(args[1], cx)
    err = any_of(needle.err, hay.err)
    if hay.type == STRING:
        return Node(truth((F.char_length(hay.value) > 0) & F.contains(hay.value, to_text(needle))) if needle.type != NULL else F.lit(False), err, BOOLEAN)
    if not isinstance(hay.type, Array):
        raise CompileError(f"in: {hay.type}")
    if hay.is_const and hay.value is None:
        same = [v for v in hay.const if literal(v).type == needle.type]
        return Node(truth(needle.value.isin(*same)) if same and needle.type != NULL else F.lit(needle.type == NULL and None in hay.const), err, BOOLEAN)
    if hay.type.item != needle.type:
        return Node(F.lit(False), err, BOOLEAN)
    if hay.is_const:
        return Node(truth(needle.value.isin(*hay.const)), err, BOOLEAN)
    return Node(truth(F.exists(hay.value, lambda v: v.eqNullSafe(needle.value))), err, BOOLEAN)


# -- numbers ----------------------------------------------------------------


def _numbers(args, cx) -> tuple[list[Column], Column | None]:
    nodes = [numeric(compile_node(a, cx)) for a in args]
    return [n.value for n in nodes], any_of(*(n.err for n in nodes))


@op("+ *", 0, None)
def _sum(name, args, cx):
    v, err = _numbers(args, cx)
    if not v:
        return literal(0.0 if name == "+" else 1.0)
    return Node(reduce((lambda a, b: a + b) if name == "+" else (lambda a, b: a * b), v), err, NUMBER)


@op("-", 1, 2)
def _minus(_, args, cx):
    v, err = _numbers(args, cx)
    return Node(-v[0] if len(v) == 1 else v[0] - v[1], err, NUMBER)


def ieee_divide(a: Column, b: Column) -> Column:
    inf, nan = F.lit(math.inf), F.lit(math.nan)
    negative = b.cast("string") == "-0.0"
    by_zero = F.when((a == 0) | F.isnan(a), nan).when((a > 0) != negative, inf).otherwise(-inf)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


@op("/", 2)
def _divide(_, args, cx):
    v, err = _numbers(args, cx)
    return Node(ieee_divide(*v), err, NUMBER)


@op("%", 2)
def _mod(_, args, cx):
    (a, b), err = _numbers(args, cx)
    q = F.try_divide(a, b)
    return Node(F.when(b == 0, F.lit(math.nan)).otherwise(a - b * whole(q, F.floor)), err, NUMBER)


def whole(x: Column, f) -> Column:
    """floor or ceil as a double, for any size of ``x``."""
    return F.when((F.abs(x) >= 2.0**53) | F.isnan(x), x).otherwise(f(x).cast("double"))


def _log(f):
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))


_UNARY = {
    "sqrt": F.sqrt, "abs": F.abs, "round": lambda x: F.when(F.abs(x) >= 2.0**53, x).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")),
    "floor": lambda x: whole(x, F.floor), "ceil": lambda x: whole(x, F.ceil), "ln": _log(F.ln), "log10": _log(F.log10), "log2": _log(F.log2),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
}


@op(" ".join(_UNARY), 1)
def _unary(name, args, cx):
    v, err = _numbers(args, cx)
    return Node(_UNARY[name](v[0]), err, NUMBER)


@op("^", 2)
def _pow(_, args, cx):
    v, err = _numbers(args, cx)
    return Node(F.pow(*v), err, NUMBER)


@op("e pi ln2", 0)
def _constant(name, args, cx):
    return literal({"e": math.e, "pi": math.pi, "ln2": math.log(2)}[name])


@op("min max", 0, None)
def _extreme(name, args, cx):
    v, err = _numbers(args, cx)
    if not v:
        return literal(math.inf if name == "min" else -math.inf)
    # A NaN argument gives way to any number.
    missing = F.lit(math.inf if name == "min" else -math.inf)
    safe = [F.nanvl(x, missing) for x in v]
    best = safe[0] if len(v) == 1 else (F.least if name == "min" else F.greatest)(*safe)
    return Node(F.when(reduce(lambda a, b: a & b, (F.isnan(x) for x in v)), F.lit(math.nan)).otherwise(best), err, NUMBER)


# -- strings and arrays -----------------------------------------------------


def number_text(x: Column) -> Column:
    """The shortest digits that tell a number from others, without an exponent."""
    integer = (x == whole(x, F.floor)) & (F.abs(x) < 1e15)
    text = x.cast("string")
    return F.when(integer, x.cast("long").cast("string")).when(F.contains(text, F.lit("E")), colors.bind(F.struct(x.alias("x"), F.abs(x).alias("a"), F.abs(x).cast("string").alias("text")), _unscaled)).otherwise(text)


def _unscaled(n: Column) -> Column:
    """A number whose text has an exponent, as a plain decimal. Up to 15 digits give no other normal number, so they are the shortest."""
    few = (F.instr(n["text"], "E") <= 17) & (n["a"] >= 2.0**-1022)
    digits = F.when(few, F.struct(F.rtrim(_mantissa(n["text"]), F.lit("0")).alias("digits"), _exponent(n["text"]).alias("power")))
    longer = colors.bind(colors.bind(colors.bind(_whole_digits(n), _written), _shortest), _scaled)
    return F.concat(F.when(n["x"] < 0, "-").otherwise(""), colors.bind(digits.otherwise(longer), _plain))


def _mantissa(text: Column) -> Column:
    return F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit(""))


def _exponent(text: Column) -> Column:
    return F.substring_index(text, "E", -1).cast("int")


def _whole_digits(n: Column) -> Column:
    """A number with all its digits from 2^53 to 2^126, where Java's are not always the nearest."""
    high = F.floor(n["a"] / 2.0**63)
    exact = high.cast("decimal(19,0)") * F.lit(Decimal(2**63)) + (n["a"] - high * 2.0**63).cast("long").cast("decimal(19,0)")
    return F.struct(n["a"].alias("a"), n["text"].alias("text"), F.when((n["a"] >= 2.0**53) & (n["a"] < 2.0**126), exact.cast("string")).alias("whole"))


def _written(n: Column) -> Column:
    """A number with its digits and the power of ten of the first of them."""
    digits, power = F.coalesce(n["whole"], _mantissa(n["text"])), F.coalesce(F.char_length(n["whole"]) - 1, _exponent(n["text"]))
    return F.struct(n["a"].alias("a"), digits.alias("digits"), power.alias("power"))


def _shortest(w: Column) -> Column:
    """``digitsEpower``, where Java before 19 has too many digits: at powers of two, from 2^53 on, next to texts halfway between two numbers.

    At most one text of 15 digits gives a normal number back, and it is the nearest. Of 16 the nearest may fail where the other does not.
    """
    size = F.char_length(w["digits"])

    def cut(k: Column, other: bool = False) -> Column:
        up = (F.substring(w["digits"], k + 1, F.lit(1)) >= "5") != other
        text = F.concat((F.substring(w["digits"], F.lit(1), k).cast("long") + up.cast("long")).cast("string"), F.lit("E"), (w["power"] - k + 1).cast("string"))
        return F.when((size > k) & (text.cast("double") == w["a"]), text)

    subnormal = F.when(w["a"] < 2.0**-1022, F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda k: cut(k)), lambda t: t.isNotNull()), F.lit(0)))
    return F.coalesce(subnormal, cut(F.lit(15)), cut(F.lit(16)), cut(F.lit(16), True), cut(F.lit(17)), F.concat(w["digits"], F.lit("E"), (w["power"] - size + 1).cast("string")))


def _scaled(t: Column) -> Column:
    """Digits without zeros at the end, and the power of ten of the first, of ``digitsEpower``."""
    digits = F.substring_index(t, "E", 1)
    return F.struct(F.rtrim(digits, F.lit("0")).alias("digits"), (_exponent(t) + F.char_length(digits) - 1).alias("power"))


def _plain(s: Column) -> Column:
    digits, power = s["digits"], s["power"]
    size = F.char_length(digits)
    large = F.when(size <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.when(power >= 0, large).otherwise(small)


def to_text(n: Node) -> Column:
    if n.type == NULL:
        return F.lit("")
    if n.type == NUMBER:
        return F.coalesce(number_text(n.value), F.lit(""))
    if n.type == COLOR:
        return colors.to_text(n.value)
    if n.type in (STRING, BOOLEAN):
        return F.coalesce(n.value.cast("string"), F.lit(""))
    if n.type == "formatted":
        return F.array_join(F.transform(n.value, lambda s: s["text"]), "")
    if n.type == "resolvedImage":
        return n.value["name"]
    if n.is_const:
        return F.lit(_json(n.const))
    if isinstance(n.type, Array) and n.type.item in (NUMBER, BOOLEAN):
        return F.concat(F.lit("["), F.array_join(F.transform(n.value, lambda v: to_text(Node(v, None, n.type.item))), ","), F.lit("]"))
    return F.to_json(n.value)


def _json(x: Any) -> str:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, list):
        return "[" + ",".join(map(_json, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in x.items()) + "}"
    return str(int(x)) if x == int(x) else format(Decimal(repr(float(x))), "f")


@op("concat", 0, None)
def _concat(_, args, cx):
    nodes = [compile_node(a, cx) for a in args]
    return Node(F.concat(F.lit(""), *map(to_text, nodes)), any_of(*(n.err for n in nodes)), STRING)


@op("length", 1)
def _length(_, args, cx):
    n = compile_node(args[0], cx)
    if n.type == STRING:
        n = textual(n)
        return Node(F.char_length(n.value).cast("double"), n.err, NUMBER)
    if isinstance(n.type, Array):
        return literal(len(n.const)) if n.is_const else Node(F.size(n.value).cast("double"), any_of(n.err, n.value.isNull()), NUMBER)
    raise CompileError(f"length: {n.type}")


@op("at", 2)
def _at(_, args, cx):
    i, a = numeric(compile_node(args[0], cx)), compile_node(args[1], cx)
    if not isinstance(a.type, Array) or a.value is None:
        raise CompileError(f"at: {a.type}")
    bad = (i.value != whole(i.value, F.floor)) | (i.value < 0) | (i.value >= F.size(a.value))
    return Node(F.get(a.value, F.when(bad, -1).otherwise(i.value).cast("int")), any_of(i.err, a.err, truth(bad)), a.type.item, nullable=True)


@op("slice", 2, 3)
def _slice(_, args, cx):
    n = compile_node(args[0], cx)
    bounds = [numeric(compile_node(a, cx)) for a in args[1:]]
    size = F.char_length(n.value) if n.type == STRING else F.size(n.value)

    def clamp(b: Node) -> Column:
        if b.is_const:  # few nodes: the optimizer multiplies nested conditions
            k = int(b.const)
            return F.lit(k) if k >= 0 else F.greatest(size + k, F.lit(0))
        c = b.value.cast("int")
        return F.greatest(F.when(c < 0, size + c).otherwise(c), F.lit(0))

    a, b = clamp(bounds[0]), clamp(bounds[1]) if len(bounds) > 1 else size
    count = F.greatest(F.least(b, size) - a, F.lit(0))
    err = any_of(n.err, *(x.err for x in bounds))
    if n.type == STRING:
        return Node(F.substring(textual(n).value, a + 1, count), any_of(textual(n).err, err), STRING)
    if isinstance(n.type, Array):
        return Node(F.slice(n.value, a + 1, count), err, Array(n.type.item))
    raise CompileError(f"slice: {n.type}")


@op("index-of", 2, 3)
def _index_of(_, args, cx):
    needle, hay = compile_node(args[0], cx), compile_node(args[1], cx)
    start = numeric(compile_node(args[2], cx)) if len(args) > 2 else literal(0)
    err = any_of(needle.err, hay.err, start.err)
    if hay.type == STRING:
        if needle.type == NULL:
            return literal(-1)
        at = F.greatest(start.value.cast("int"), F.lit(0))
        return Node((F.position(to_text(needle), textual(hay).value, at + 1) - 1).cast("double"), any_of(err, textual(hay).err), NUMBER)
    if not isinstance(hay.type, Array):
        raise CompileError(f"index-of: {hay.type}")
    if hay.type.item != needle.type:
        return Node(F.lit(-1.0), err, NUMBER)
    at = F.when(start.value < 0, F.greatest(F.size(hay.value) + start.value, F.lit(0.0))).otherwise(start.value)
    hits = F.filter(F.transform(hay.value, lambda v, i: F.when(v.eqNullSafe(needle.value) & (i >= at), i)), lambda i: i.isNotNull())
    return Node(F.coalesce(F.get(hits, F.lit(0)).cast("double"), F.lit(-1.0)), err, NUMBER)


@op("upcase downcase", 1)
def _letters(name, args, cx):
    n = textual(compile_node(args[0], cx))
    a, b = (_UPPER.lower(), _UPPER) if name == "upcase" else (_UPPER, _UPPER.lower())
    return Node(F.translate(n.value, a, b), n.err, STRING)


@op("split", 2)
def _split(_, args, cx):
    n, by = textual(compile_node(args[0], cx)), textual(compile_node(args[1], cx))
    if not by.is_const:
        raise CompileError("split: the separator is a literal")
    pattern = "" if not by.const else "\\Q" + by.const.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return Node(F.split(n.value, pattern, -1) if pattern else F.filter(F.split(n.value, ""), lambda c: c != ""), n.err, Array(STRING))


@op("join", 2)
def _join(_, args, cx):
    a, by = compile_node(args[0], cx), textual(compile_node(args[1], cx))
    if not isinstance(a.type, Array):
        raise CompileError(f"join: {a.type}")
    text = F.transform(a.value, lambda v: to_text(Node(v, None, a.type.item)))
    return Node(F.array_join(text, by.const) if by.is_const else F.call_function("array_join", text, by.value), any_of(a.err, by.err), STRING)


# -- types ------------------------------------------------------------------


@op("to-string", 1)
def _to_string(_, args, cx):
    n = compile_node(args[0], cx)
    return Node(to_text(n), n.err, STRING)


NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_number(n: Node) -> Node:
    """A number, or an error if there is none in it."""
    if n.type == NUMBER:
        return Node(F.coalesce(n.value, F.lit(0.0)), n.err, NUMBER)
    if n.type == NULL:
        return literal(0.0)
    if n.type == BOOLEAN:
        return Node(F.coalesce(n.value.cast("double"), F.lit(0.0)), n.err, NUMBER)
    if n.type == STRING:
        read = lambda t: F.when(t.rlike(NUMERIC), t.try_cast("double"))
        v = colors.bind(F.trim(n.value), read)
        v = F.when(n.value.isNull(), 0.0).otherwise(v) if n.nullable else v
        return Node(v, any_of(n.err, v.isNull()), NUMBER)
    return Node(F.lit(None).cast("double"), F.lit(True), NUMBER)


def _first_ok(nodes: list[Node], kind: Any) -> Node:
    value, err = nodes[-1].value, nodes[-1].err
    for n in reversed(nodes[:-1]):
        if n.err is None:
            value, err = n.value, None
        else:
            value = F.when(n.err, value).otherwise(n.value)
            err = None if err is None else n.err & err
    return Node(value, err, kind)


@op("to-number", 1, None)
def _to_number(_, args, cx):
    return _first_ok([as_number(compile_node(a, cx)) for a in args], NUMBER)


def truthy(n: Node) -> Column:
    if n.type == BOOLEAN:
        return truth(n.value)
    if n.type == NUMBER:
        return truth((n.value != 0) & ~F.isnan(n.value))
    if n.type == STRING:
        return truth(n.value != "")
    return F.lit(n.type != NULL)


@op("to-boolean", 1)
def _to_boolean(_, args, cx):
    n = compile_node(args[0], cx)
    return Node(truthy(n), n.err, BOOLEAN)


@op("number string boolean", 1, None)
def _assert(name, args, cx):
    nodes = []
    for n in (compile_node(a, cx) for a in args):
        if n.type == name:
            nodes.append(Node(n.value, any_of(n.err, n.value.isNull() if n.nullable else None), name))
        else:
            nodes.append(Node(F.lit(None).cast(_SQL[name]), F.lit(True), name))
    return _first_ok(nodes, name)


@op("object", 1, None)
def _object(_, args, cx):
    """The first argument that is an object; an error if none is."""
    for n in (compile_node(a, cx) for a in args):
        if n.type == "object":
            return n
    return Node(F.lit(None).cast("string"), F.lit(True), "object")


@op("typeof", 1)
def _typeof(_, args, cx):
    n = compile_node(args[0], cx)
    if isinstance(n.type, Array):
        return literal(f"array<{n.type.item}{f', {n.type.length}' if n.type.length is not None else ''}>")
    return literal(n.type) if not n.nullable or n.type == NULL else Node(F.when(n.value.isNull(), "null").otherwise(n.type), n.err, STRING)


@op("error", 0, 1)
def _error(_, args, cx):
    return Node(F.lit(None).cast("string"), F.lit(True), STRING)


@op("rgb rgba", 3, 4)
def _rgb(_, args, cx):
    v, err = _numbers(args, cx)
    a = v[3] if len(v) == 4 else F.lit(1.0)
    bad = reduce(lambda x, y: x | y, [(c < 0) | (c > 255) for c in v[:3]] + [(a < 0) | (a > 1)])
    return Node(colors.struct(v[0] / 255, v[1] / 255, v[2] / 255, a), any_of(err, bad), COLOR)


@op("to-color", 1, None)
def _to_color(_, args, cx):
    return _first_ok([as_color(compile_node(a, cx)) for a in args], COLOR)


def as_color(n: Node) -> Node:
    if n.type == COLOR:
        return n
    if n.type == STRING and n.is_const:
        parsed = colors.parse(n.const)
        return Node(colors.struct(*map(F.lit, parsed)), None, COLOR) if parsed else Node(colors.struct(*[F.lit(0.0)] * 4), F.lit(True), COLOR)
    if n.type == STRING:
        v = colors.parse_column(n.value)
        return Node(v, any_of(n.err, v.isNull()), COLOR)
    raise CompileError(f"to-color: {n.type}")


@op("to-rgba", 1)
def _to_rgba(_, args, cx):
    n = as_color(compile_node(args[0], cx))
    c = n.value
    return Node(F.array(c["r"] * 255, c["g"] * 255, c["b"] * 255, c["a"] * 1.0), n.err, Array(NUMBER, 4))


@op("array", 1, None)
def _array(_, args, cx):
    kind = args[0] if args[0] in _SQL and len(args) > 1 else None
    rest = args[1:] if kind else args
    size = rest[0] if kind and len(rest) > 1 and isinstance(rest[0], int) and not isinstance(rest[0], bool) else None
    nodes = [compile_node(a, cx) for a in (rest[1:] if size is not None else rest)]
    ok = [n for n in nodes if isinstance(n.type, Array) and (kind is None or n.type.item == kind) and (size is None or n.type.length in (None, size))]
    if not ok:
        return Node(F.array().cast(f"array<{_SQL.get(kind, 'string')}>"), F.lit(True), Array(kind or VALUE, size))
    n = ok[0]
    wrong = any_of(n.err, n.value.isNull() if n.nullable else None, F.size(n.value) != size if size is not None and n.type.length is None else None)
    return Node(n.value, wrong, Array(n.type.item, size if size is not None else n.type.length))


# Marks and fraction digits of currencies, suffixes of units.
CURRENCIES = {"USD": ("$", 2), "EUR": ("€", 2), "JPY": ("¥", 0), "GBP": ("£", 2)}
UNITS = {"meter": " m", "kilometer": " km", "celsius": "°C", "fahrenheit": "°F", "kilobyte": " kB", "megabyte": " MB", "foot": " ft", "mile": " mi"}


def _rounded(x: Column, least: int, most: int) -> Column:
    """A number from 0 on in groups of thousands, with ``least`` to ``most`` digits after the point; its shortest text rounds half up.

    Arithmetic serves where its error is far from a half; ``_rounded_text`` does the other numbers.
    """
    by_text = F.when(x < math.inf, colors.bind(x, lambda v: _rounded_text(v, least, most)))
    if most > 15:
        return by_text
    unit, scaled = 10**most, x * 10.0**most
    under = F.floor(scaled)
    part = scaled - under
    safe = (scaled < 2.0**52) & (F.abs(part - 0.5) > scaled * 2.0**-50) if most else scaled < 2.0**52
    units = under + (part >= 0.5).cast("long")
    head = _div(units, unit) if most else units
    thousands = F.concat(_div(head, 1000).cast("string"), F.lit(","), F.lpad((head % 1000).cast("string"), 3, "0"))
    grouped = F.when(head < 1000, head.cast("string")).when(head < 1000000, thousands).otherwise(F.format_number(head, 0))
    return F.when(safe, F.concat(grouped, _fraction(F.lpad((units % unit).cast("string"), most, "0"), least, most)) if most else grouped).otherwise(by_text)


def _div(a: Column, b: int) -> Column:
    """Whole quotient of a long under 2^53."""
    return ((a - a % b) / b).cast("long")


def _fraction(digits: Column, least: int, most: int) -> Column:
    """The point and ``most`` digits, without zeros at the end beyond ``least``."""
    if least == most:
        return F.concat(F.lit("."), digits)
    if least:
        return F.concat(F.lit("."), F.substring(digits, 1, least), F.rtrim(F.substring(digits, least + 1, most), F.lit("0")))
    return F.rtrim(F.rtrim(F.concat(F.lit("."), digits), F.lit("0")), F.lit("."))


def _rounded_text(x: Column, least: int, most: int) -> Column:
    def fixed(t: Column) -> Column:
        digits = F.when(F.contains(t, F.lit(".")), F.substring_index(t, ".", -1)).otherwise("")
        rounded = F.replace(F.format_number(t.try_cast(f"decimal(38,{min(most, 37)})"), most), F.lit(","), F.lit(""))
        padded = F.concat(F.substring_index(t, ".", 1), F.lit("."), F.rpad(digits, most, "0")) if most else t
        return F.when(F.char_length(digits) > most, rounded).otherwise(padded)

    def grouped(t: Column) -> Column:
        head = F.regexp_replace(F.substring_index(t, ".", 1), r"(\d)(?=(\d{3})+$)", "$1,")
        return F.concat(head, _fraction(F.substring_index(t, ".", -1), least, most)) if most else head

    return colors.bind(colors.bind(number_text(x), fixed), grouped)


@op("number-format", 2)
def _number_format(_, args, cx):
    n, o = numeric(compile_node(args[0], cx)), args[1]
    if not isinstance(o, dict) or not set(o) <= {"locale", "currency", "min-fraction-digits", "max-fraction-digits", "unit"}:
        raise CompileError("number-format: options")
    mark, digits = CURRENCIES.get(o["currency"], (None, 2)) if "currency" in o else ("", None)
    suffix = UNITS.get(o["unit"]) if "unit" in o else ""
    if mark is None or suffix is None:
        return Node(F.lit(None).cast("string"), F.lit(True), STRING)
    least = int(o.get("min-fraction-digits", 0 if digits is None else digits))
    most = max(int(o.get("max-fraction-digits", 3 if digits is None else digits)), least)
    text = _rounded(F.abs(n.value), least, most)
    sign = F.when((n.value < 0) & text.rlike("[1-9]"), "-").otherwise("")
    return Node(F.concat(sign, F.lit(mark), text, F.lit(suffix)), any_of(n.err, F.isnan(n.value) | (F.abs(n.value) == math.inf)), STRING)


# -- curves -----------------------------------------------------------------


def _stops(name: str, args: list) -> list[tuple[float, Any]]:
    if len(args) < 2 or len(args) % 2:
        raise CompileError(f"{name}: stops and outputs come in pairs")
    at = args[::2]
    if any(isinstance(a, bool) or not isinstance(a, int | float) for a in at) or any(a >= b for a, b in zip(at, at[1:], strict=False)):
        raise CompileError(f"{name}: stops ascend")
    return [(float(a), o) for a, o in zip(at, args[1::2], strict=True)]


@op("step", 2, None)
def _step(_, args, cx):
    x = as_number(compile_node(args[0], cx))
    stops = _stops("step", args[2:]) if len(args) > 2 else []
    outs = [compile_node(args[1], cx)] + [compile_node(o, cx) for _, o in stops]
    kind = unify(outs, "step")
    value, err = cast(outs[0], kind), outs[0].err
    for (at, _o), n in zip(stops, outs[1:], strict=True):
        on = x.value >= at
        value = F.when(on, cast(n, kind)).otherwise(value)
        if err is not None or n.err is not None:
            err = F.when(on, F.lit(False) if n.err is None else n.err).otherwise(F.lit(False) if err is None else err)
    return Node(value, any_of(x.err, err), kind, nullable=any(o.nullable or o.type == NULL for o in outs))


def bezier(t: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """y of a unit cubic at x = t, by 30 halvings inside one aggregate."""

    def at(u, a, b):
        return 3 * a * u * (1 - u) * (1 - u) + 3 * b * u * u * (1 - u) + u * u * u

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        low = at(mid, x1, x2) < t
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, halve, lambda s: at((s["lo"] + s["hi"]) / 2, y1, y2))


def progress(x: Column, a: float, b: float, how: list) -> Column:
    kind = how[0]
    if kind == "exponential" and how[1] != 1:
        return (F.pow(F.lit(float(how[1])), x - a) - 1) / (float(how[1]) ** (b - a) - 1)
    t = (x - a) / (b - a)
    return bezier(t, *map(float, how[1:])) if kind == "cubic-bezier" else t


@op("interpolate interpolate-lab interpolate-hcl", 4, None)
def _interpolate(name, args, cx):
    how = args[0]
    if not isinstance(how, list) or not how or how[0] not in ("linear", "exponential", "cubic-bezier"):
        raise CompileError("interpolate: the curve is linear, exponential or cubic-bezier")
    if how[0] == "exponential" and (len(how) != 2 or isinstance(how[1], bool) or not isinstance(how[1], int | float) or how[1] <= 0):
        raise CompileError("interpolate: bad base")
    if how[0] == "cubic-bezier" and (len(how) != 5 or any(isinstance(p, bool) or not isinstance(p, int | float) or not 0 <= p <= 1 for p in how[1:])):
        raise CompileError("interpolate: bad control points")
    given = compile_node(args[1], cx)
    if given.type not in (NUMBER, NULL):
        raise CompileError(f"interpolate: {given.type}")
    x = as_number(given)
    stops = _stops("interpolate", args[2:])
    nodes = [compile_node(o, cx) for _, o in stops]
    if name != "interpolate" or any(n.type == COLOR for n in nodes):
        nodes, blend, kind = [as_color(n) for n in nodes], {"interpolate": colors.mix_rgb, "interpolate-lab": colors.mix_lab, "interpolate-hcl": colors.mix_hcl}[name], COLOR
    elif all(n.type == NUMBER for n in nodes):
        nodes, blend, kind = [numeric(n) for n in nodes], lambda a, b, t: a + t * (b - a), NUMBER
    elif all(isinstance(n.type, Array) and n.type.item == NUMBER and n.type.length == nodes[0].type.length is not None for n in nodes):
        kind = nodes[0].type
        blend = lambda a, b, t: F.zip_with(a, b, lambda p, q: p + t * (q - p))
    else:
        raise CompileError("interpolate: outputs cannot be interpolated")
    value, err = nodes[-1].value, nodes[-1].err
    never = lambda e: F.lit(False) if e is None else e
    some = any(n.err is not None for n in nodes)  # only the outputs around the input can fail
    for (a, _), (b, _), n, m in zip(reversed(stops[:-1]), reversed(stops[1:]), reversed(nodes[:-1]), reversed(nodes[1:]), strict=True):
        inside = x.value <= b if b < stops[-1][0] else x.value < b  # a stop ends its bracket; the last one needs its output alone
        value = F.when(inside, blend(n.value, m.value, progress(x.value, a, b, how))).otherwise(value)
        err = F.when(inside, never(any_of(n.err, m.err))).otherwise(never(err)) if some else None
    value = F.when(x.value <= stops[0][0], nodes[0].value).otherwise(value)
    err = F.when(x.value <= stops[0][0], never(nodes[0].err)).otherwise(never(err)) if some else None
    return Node(value, any_of(x.err, err), kind)


# -- entry points -----------------------------------------------------------


def compile_expr(x: Any, cx: Context, expected: Any = None) -> Node:
    node = compile_node(x, cx)
    if expected == COLOR and node.type in (STRING, COLOR):
        return as_color(node)
    if expected is not None and node.type not in (expected, NULL, VALUE) and not (isinstance(node.type, Array) and isinstance(expected, Array)):
        raise CompileError(f"expected {expected}, found {node.type}")
    return node


def with_default(node: Node, default: Column) -> Column:
    """A property: an error or a null becomes the default."""
    if node.type == NULL:
        return default
    value = node.value if node.err is None else F.when(~node.err, node.value)
    return F.coalesce(value, default)


def as_filter(node: Node) -> Column:
    """A predicate: an error is false; otherwise truthiness."""
    on = truthy(node)
    return on if node.err is None else truth(~node.err) & on
