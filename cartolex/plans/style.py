"""Style documents as plans: each layer is a scan, filters, projected properties and a rank."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolex.functions import color as colors
from cartolex.functions import expression as ex

# Properties of each layer type as (name, type, default, data-driven).
_N, _S, _B, _C = ex.NUMBER, ex.STRING, ex.BOOLEAN, ex.COLOR
PROPERTIES: dict[str, list[tuple[str, Any, Any, bool]]] = {
    "background": [("background-color", _C, "#000", False), ("background-opacity", _N, 1, False)],
    "fill": [("fill-sort-key", _N, None, True), ("fill-antialias", _B, True, False), ("fill-opacity", _N, 1, True), ("fill-color", _C, "#000", True), ("fill-pattern", _S, None, True)],
    "line": [
        ("line-cap", _S, "butt", True), ("line-join", _S, "miter", True), ("line-sort-key", _N, None, True), ("line-opacity", _N, 1, True), ("line-color", _C, "#000", True),
        ("line-width", _N, 1, True), ("line-dasharray", ex.Array(_N), None, True),
    ],
    "symbol": [
        ("symbol-placement", _S, "point", False), ("symbol-spacing", _N, 250, False), ("symbol-sort-key", _N, None, True), ("symbol-z-order", _S, "auto", False),
        ("icon-image", _S, None, True), ("icon-size", _N, 1, True), ("icon-rotate", _N, 0, True), ("icon-allow-overlap", _B, False, False), ("icon-ignore-placement", _B, False, False),
        ("icon-rotation-alignment", _S, "auto", False), ("text-rotation-alignment", _S, "auto", False), ("text-max-width", _N, 10, True), ("text-field", _S, "", True),
        ("text-size", _N, 16, True), ("text-anchor", _S, "center", True), ("text-offset", ex.Array(_N, 2), [0, 0], True), ("text-max-angle", _N, 45, False),
        ("text-allow-overlap", _B, False, False), ("text-optional", _B, False, False), ("text-color", _C, "#000", True), ("text-halo-color", _C, "rgba(0,0,0,0)", True),
        ("text-halo-width", _N, 0, True), ("text-halo-blur", _N, 0, True),
    ],
    "hillshade": [
        ("hillshade-illumination-direction", _N, 335, False), ("hillshade-exaggeration", _N, 0.5, False), ("hillshade-shadow-color", _C, "#000", False),
        ("hillshade-highlight-color", _C, "#fff", False), ("hillshade-accent-color", _C, "#000", False),
    ],
    "color-relief": [("color-relief-color", _C, "rgba(0,0,0,0)", False), ("color-relief-opacity", _N, 1, False)],
    "raster": [("raster-opacity", _N, 1, False)],
}
GEOMETRY = {"fill": ("polygon",), "line": ("linestring", "polygon")}
_ALIGNMENTS = ("map", "viewport", "auto")
ENUMS = {
    "line-cap": ("butt", "round", "square"), "line-join": ("bevel", "round", "miter"), "symbol-placement": ("point", "line", "line-center"),
    "symbol-z-order": ("auto", "viewport-y", "source"), "icon-rotation-alignment": _ALIGNMENTS, "text-rotation-alignment": _ALIGNMENTS,
    "text-anchor": ("center", "left", "right", "top", "bottom", "top-left", "top-right", "bottom-left", "bottom-right"),
}
FEATURE_OPS = {"get", "has", "id", "geometry-type", "properties", "feature-state", "within", "distance"}


class StyleError(ValueError):
    """The document is not a style."""


@dataclass(frozen=True)
class Diagnostic:
    layer: str
    property: str
    message: str


@dataclass(frozen=True)
class Layer:
    id: str
    type: str
    source: str | None = None
    source_layer: str | None = None
    minzoom: float = 0.0
    maxzoom: float = 24.0
    filter: Any = None
    settings: dict = field(default_factory=dict)

    @property
    def sort_key(self) -> str | None:
        return next((n for n, *_ in PROPERTIES[self.type] if n.endswith("sort-key")), None)


def is_expression(x: Any) -> bool:
    return isinstance(x, list) and bool(x) and isinstance(x[0], str) and x[0] in ex._OPS


def reads(x: Any) -> set[str]:
    """Operators used in an expression, outside literals."""
    if not isinstance(x, list) or not x or x[0] == "literal":
        return set()
    return ({x[0]} if isinstance(x[0], str) else set()).union(*(reads(a) for a in x))


def dependency(x: Any) -> str:
    """constant, zoom_only, data_driven or zoom_and_data."""
    used = reads(x) if is_expression(x) else set()
    zoom, data = bool(used & {"zoom", "global-state", "image"}), bool(used & FEATURE_OPS)
    return {(False, False): "constant", (True, False): "zoom_only", (False, True): "data_driven", (True, True): "zoom_and_data"}[zoom, data]


def constant_fits(name: str, kind: Any, value: Any) -> bool:
    """Whether a constant is one of its property's type."""
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    if isinstance(kind, ex.Array):
        return isinstance(value, list) and all(map(number, value)) and kind.length in (None, len(value))
    if kind == ex.COLOR:
        return isinstance(value, str) and colors.parse(value) is not None
    if kind == ex.NUMBER:
        return number(value)
    if kind == ex.BOOLEAN:
        return isinstance(value, bool)
    return isinstance(value, str) and value in ENUMS.get(name, (value,))


def malformed(x: Any, bound: frozenset = frozenset()) -> str | None:
    """What is wrong with an expression whatever the features: an unknown operator, a number of arguments, an unbound name."""
    if isinstance(x, dict):
        return "a bare object is not an expression"
    if not isinstance(x, list):
        return None
    if not x or not isinstance(x[0], str) or x[0] not in ex._OPS:
        return f"unknown operator {x[0]!r}" if x else "an empty array is not an expression"
    name, args = x[0], x[1:]
    least, most, _ = ex._OPS[name]
    if len(args) < least or most is not None and len(args) > most:
        return f"{name}: {len(args)} arguments"
    if name in ("literal", "semiliteral", "within", "distance"):
        return None
    if name == "var":
        return None if args[0] in bound else f"var: {args[0]!r} is not bound"
    if name == "let":
        bound |= frozenset(a for a in args[:-1:2] if isinstance(a, str))
    skip = {"match": lambda i: i % 2 and i < len(args) - 1, "interpolate": lambda i: i == 0, "interpolate-lab": lambda i: i == 0, "interpolate-hcl": lambda i: i == 0}.get(name, lambda i: False)
    inner = (a for i, a in enumerate(args) if isinstance(a, list) and not skip(i) and not (a and a[0] == "collator"))
    return next((m for a in inner if (m := malformed(a, bound))), None)


@dataclass(frozen=True)
class Style:
    layers: tuple[Layer, ...]
    sources: dict
    diagnostics: tuple[Diagnostic, ...] = ()

    @classmethod
    def parse(cls, document: str | dict) -> Style:
        try:
            d = json.loads(document) if isinstance(document, str) else document
        except ValueError as e:
            raise StyleError(str(e)) from e
        if not isinstance(d, dict) or d.get("version") != 8:
            raise StyleError("a style is an object of version 8")
        said, layers, seen = [], [], set()
        for raw in d.get("layers", []):
            name, kind = raw.get("id", ""), raw.get("type")
            if name in seen:
                raise StyleError(f"layer {name!r} is given twice")
            seen.add(name)
            if kind not in PROPERTIES:
                said.append(Diagnostic(name, "type", f"no layer type {kind!r}"))
                continue
            settings = {**raw.get("layout", {}), **raw.get("paint", {})}
            if "line-pattern" in settings:
                said.append(Diagnostic(name, "line-pattern", "not supported"))
                continue
            known = {n: (t, driven) for n, t, _, driven in PROPERTIES[kind]}
            kept = {}
            for prop, value in settings.items():
                if prop == "visibility":
                    kept[prop] = value
                elif prop not in known:
                    said.append(Diagnostic(name, prop, "unknown property"))
                elif isinstance(value, dict):
                    said.append(Diagnostic(name, prop, "legacy function: convert it first"))
                elif isinstance(value, list) and value and isinstance(value[0], str):
                    wrong = malformed(value)
                    if wrong is None and "data" in dependency(value) and not known[prop][1]:
                        wrong = "not data-driven"
                    if wrong is None and value[0] == "literal" and not constant_fits(prop, known[prop][0], value[1]):
                        wrong = "the constant is of another type"
                    if wrong is None:
                        kept[prop] = value
                    else:
                        said.append(Diagnostic(name, prop, wrong))
                elif not constant_fits(prop, known[prop][0], value):
                    said.append(Diagnostic(name, prop, "the constant is of another type"))
                else:
                    kept[prop] = value
            layers.append(Layer(name, kind, raw.get("source"), raw.get("source-layer"), float(raw.get("minzoom", 0)), float(raw.get("maxzoom", 24)), raw.get("filter"), kept))
        return cls(tuple(layers), d.get("sources", {}), tuple(said))

    def check(self, schemas: dict[str, Any], zoom: float = 0.0) -> tuple[Diagnostic, ...]:
        """The diagnostics, and those of expressions that do not compile over the schema of their layer's source."""
        said = list(self.diagnostics)
        for layer in self.layers:
            if layer.source not in schemas:
                continue
            cx = ex.Context(schemas[layer.source], zoom=zoom)
            kinds = {n: t for n, t, *_ in PROPERTIES[layer.type]}
            for name, value in [("filter", layer.filter), *((n, v) for n, v in layer.settings.items() if n in kinds and is_expression(v))]:
                try:
                    ex.compile_expr(value, cx, kinds.get(name))
                except ex.CompileError as e:
                    said.append(Diagnostic(layer.id, name, str(e)))
        return tuple(said)

    def _with(self, layer: str, change) -> Style:
        return replace(self, layers=tuple(change(x) if x.id == layer else x for x in self.layers))

    def with_property(self, layer: str, name: str, value: Any) -> Style:
        return self._with(layer, lambda x: replace(x, settings={**x.settings, name: value}))

    def with_filter(self, layer: str, value: Any) -> Style:
        return self._with(layer, lambda x: replace(x, filter=value))

    def with_visibility(self, layer: str, shown: bool) -> Style:
        return self.with_property(layer, "visibility", "visible" if shown else "none")


def default(kind: Any, value: Any) -> Column:
    if kind == ex.COLOR:
        return colors.struct(*map(F.lit, colors.parse(value)))
    if value is None:
        return F.lit(None).cast(ex.sql_type(kind))
    return F.array(*(F.lit(float(v)) for v in value)) if isinstance(value, list) else F.lit(float(value) if kind == ex.NUMBER else value)


def compile_filter(layer: Layer, cx: ex.Context) -> Column | None:
    """The predicate; raises CompileError, upon which the layer is dropped."""
    return None if layer.filter is None else ex.as_filter(ex.compile_expr(layer.filter, cx))


def property_column(layer: Layer, name: str, cx: ex.Context) -> tuple[Column, Column]:
    """(value with the default in place of errors and nulls, whether there was an error)."""
    kind, fallback = next((t, d) for n, t, d, _ in PROPERTIES[layer.type] if n == name)
    base = default(kind, fallback)
    if name not in layer.settings:
        return base, F.lit(False)
    value = layer.settings[name]
    try:
        node = ex.compile_expr(value if is_expression(value) or not isinstance(value, list) else ["literal", value], cx, kind)
    except ex.CompileError:
        return base, F.lit(False)
    return ex.with_default(node, base), F.lit(False) if node.err is None else ex.truth(node.err)


def symbol_geometry(layer: Layer) -> tuple[str, ...]:
    """Lines and outlines for labels along lines, points for others."""
    return ("linestring", "polygon") if layer.settings.get("symbol-placement") in ("line", "line-center") else ("point",)


def painted(layer: Layer, cx: ex.Context) -> Column | None:
    """The colour that fills and lines are drawn in: alpha times the opacity, held to 0..1; null where the expression fails or is null, which skips the feature."""
    name = f"{layer.type}-color"
    if name not in layer.settings:
        color = property_column(layer, name, cx)[0]
    else:
        try:
            value = layer.settings[name]
            node = ex.compile_expr(value, cx, ex.COLOR)
        except ex.CompileError:
            return property_column(replace(layer, settings={}), name, cx)[0]
        color = cast_color(node)
    opacity = F.least(F.greatest(property_column(layer, f"{layer.type}-opacity", cx)[0], F.lit(0.0)), F.lit(1.0))
    return F.when(color.isNotNull(), colors.struct(color["r"], color["g"], color["b"], color["a"] * opacity))


def cast_color(node: ex.Node) -> Column:
    if node.type == ex.NULL:
        return F.lit(None).cast(colors.DDL)
    return node.value if node.err is None else F.when(~ex.truth(node.err), node.value)


def layer_query(df: DataFrame, layer: Layer, index: int, layers: int, zoom: float, properties: list[str] | None = None, keep: list[str] = (), tile: list[str] = (), seq: str = "feature_seq", geometry: str | None = None, source_columns: bool = False, paint: bool = False) -> DataFrame | None:
    """Gates, filter, properties, then rank and depth within layer and tile; nothing if the layer does not apply.

    ``paint`` adds the drawn ``color`` of fills and lines and skips features without one.
    """
    if not layer.minzoom <= zoom < layer.maxzoom or layer.settings.get("visibility") == "none":
        return None
    cx = ex.Context(df.schema, zoom=zoom, geometry_column=geometry, id_column="id" if "id" in df.columns else None)
    try:
        on = compile_filter(layer, cx)
    except ex.CompileError:
        return None
    if source_columns:
        df = df.where((F.col("source") == layer.source) & (F.col("layer") == layer.source_layer))
    admitted = symbol_geometry(layer) if layer.type == "symbol" else GEOMETRY.get(layer.type)
    if geometry and admitted:
        df = df.where(F.lower(F.col(geometry)).isin(*admitted))
    if on is not None:
        df = df.where(on)
    names = properties if properties is not None else [n for n, *_ in PROPERTIES[layer.type]]
    built = {n: property_column(layer, n, cx) for n in names}
    drawn = painted(layer, cx) if paint and layer.type in GEOMETRY else None
    if drawn is not None:
        df, drawn = df.withColumn("_color", drawn).where(F.col("_color").isNotNull()), F.col("_color")
    key = property_column(layer, layer.sort_key, cx)[0] if layer.sort_key else F.lit(None).cast("double")
    errors = F.lit(0)
    for _, e in built.values():
        errors = errors + e.cast("int")
    out = df.select(F.lit(index).alias("layer_idx"), F.lit(layer.id).alias("layer_id"), *keep, *tile, F.col(seq).alias("_seq"), F.coalesce(key, F.lit(0.0)).alias("_key"), errors.alias("eval_errors"), *(c.alias(n.replace("-", "_")) for n, (c, _) in built.items()), *([drawn.alias("color")] if drawn is not None else []))
    within = Window.partitionBy("layer_idx", *tile)
    rank = (F.row_number().over(within.orderBy("_key", "_seq")) - 1).cast("long")
    band = 1.0 / (layers + 1)
    depth = 1 - (index + 1) / (layers + 1) - band * (rank + 1) / (F.count("*").over(within) + 2)
    return out.withColumn("rank", rank).withColumn("depth", depth).drop("_seq", "_key")


def run_style(style: Style, sources: dict[str, DataFrame], zoom: float, keep: list[str], tile: list[str] = (), seq: str = "feature_seq", geometry: str | None = None) -> DataFrame:
    """Union of all layer queries in style order; ``properties`` holds each layer's own as JSON."""
    parts = []
    for i, layer in enumerate(style.layers):
        if layer.source not in sources:
            continue
        part = layer_query(sources[layer.source], layer, i, len(style.layers), zoom, list(n for n in layer.settings if n != "visibility"), list(keep), list(tile), seq, geometry)
        if part is not None:
            own = [c for c in part.columns if c not in {"layer_idx", "layer_id", *keep, *tile, "eval_errors", "rank", "depth"}]
            props = F.to_json(F.struct(*own)) if own else F.lit("{}")
            parts.append(part.select("layer_idx", "layer_id", *keep, *tile, "rank", "depth", "eval_errors", props.alias("properties")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zoom_pair(layer: Layer, name: str, schema, zoom: float) -> tuple[Column, Column]:
    """A property at floor(zoom) and at the next zoom."""
    low = float(int(zoom // 1))
    return tuple(property_column(layer, name, ex.Context(schema, zoom=z))[0] for z in (low, low + 1))
