"""Dimension tables of symbols: sprite cells and glyphs; and the shapes of GeoJSON texts."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .varint import Malformed, fields, zigzag

SPRITE = "name string, x int, y int, width int, height int, pixel_ratio double, sdf boolean"
GLYPH = "stack string, code_point int, width int, height int, left int, top int, advance int, bitmap binary"
SHAPE = "kind string, parts array<array<struct<lon:double,lat:double>>>"
BORDER = 3  # pixels around a glyph's bitmap


def sprite_table(spark: SparkSession, index: str, sheet: tuple[int, int] | None = None) -> DataFrame:
    """Cells of a sprite index; those that do not lie within the sheet are left out."""
    rows = []
    for name, c in json.loads(index).items():
        try:
            cell = (int(c["x"]), int(c["y"]), int(c["width"]), int(c["height"]))
        except (KeyError, TypeError, ValueError):
            continue
        inside = min(cell) >= 0 and (sheet is None or cell[0] + cell[2] <= sheet[0] and cell[1] + cell[3] <= sheet[1])
        if inside:
            rows.append((name, *cell, float(c.get("pixelRatio", 1)), bool(c.get("sdf", False))))
    return spark.createDataFrame(rows, SPRITE)


def with_icons(features: DataFrame, sprites: DataFrame, icon: str) -> DataFrame:
    """Features with their icon's cell (``sprite``, null where the sheet has none). A sheet is one page of cells, so it is small."""
    cells = F.broadcast(sprites.select(F.col("name").alias("_name"), F.struct("x", "y", "width", "height", "pixel_ratio", "sdf").alias("sprite")))
    return features.join(cells, F.col(icon) == F.col("_name"), "left").drop("_name")


def glyphs(b: bytes) -> list[tuple]:
    """Rows (stack, code point, width, height, left, top, advance, bitmap) of a glyph range."""
    out = []
    for f, kind, stack in fields(b):
        if f != 1 or kind != 2:
            continue
        name, own = "", []
        for g, how, v in fields(stack):
            if g == 1 and how == 2:
                name = v.decode()
            elif g == 3 and how == 2:
                glyph = {1: None, 2: b"", 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
                for h, _, w in fields(v):
                    glyph[h] = zigzag(w) if h in (5, 6) else w
                if glyph[1] is None:
                    raise Malformed("a glyph without a code point")
                if glyph[2] and len(glyph[2]) != (glyph[3] + 2 * BORDER) * (glyph[4] + 2 * BORDER):
                    raise Malformed("a bitmap of another size")
                own.append(glyph)
        out += [(name, g[1], g[3], g[4], g[5], g[6], g[7], g[2]) for g in own]
    return out


def glyph_table(ranges: DataFrame) -> DataFrame:
    """Glyphs of glyph ranges (``data``); of a code point in several stacks each is a row."""

    def run(batches):
        types = (pa.string(), *[pa.int32()] * 6, pa.binary())
        for b in batches:
            rows = [g for data in b.column("data").to_pylist() for g in glyphs(data or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f.split()[0] for f in GLYPH.split(", ")])

    return ranges.select("data").mapInArrow(run, GLYPH)


def text_advance(texts: DataFrame, glyph: DataFrame, keys: list[str], text: str, em: float = 24.0) -> DataFrame:
    """``keys`` and the ``advance`` of each text: of its code points' glyphs, half an em for a missing one."""
    points = texts.select(*keys, F.explode_outer(F.filter(F.split(text, ""), lambda c: c != "")).alias("c"))
    # A font's glyphs are at most one row per code point.
    one = F.broadcast(glyph.groupBy("code_point").agg(F.min_by("advance", "stack").alias("own")))
    met = points.withColumn("code_point", F.when(F.col("c").isNotNull(), F.expr("conv(hex(encode(c, 'UTF-32')), 16, 10)").cast("int"))).join(one, "code_point", "left")
    width = F.when(F.col("c").isNull(), 0.0).otherwise(F.coalesce(F.col("own").cast("double"), F.lit(em / 2)))
    return met.groupBy(*keys).agg(F.sum(width).alias("advance"))


def shapes(value) -> list[tuple[str, list]]:
    """(kind, parts) of a GeoJSON value: point, line or polygon, with runs of (lon, lat)."""
    if not isinstance(value, dict):
        raise Malformed("no GeoJSON object")
    kind = value.get("type")
    if kind == "Feature":
        return shapes(value["geometry"]) if value.get("geometry") else []
    if kind in ("FeatureCollection", "GeometryCollection"):
        return [s for v in value.get("features" if kind == "FeatureCollection" else "geometries") or [] for s in shapes(v)]
    at = value.get("coordinates")
    run = lambda r: [(float(p[0]), float(p[1])) for p in r]
    try:
        if kind in ("Point", "MultiPoint"):
            return [("point", [run([at] if kind == "Point" else at)])]
        if kind in ("LineString", "MultiLineString"):
            return [("line", [run(r) for r in ([at] if kind == "LineString" else at)])]
        if kind in ("Polygon", "MultiPolygon"):
            return [("polygon", [run(r) for r in p]) for p in ([at] if kind == "Polygon" else at)]
    except (TypeError, IndexError, ValueError) as e:
        raise Malformed("bad coordinates") from e
    raise Malformed(f"no GeoJSON type {kind!r}")


def geojson_table(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, kind and parts: a row for each shape of each GeoJSON text; none for a text that is not GeoJSON."""

    def run(batches):
        point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                try:
                    found = shapes(json.loads(t or ""))
                except (Malformed, ValueError, KeyError):
                    continue
                at += [i] * len(found)
                out += found
            parts = [[[{"lon": x, "lat": y} for x, y in r] for r in p] for _, p in out]
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(index) for k in keys), pa.array([k for k, _ in out], pa.string()), pa.array(parts, pa.list_(pa.list_(point)))], [*keys, "kind", "parts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema) + ", " + SHAPE
    return texts.select(*dict.fromkeys([*keys, text])).mapInArrow(run, schema)
