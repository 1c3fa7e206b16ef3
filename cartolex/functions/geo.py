"""Web-mercator, tile, Hilbert, containment and distance functions as Columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.05112878  # fixed value: where the mercator square ends
EARTH = 40075016.686  # fixed value: metres around the equator


def to_world(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Unit-square mercator, y down; latitude is clamped. The form used for sources."""
    p = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return (lon + 180) / 360, (1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2


def to_world_view(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The form used for views: x wraps, latitude is not clamped."""
    x = (lon + 180) / 360
    s = F.sin(F.radians(lat))
    return x - F.floor(x), 0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi)


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y))))


def tile_of(x: Column, y: Column, z: int) -> tuple[Column, Column]:
    """The tile of a world point, clamped into the pyramid."""
    n = 1 << z
    at = lambda v: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return at(x), at(y)


def tile_rect(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    n = F.pow(F.lit(2.0), z)
    return x / n, y / n, (x + 1) / n, (y + 1) / n


def parent(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    return z - 1, F.shiftright(x, 1), F.shiftright(y, 1)


def contains(z1: Column, x1: Column, y1: Column, z2: Column, x2: Column, y2: Column) -> Column:
    """Whether tile 1 is tile 2 or an ancestor of it."""
    f = F.pow(F.lit(2.0), z2 - z1)
    return (z1 <= z2) & (F.floor(x2 / f) == x1) & (F.floor(y2 / f) == y1)


def hilbert_id(z: int, x: Column, y: Column) -> Column:
    """Position of a tile in the archive order: all tiles of lower zooms, then the Hilbert curve."""
    base = sum(4**i for i in range(z))
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def walk(s, i):
        half = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        rx = F.when(s["x"].bitwiseAND(half) != 0, F.lit(1)).otherwise(0)
        ry = F.when(s["y"].bitwiseAND(half) != 0, F.lit(1)).otherwise(0)
        d = s["d"] + half * half * ((rx * 3).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, half - 1 - s["x"]).otherwise(s["x"]), F.when(flip, half - 1 - s["y"]).otherwise(s["y"])
        swap = ry == 0
        mask = half - 1
        return F.struct(F.when(swap, fy).otherwise(fx).bitwiseAND(mask).alias("x"), F.when(swap, fx).otherwise(fy).bitwiseAND(mask).alias("y"), d.cast("long").alias("d"))

    if z == 0:
        return F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), state, walk, lambda s: s["d"] + F.lit(base).cast("long"))


def wrap(x: Column) -> Column:
    return x - F.floor(x)


def wrap_dx(dx: Column) -> Column:
    """The shorter way round."""
    return dx - F.floor(dx + 0.5)


def meters_per_pixel(lat: Column, z: Column, size: int = 512) -> Column:
    return EARTH * F.cos(F.radians(lat)) / (F.pow(F.lit(2.0), z) * size)


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of an open ring of structs x, y; positive for an exterior (y down)."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))
    return F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)


def within(lon: Column, lat: Column, polygons: list[list[list[tuple[float, float]]]]) -> Column:
    """Whether a point is strictly inside one of literal polygons (rings of lon, lat; even-odd); the boundary is outside.

    Longitudes move by 360 degrees towards the middle of the polygons' span.
    """
    every = [p for poly in polygons for ring in poly for p in ring]
    middle = (min(p[0] for p in every) + max(p[0] for p in every)) / 2
    lon = F.when(lon - middle > 180, lon - 360).when(lon - middle < -180, lon + 360).otherwise(lon)
    found = []
    for poly in polygons:
        odd, edge = F.lit(0), F.lit(False)
        for ring in poly:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (x1, y1) == (x2, y2):
                    continue
                cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
                edge = edge | ((cross == 0) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
                if y1 != y2:
                    crosses = ((lat < y1) != (lat < y2)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
                    odd = odd + crosses.cast("int")
        found.append((odd % 2 == 1) & ~edge)
    return reduce(lambda a, b: a | b, found, F.lit(False))


def crosses(a: Column, b: Column, p: tuple[float, float], q: tuple[float, float]) -> Column:
    """Whether the piece between structs (lon, lat) crosses the literal piece p-q, beyond a mere touch."""
    side = lambda c: (c["lon"] - p[0]) * (q[1] - p[1]) - (c["lat"] - p[1]) * (q[0] - p[0])
    other = lambda x, y: (x - a["lon"]) * (b["lat"] - a["lat"]) - (y - a["lat"]) * (b["lon"] - a["lon"])
    return (side(a) * side(b) < 0) & (other(*p) * other(*q) < 0)


# WGS84.
_RADIUS, _FLATTENING = 6378.137, 1 / 298.257223563


def ruler(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of longitude and latitude near ``lat``."""
    e2 = _FLATTENING * (2 - _FLATTENING)
    cos = F.cos(F.radians(lat))
    w2 = 1 / (1 - e2 * (1 - cos * cos))
    w = F.sqrt(w2)
    m = math.pi / 180 * _RADIUS * 1000
    return m * w * cos, m * w * w2 * (1 - e2)


def distance_to_points(lon: Column, lat: Column, points: list[tuple[float, float]]) -> Column:
    """Metres to the nearest of literal points, on a flat ruler at the feature's latitude."""
    kx, ky = ruler(lat)

    def one(x, y):
        dx = lon - x
        dx = F.when(dx > 180, dx - 360).when(dx < -180, dx + 360).otherwise(dx) * kx
        dy = (lat - y) * ky
        return F.sqrt(dx * dx + dy * dy)

    each = [one(*p) for p in points]
    return each[0] if len(each) == 1 else F.least(*each)


def distance_to_line(lon: Column, lat: Column, line: list[tuple[float, float]]) -> Column:
    """Metres to the nearest place of a literal line."""
    kx, ky = ruler(lat)
    each = []
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        px, py, dx, dy = (lon - x1) * kx, (lat - y1) * ky, (x2 - x1) * kx, (y2 - y1) * ky
        size = dx * dx + dy * dy
        t = F.when(size == 0, 0.0).otherwise(F.least(F.greatest(F.try_divide(px * dx + py * dy, size), F.lit(0.0)), F.lit(1.0)))
        each.append(F.sqrt(F.pow(px - t * dx, F.lit(2.0)) + F.pow(py - t * dy, F.lit(2.0))))
    return each[0] if len(each) == 1 else F.least(*each)
