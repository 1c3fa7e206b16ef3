"""Geometry-producing kernels: dashes, placement, strokes, triangulation, collision, batching, elevation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- lines --------------------------------------------------------------------


def dash_pattern(dashes: list[float], width: float) -> list[float] | None:
    """Lengths in line units (on, off, ...): negatives are 0, an odd count is doubled. None: solid; empty: nothing is drawn."""
    d = [max(0.0, float(x)) * width for x in dashes]
    if len(d) % 2:
        d = d + d
    if not d or sum(d) <= 0:
        return None
    merged: list[float] = []
    for on, off in zip(d[::2], d[1::2], strict=True):  # a gap of nothing joins its neighbours
        if merged and merged[-1] == 0:
            merged[-2] += on
            merged[-1] = off
        else:
            merged += [on, off]
    if all(x == 0 for x in merged[::2]):
        return []
    return None if all(x == 0 for x in merged[1::2]) else merged


def dash_runs(length: float, dashes: list[float], width: float, most: int = 4096) -> list[tuple[float, float]]:
    """(from, to) of the drawn runs along a line of ``length``; more than ``most`` periods are drawn solid."""
    p = dash_pattern(dashes, width)
    if p is None or p and length / sum(p) > most:
        return [(0.0, length)]
    out, at = [], 0.0
    while p and at < length:
        for on, off in zip(p[::2], p[1::2], strict=True):
            if at >= length:
                break
            if on > 0:
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], min(at + on, length))
                else:
                    out.append((at, min(at + on, length)))
            at += on + off
    return out


def dash_table(lines: DataFrame, dashes: list[float], most: int = 4096) -> DataFrame:
    """(id, k, t0, t1) for lines (id, length, width), as native expressions.

    The pattern is in multiples of the width; a dash over the end of a period is
    one dash; more than ``most`` periods, or no gaps, are one solid run.
    """
    length, solid = F.col("length"), lambda df: df.select("id", F.lit(0).alias("k"), F.lit(0.0).alias("t0"), F.col("length").alias("t1"))
    p = dash_pattern(dashes, 1.0)
    if p is None:
        return solid(lines)
    if not p:
        return solid(lines.limit(0))
    period, starts = sum(p), np.concatenate([[0.0], np.cumsum(p)[1:-1:2]]).tolist()
    runs = [[at, on, False] for at, on in zip(starts, p[::2], strict=True) if on > 0]
    if p[-1] == 0 and len(runs) > 1 and runs[0][0] == 0:  # the last dash goes on as the first of the next period
        runs[-1][1] += runs[0][1]
        runs[0][2] = True
    cycles = length / (F.lit(period) * F.col("width"))
    few = cycles <= most
    n = F.greatest(F.ceil(F.when(few, cycles).otherwise(1)).cast("int"), F.lit(1))
    one = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(on).alias("on"), F.lit(once).alias("once")) for i, (a, on, once) in enumerate(runs)))
    out = lines.where(few).select("id", "length", "width", F.explode(F.sequence(F.lit(0), n - 1)).alias("c")).select("*", F.explode(one).alias("r")).where(~F.col("r.once") | (F.col("c") == 0))
    t0 = (F.col("c") * F.lit(period) + F.col("r.a")) * F.col("width")
    out = out.select("id", (F.col("c") * len(runs) + F.col("r.i")).alias("k"), t0.alias("t0"), F.least(t0 + F.col("r.on") * F.col("width"), length).alias("t1")).where("t0 < t1")
    return out.unionByName(solid(lines.where(~few)))


def anchors_along(points: np.ndarray, spacing: float, center: bool = False, extent: float | None = None, max_angle: float | None = None, window: float = 0.0) -> list[tuple[float, float, float]]:
    """(x, y, angle) of labels along a line: the first at half the spacing; a shorter line has its middle.

    With ``extent``, only anchors in [0, extent) are this tile's. With
    ``max_angle`` (degrees), places where the line turns more within ``window``
    are passed over.
    """
    p = np.asarray(points, float)
    if len(p) < 2:
        return []
    seg = np.hypot(*np.diff(p, axis=0).T)
    at = np.concatenate([[0.0], np.cumsum(seg)])
    total = at[-1]
    if total <= 0:
        return []
    places = np.array([total / 2]) if center or total < spacing / 2 else np.arange(spacing / 2, total, spacing)
    turn = np.arctan2(*np.diff(p, axis=0).T[::-1])
    out = []
    for t in places:
        i = min(int(np.searchsorted(at, t, "right")) - 1, len(seg) - 1)
        f = (t - at[i]) / seg[i] if seg[i] else 0.0
        x, y = p[i] + f * (p[i + 1] - p[i])
        if extent is not None and not (0 <= x < extent and 0 <= y < extent):
            continue
        if max_angle is not None:
            inside = np.flatnonzero((at[1:-1] > t - window / 2) & (at[1:-1] < t + window / 2))
            bend = np.abs((turn[inside + 1] - turn[inside] + math.pi) % (2 * math.pi) - math.pi).sum()
            if math.degrees(bend) > max_angle:
                continue
        out.append((float(x), float(y), float(turn[i])))
    return out


def stroke(points: list[tuple[float, float]], width: float, join: str = "miter", cap: str = "butt", miter_limit: float = 2.0) -> list[tuple]:
    """Triangles of a stroked line: a quad per segment, joins and caps."""
    p = [q for i, q in enumerate(map(tuple, points)) if not i or q != tuple(points[i - 1])]
    h, out = width / 2, []

    def unit(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = math.hypot(dx, dy)
        return dx / n, dy / n

    def fan(c, a0, a1):
        n = max(1, math.ceil(abs(a1 - a0) / 0.4))
        ring = [(c[0] + h * math.cos(a0 + (a1 - a0) * i / n), c[1] + h * math.sin(a0 + (a1 - a0) * i / n)) for i in range(n + 1)]
        out.extend((c, ring[i], ring[i + 1]) for i in range(n))

    for a, b in zip(p, p[1:], strict=False):
        ux, uy = unit(a, b)
        nx, ny = -uy * h, ux * h
        x0 = (a[0] - ux * h, a[1] - uy * h) if cap == "square" and a == p[0] else a
        x1 = (b[0] + ux * h, b[1] + uy * h) if cap == "square" and b == p[-1] else b
        q = [(x0[0] + nx, x0[1] + ny), (x0[0] - nx, x0[1] - ny), (x1[0] + nx, x1[1] + ny), (x1[0] - nx, x1[1] - ny)]
        out += [(q[0], q[1], q[2]), (q[1], q[3], q[2])]
    for a, b, c in zip(p, p[1:], p[2:], strict=False):
        u, v = unit(a, b), unit(b, c)
        turn = u[0] * v[1] - u[1] * v[0]
        side = -1 if turn > 0 else 1
        e0, e1 = (b[0] - side * u[1] * h, b[1] + side * u[0] * h), (b[0] - side * v[1] * h, b[1] + side * v[0] * h)
        if join == "round":
            a0, a1 = math.atan2(e0[1] - b[1], e0[0] - b[0]), math.atan2(e1[1] - b[1], e1[0] - b[0])
            fan(b, a0, a0 + (a1 - a0 + math.pi) % (2 * math.pi) - math.pi)
            continue
        out.append((b, e0, e1))
        cos_half = math.sqrt(max(0.0, (1 + u[0] * v[0] + u[1] * v[1]) / 2))
        if join == "miter" and cos_half > 0 and 1 / cos_half <= miter_limit:
            mx, my = (e0[0] + e1[0]) / 2 - b[0], (e0[1] + e1[1]) / 2 - b[1]
            n = math.hypot(mx, my)
            if n:
                tip = (b[0] + mx / n * h / cos_half, b[1] + my / n * h / cos_half)
                out.append((e0, tip, e1))
    if cap == "round" and len(p) > 1:
        for end, other in ((p[0], p[1]), (p[-1], p[-2])):
            a = math.atan2(end[1] - other[1], end[0] - other[0])
            fan(end, a - math.pi / 2, a + math.pi / 2)
    return out


# -- polygons -----------------------------------------------------------------


def area2(ring) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))


def group_rings(rings: list) -> list[list]:
    """Polygons: an exterior (positive area) and the rings after it that are not; holes before any exterior are dropped."""
    out: list[list] = []
    for r in rings:
        if area2(r) > 0:
            out.append([r])
        elif out:
            out[-1].append(r)
    return out


def _clean(ring):
    r = [tuple(p) for p in ring]
    r = [p for i, p in enumerate(r) if p != r[i - 1]]
    return r if len(r) > 2 else []


def triangulate(rings: list) -> list[tuple]:
    """Triangles of a polygon with holes, by ear clipping of one outline to which holes are bridged."""
    rings = [r for r in map(_clean, rings) if r]
    if not rings:
        return []
    outer = rings[0] if area2(rings[0]) > 0 else rings[0][::-1]
    holes = sorted((r if area2(r) < 0 else r[::-1] for r in rings[1:]), key=lambda r: -max(r)[0])
    for hole in holes:  # from the rightmost: a bridge to a visible vertex
        m = max(range(len(hole)), key=lambda i: hole[i])
        q = hole[m]
        order = sorted(range(len(outer)), key=lambda i: (outer[i][0] - q[0]) ** 2 + (outer[i][1] - q[1]) ** 2)
        edges = [e for ring in (outer, *holes) for e in zip(ring, ring[1:] + ring[:1], strict=True)]
        k = next((i for i in order if not any(_cross(q, outer[i], a, b) for a, b in edges)), order[0])
        outer = outer[: k + 1] + hole[m:] + hole[: m + 1] + outer[k:]
    out, idx = [], list(range(len(outer)))
    stuck = 0
    while len(idx) > 3 and stuck < len(idx):
        n = len(idx)
        for j in range(n):
            a, b, c = outer[idx[j - 1]], outer[idx[j]], outer[idx[(j + 1) % n]]
            turn = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
            if turn < 0 or turn > 0 and any(_inside(outer[i], a, b, c) for i in idx if outer[i] not in (a, b, c)):
                continue
            if turn > 0:
                out.append((a, b, c))
            idx.pop(j)
            break
        else:
            idx.pop(min(range(n), key=lambda j: abs(area2([outer[idx[j - 1]], outer[idx[j]], outer[idx[(j + 1) % n]]]))))
            stuck += 1
    if len(idx) == 3 and area2([outer[i] for i in idx]) > 0:
        out.append(tuple(outer[i] for i in idx))
    return out


def _orient(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _cross(p, q, a, b) -> bool:
    """Whether segments meet other than in their ends."""
    if a in (p, q) or b in (p, q):
        return False
    return (_orient(p, q, a) > 0) != (_orient(p, q, b) > 0) and (_orient(a, b, p) > 0) != (_orient(a, b, q) > 0)


def _inside(p, a, b, c) -> bool:
    return _orient(a, b, p) >= 0 and _orient(b, c, p) >= 0 and _orient(c, a, p) >= 0


# -- labels -------------------------------------------------------------------

PLACED = "view long, label long, x0 double, y0 double, x1 double, y1 double, placed boolean, slack double"


def place_boxes(boxes: pd.DataFrame, cell: float = 64.0) -> pd.DataFrame:
    """Greedy placement in the order given. Columns: label, x0, y0, x1, y1, allow, ignore.

    Boxes overlap strictly. ``allow`` places regardless; ``ignore`` is checked but
    blocks nobody. ``slack``: how far one may zoom out before a placed box meets
    one that was placed before.
    """
    grid: dict[tuple[int, int], list[int]] = {}
    placed, slack, rows = [], [], boxes[["x0", "y0", "x1", "y1"]].to_numpy(float)
    for i, ((x0, y0, x1, y1), allow, ignore) in enumerate(zip(rows, boxes["allow"], boxes["ignore"], strict=True)):
        cells = [(cx, cy) for cx in range(math.floor(x0 / cell), math.floor(x1 / cell) + 1) for cy in range(math.floor(y0 / cell), math.floor(y1 / cell) + 1)]
        near = {j for c in cells for j in grid.get(c, ())}
        hit = any(x0 < rows[j][2] and rows[j][0] < x1 and y0 < rows[j][3] and rows[j][1] < y1 for j in near)
        ok = bool(allow) or not hit
        gap = math.inf
        if ok and not hit:
            for j in near:
                a = rows[j]
                rx = abs((x0 + x1) - (a[0] + a[2])) / max(1e-9, (x1 - x0) + (a[2] - a[0]))
                ry = abs((y0 + y1) - (a[1] + a[3])) / max(1e-9, (y1 - y0) + (a[3] - a[1]))
                gap = min(gap, max(rx, ry))
        placed.append(ok)
        slack.append(max(0.0, math.log2(gap)) if 0 < gap < math.inf else 0.0)
        if ok and not ignore:
            for c in cells:
                grid.setdefault(c, []).append(i)
    return boxes.assign(placed=placed, slack=slack)


def collide(labels: DataFrame, order: list[str]) -> DataFrame:
    """Placement per view: order-dependent within a view, so a view is one group; views are what runs in parallel."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = place_boxes(pdf.sort_values(order, kind="stable"))
        return out[["view", "label", "x0", "y0", "x1", "y1", "placed", "slack"]]

    return labels.groupBy("view").applyInPandas(one, PLACED)


def wrap_text(text: str, advance, max_width: float, most: int = 8) -> list[str]:
    """Lines by hard breaks and greedy wrapping at spaces; words are not split; ``most`` lines at most."""
    lines = []
    for hard in text.split("\n"):
        line = ""
        for word in hard.split(" "):
            wider = f"{line} {word}" if line else word
            if line and sum(map(advance, wider)) > max_width:
                lines.append(line)
                line = word
            else:
                line = wider
        lines.append(line)
    return lines[:most]


# -- draw ranges --------------------------------------------------------------


def merge_ranges(df: DataFrame, key: list[str], start: str, end: str, partition: list[str]) -> DataFrame:
    """Runs of contiguous ranges of one key, as gaps and islands."""
    w = Window.partitionBy(*partition).orderBy(start)
    same = F.lag(end).over(w) == F.col(start)
    for k in key:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    marked = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*partition, "_island", *key).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def zoom_quantum(z: Column) -> Column:
    return F.least(F.lit(65535), F.floor(z * 256)).cast("int")


def width_slope(w0: Column, w1: Column) -> tuple[Column, Column]:
    """(slope of a width curve between two zooms, the same in steps of 1/32 around 128)."""
    s = F.when((w0 > 0) & (w1 > 0), F.log2(w1 / w0)).otherwise(0.0)
    return s, F.least(F.greatest(F.round(s * 32) + 128, F.lit(0.0)), F.lit(255.0)).cast("int")


def baked_width(w: Column, s: Column, z: float) -> Column:
    return w * F.pow(F.lit(2.0), -s * (z - math.floor(z)))


# -- elevation ----------------------------------------------------------------


def decode_elevation(r: Column, g: Column, b: Column, encoding: str = "mapbox") -> Column:
    if encoding == "terrarium":
        return r * 256.0 + g + b / 256.0 - 32768.0
    return (r * 65536.0 + g * 256.0 + b) * 0.1 - 10000.0


def _lit(grid: np.ndarray, cell: float, azimuth: float, exaggeration: float) -> tuple[np.ndarray, np.ndarray]:
    """(signed departure from flat ground's light as a share of what is possible, steepness), by Horn's 3x3 slopes with clamped edges."""
    p = np.pad(np.asarray(grid, float), 1, mode="edge")
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    scale = exaggeration / (2 * max(cell, 1e-4))
    dx = (at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)) * scale
    dy = (at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)) * scale
    flat = math.sin(math.radians(45))  # the sun's height is fixed
    steep = np.sin(np.arctan(np.hypot(dx, dy)))
    turn = math.radians(90 - azimuth) - np.arctan2(dy, -dx)
    light = np.clip(flat * np.sqrt(1 - steep * steep) + flat * steep * np.cos(turn), 0, 1)
    return np.where(light < flat, (light - flat) / flat, (light - flat) / (1 - flat)), steep


def hillshade(grid: np.ndarray, cell: float, azimuth: float = 335.0, exaggeration: float = 0.5) -> np.ndarray:
    """Signed departure from flat ground's light: 0 where it is flat, -1 in full shadow, 1 in full light."""
    return _lit(grid, cell, azimuth, exaggeration)[0]


def hillshade_rgba(grid: np.ndarray, cell: float, azimuth: float = 335.0, exaggeration: float = 0.5, shadow=(0.0, 0.0, 0.0, 1.0), highlight=(1.0, 1.0, 1.0, 1.0), accent=(0.0, 0.0, 0.0, 1.0)) -> np.ndarray:
    """The overlay's colours (h, w, 4): shadow or highlight by the departure, which is their alpha, towards the accent by a share of the steepness."""
    away, steep = _lit(grid, cell, azimuth, exaggeration)
    base = np.where((away < 0)[..., None], np.array(shadow), np.array(highlight))
    out = base + (np.array(accent) - base) * (0.35 * np.clip(steep, 0, 1))[..., None]
    out[..., 3] = np.clip(out[..., 3] * np.abs(away), 0, 1)
    return out


def hillshade_table(pixels: DataFrame, cell: float, azimuth: float = 335.0, exaggeration: float = 0.5, tile: list[str] = ("z", "x", "y")) -> DataFrame:
    """Hillshade of tiles given as rows (tile, w, h, elevations), a tile at a time."""

    def run(batches):
        for b in batches:
            b = b.copy()
            b["shade"] = [hillshade(np.array(e, float).reshape(h, w), cell, azimuth, exaggeration).reshape(-1) for e, w, h in zip(b.elevation, b.w, b.h, strict=True)]
            yield b[[*tile, "shade"]]

    return pixels.mapInPandas(run, ", ".join(f"{c} int" for c in tile) + ", shade array<double>")


def relief_color(elevation: Column, ramp: list[tuple[float, tuple[float, float, float, float]]]) -> Column:
    """Colour of a height on a piecewise-linear ramp, clamped at its ends."""
    from cartolex.functions import color as colors

    lit = [(float(h), colors.struct(*map(F.lit, map(float, c)))) for h, c in ramp]
    out = lit[-1][1]
    for (a, p), (b, q) in zip(reversed(lit[:-1]), reversed(lit[1:]), strict=True):
        out = F.when(elevation < b, colors.mix_rgb(p, q, (elevation - a) / (b - a))).otherwise(out)
    return F.when(elevation <= lit[0][0], lit[0][1]).otherwise(out)
