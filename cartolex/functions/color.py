"""Colours as structs of straight-alpha doubles in 0..1: parsing, text, and blending in RGB, Lab and LCH."""

from __future__ import annotations

import colorsys
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DDL = "struct<r:double,g:double,b:double,a:double>"

# CSS names.
NAMES = {
    "transparent": "#00000000", "aliceblue": "#f0f8ff", "aqua": "#00ffff", "beige": "#f5f5dc", "black": "#000000", "blue": "#0000ff", "brown": "#a52a2a",
    "coral": "#ff7f50", "crimson": "#dc143c", "cyan": "#00ffff", "darkblue": "#00008b", "darkgray": "#a9a9a9", "darkgreen": "#006400", "darkgrey": "#a9a9a9",
    "darkred": "#8b0000", "dimgray": "#696969", "dimgrey": "#696969", "fuchsia": "#ff00ff", "gainsboro": "#dcdcdc", "gold": "#ffd700", "gray": "#808080",
    "green": "#008000", "grey": "#808080", "hotpink": "#ff69b4", "indigo": "#4b0082", "ivory": "#fffff0", "khaki": "#f0e68c", "lavender": "#e6e6fa",
    "lightblue": "#add8e6", "lightgray": "#d3d3d3", "lightgreen": "#90ee90", "lightgrey": "#d3d3d3", "lime": "#00ff00", "magenta": "#ff00ff", "maroon": "#800000",
    "navy": "#000080", "olive": "#808000", "orange": "#ffa500", "orangered": "#ff4500", "pink": "#ffc0cb", "purple": "#800080", "red": "#ff0000",
    "salmon": "#fa8072", "silver": "#c0c0c0", "skyblue": "#87ceeb", "slategray": "#708090", "steelblue": "#4682b4", "tan": "#d2b48c", "teal": "#008080",
    "tomato": "#ff6347", "violet": "#ee82ee", "wheat": "#f5deb3", "white": "#ffffff", "whitesmoke": "#f5f5f5", "yellow": "#ffff00",
}
_FUNCTION = re.compile(r"^(rgb|hsl)a?\(\s*(.*?)\s*\)$")


def parse(text: str) -> tuple[float, float, float, float] | None:
    """(r, g, b, a), or nothing if ``text`` is no colour."""
    t = text.strip().lower()
    t = NAMES.get(t, t)
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", t):
        h = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        v = [int(h[i : i + 2], 16) / 255 for i in range(0, len(h), 2)]
        return (*v[:3], v[3] if len(v) == 4 else 1.0)
    if not (m := _FUNCTION.match(t)):
        return None
    parts = [p for p in re.split(r"[\s,/]+", m[2]) if p]
    if len(parts) not in (3, 4):
        return None
    try:
        a = 1.0 if len(parts) == 3 else float(parts[3].rstrip("%")) / (100 if parts[3].endswith("%") else 1)
        a = min(max(a, 0.0), 1.0)
        if m[1] == "rgb":
            v = [float(p.rstrip("%")) / (100 if p.endswith("%") else 255) for p in parts[:3]]
            return (*(min(max(x, 0.0), 1.0) for x in v), a)
        if not all(p.endswith("%") for p in parts[1:3]):
            return None
        hue, s, li = float(parts[0].removesuffix("deg")) % 360 / 360, *(min(max(float(p[:-1]) / 100, 0.0), 1.0) for p in parts[1:3])
        return (*colorsys.hls_to_rgb(hue, li, s), a)
    except ValueError:
        return None


def struct(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"), (a, "a"))))


def parse_column(c: Column) -> Column:
    """Colours of a column: hexadecimal forms, and names by a literal map; null for others."""
    t = F.lower(F.trim(c))
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), t)
    t = F.coalesce(named, t)
    short = F.regexp_replace(t, "([0-9a-f])", "$1$1")
    t = F.when(t.rlike("^#[0-9a-f]{3,4}$"), short).otherwise(t)
    part = lambda i: F.conv(F.substring(t, i, 2), 16, 10).cast("double") / 255
    a = F.when(F.char_length(t) == 9, part(8)).otherwise(1.0)
    return F.when(t.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), struct(part(2), part(4), part(6), a))


def to_text(c: Column) -> Column:
    return bind(c, _text)


def _text(c: Column) -> Column:
    byte = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("string")
    alpha = F.when(c["a"] == F.floor(c["a"]), c["a"].cast("long").cast("string")).otherwise(c["a"].cast("string"))
    return F.concat(F.lit("rgba("), F.concat_ws(",", byte(c["r"]), byte(c["g"]), byte(c["b"]), alpha), F.lit(")"))


def mix_rgb(a: Column, b: Column, t: Column) -> Column:
    return struct(*(a[k] + t * (b[k] - a[k]) for k in "rgba"))


# sRGB to CIE XYZ (D65), and its inverse; Lab's break.
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
_WHITE = (0.95047, 1.0, 1.08883)
_EPSILON = 6 / 29


def bind(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _named(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def _lab(c: Column) -> Column:
    """Struct l, a, b of a colour."""
    line = lambda x: F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    curve = lambda x: F.when(x > _EPSILON**3, F.cbrt(x)).otherwise(x / (3 * _EPSILON**2) + 4 / 29)
    linear = bind(c, lambda k: _named(r=line(k["r"]), g=line(k["g"]), b=line(k["b"])))
    dot = lambda k, row, w: (k["r"] * row[0] + k["g"] * row[1] + k["b"] * row[2]) / w
    xyz = bind(linear, lambda k: _named(**{n: dot(k, row, w) for n, row, w in zip("xyz", _XYZ, _WHITE, strict=True)}))
    bent = bind(xyz, lambda k: _named(**{n: curve(k[n]) for n in "xyz"}))
    return bind(bent, lambda k: _named(l=116 * k["y"] - 16, a=500 * (k["x"] - k["y"]), b=200 * (k["y"] - k["z"])))


def _from_lab(lab: Column, alpha: Column) -> Column:
    curve = lambda f: F.when(f > _EPSILON, f * f * f).otherwise(3 * _EPSILON**2 * (f - 4 / 29))
    gamma = lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    bent = bind(lab, lambda k: _named(x=(k["l"] + 16) / 116 + k["a"] / 500, y=(k["l"] + 16) / 116, z=(k["l"] + 16) / 116 - k["b"] / 200))
    xyz = bind(bent, lambda k: _named(**{n: w * curve(k[n]) for n, w in zip("xyz", _WHITE, strict=True)}))
    linear = bind(xyz, lambda k: _named(**{n: k["x"] * row[0] + k["y"] * row[1] + k["z"] * row[2] for n, row in zip("rgb", _RGB, strict=True)}))
    return bind(linear, lambda k: struct(*(clamp(gamma(k[n])) for n in "rgb"), alpha))


def mix_lab(a: Column, b: Column, t: Column) -> Column:
    both = _named(p=_lab(a), q=_lab(b), t=t)
    lab = bind(both, lambda k: _named(**{n: k["p"][n] + k["t"] * (k["q"][n] - k["p"][n]) for n in "lab"}))
    return _from_lab(lab, a["a"] + t * (b["a"] - a["a"]))


def mix_hcl(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter way round the hue circle."""

    def lch(c):
        return bind(_lab(c), lambda k: _named(l=k["l"], c=F.sqrt(k["a"] * k["a"] + k["b"] * k["b"]), h=F.atan2(k["b"], k["a"])))

    def between(k):
        turn = k["q"]["h"] - k["p"]["h"]
        turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn)
        return _named(l=k["p"]["l"] + k["t"] * (k["q"]["l"] - k["p"]["l"]), c=k["p"]["c"] + k["t"] * (k["q"]["c"] - k["p"]["c"]), h=k["p"]["h"] + k["t"] * turn)

    mixed = bind(_named(p=lch(a), q=lch(b), t=t), between)
    lab = bind(mixed, lambda k: _named(l=k["l"], a=k["c"] * F.cos(k["h"]), b=k["c"] * F.sin(k["h"])))
    return _from_lab(lab, a["a"] + t * (b["a"] - a["a"]))
