"""Vector tiles: bytes to feature rows."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame

from .varint import Malformed, fields, packed, varint, zigzag

KINDS = ("unknown", "point", "linestring", "polygon")
POINT = "struct<x:int,y:int>"
SCHEMA = f"z int, x int, y int, layer string, extent int, feature_seq int, id decimal(20,0), geom_type string, parts array<array<{POINT}>>, props map<string,string>"


def _value(b: bytes):
    for f, _, v in fields(b):
        if f == 1:
            return v.decode()
        if f == 2:
            return struct.unpack("<f", v)[0]
        if f == 3:
            return struct.unpack("<d", v)[0]
        if f == 4:
            return v - (1 << 64) if v >> 63 else v
        if f == 5:
            return v
        if f == 6:
            return zigzag(v)
        if f == 7:
            return bool(v)
    raise Malformed("a value without a field")


def geometry(b: bytes, kind: int) -> list[list[tuple[int, int]]]:
    """Parts of a geometry: all points in one part; a line or an open ring each."""
    parts, x, y, at = [], 0, 0, 0
    while at < len(b):
        command, at = varint(b, at)
        what, n = command & 7, command >> 3
        if what == 7:
            continue
        if what not in (1, 2) or what == 2 and not parts:
            raise Malformed(f"command {what}")
        for _ in range(n):
            dx, at = varint(b, at)
            dy, at = varint(b, at)
            x, y = x + zigzag(dx), y + zigzag(dy)
            if what == 1 and (kind != 1 or not parts):
                parts.append([])
            parts[-1].append((x, y))
    return parts


def decode(b: bytes) -> list[dict]:
    """Features of all layers, in order."""
    out = []
    for f, kind, layer in fields(b):
        if f != 3 or kind != 2:
            continue
        name, extent, keys, values, features = None, 4096, [], [], []
        for g, _, v in fields(layer):
            if g == 1:
                name = v.decode()
            elif g == 2:
                features.append(v)
            elif g == 3:
                keys.append(v.decode())
            elif g == 4:
                values.append(_value(v))
            elif g == 5:
                extent = v
        if name is None:
            raise Malformed("a layer without a name")
        for seq, feature in enumerate(features):
            own = {"layer": name, "extent": extent, "feature_seq": seq, "id": None, "geom_type": "unknown", "parts": [], "props": {}}
            shape, kind_no = b"", 0
            for g, _, v in fields(feature):
                if g == 1:
                    own["id"] = v
                elif g == 2:
                    tags = packed(v)
                    if len(tags) % 2 or any(k >= len(keys) for k in tags[::2]) or any(k >= len(values) for k in tags[1::2]):
                        raise Malformed("tags out of range")
                    own["props"] = {keys[k]: values[w] for k, w in zip(tags[::2], tags[1::2], strict=True)}
                elif g == 3:
                    kind_no = v
                elif g == 4:
                    shape = v
            own["geom_type"] = KINDS[kind_no] if kind_no < 4 else "unknown"
            own["parts"] = geometry(shape, kind_no)
            out.append(own)
    return out


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """Feature rows of tiles (z, x, y, data). Property values are JSON texts, so that their types are kept."""

    def run(batches):
        from decimal import Decimal

        for b in batches:
            rows = []
            for t in b.itertuples(index=False):
                for f in decode(bytes(t.data)):
                    f["id"] = None if f["id"] is None else Decimal(f["id"])
                    f["parts"] = [[{"x": p[0], "y": p[1]} for p in part] for part in f["parts"]]
                    f["props"] = {k: json.dumps(v) for k, v in f["props"].items()}
                    rows.append({"z": t.z, "x": t.x, "y": t.y, **f})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("z", "x", "y", "layer", "extent", "feature_seq", "id", "geom_type", "parts", "props")])

    return tiles.select("z", "x", "y", "data").mapInPandas(run, SCHEMA)
