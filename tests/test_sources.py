"""Image, sprite, glyph and GeoJSON sources; the supply stream."""

import json
import struct
import zlib

import numpy as np
import pytest

from cartolex.plans.catalog import glyph_range
from cartolex.sources import png, symbols
from cartolex.sources.varint import Malformed
from cartolex.streaming.supply import supply


def image(height=5, width=7):
    return np.random.default_rng(1).integers(0, 256, (height, width, 4), np.uint8)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def plain_filter(rows, n, how):
    """Filtered lines of (height, width * n) bytes, as the format defines them."""
    out = []
    for y, row in enumerate(rows):
        line = [how]
        for i, v in enumerate(row):
            a, b, c = int(row[i - n]) if i >= n else 0, int(rows[y - 1][i]) if y else 0, int(rows[y - 1][i - n]) if y and i >= n else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(v) - [0, a, b, (a + b) // 2, near][how]) % 256)
        out.append(bytes(line))
    return b"".join(out)


@pytest.mark.parametrize("colour, n", [(0, 1), (4, 2), (2, 3), (6, 4)])
@pytest.mark.parametrize("how", range(5))
def test_png_filters(colour, n, how):
    rgba = image()
    rows = rgba[..., :n].reshape(5, -1)
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(plain_filter(rows, n, how))) + chunk(b"IEND", b"")
    got = png.decode(data)
    want = rgba[..., :n]
    assert (got[..., :3] == (want[..., :3] if n > 2 else want[..., :1])).all()
    assert (got[..., 3] == (want[..., -1] if n in (2, 4) else 255)).all()


def test_png_prefixes_and_rubbish(spark):
    data = png.encode(image(), 2)
    assert (png.decode(data) == image()).all()
    for k in range(len(data)):
        with pytest.raises(Malformed):
            png.decode(data[:k])
    rows = spark.createDataFrame([(1, data), (2, b"no"), (3, None)], "id int, data binary")
    assert [(r.id, r.width) for r in png.decode_images(rows, ["id"]).orderBy("id").collect()] == [(1, 7), (2, None), (3, None)]


def test_glyph_prefixes():
    data = glyph_range(range(65, 70))
    assert [g[1] for g in symbols.glyphs(data)] == [65, 66, 67, 68, 69]
    for k in range(1, len(data)):
        with pytest.raises(Malformed):
            symbols.glyphs(data[:k])


def test_sprites_and_geojson(spark):
    index = json.dumps({"a": {"x": 0, "y": 0, "width": 4, "height": 4}, "b": {"x": 30, "y": 0, "width": 4, "height": 4}, "c": {"x": 1}})
    assert [r.name for r in symbols.sprite_table(spark, index, (32, 32)).collect()] == ["a"]
    rows = spark.createDataFrame([(1, json.dumps({"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]})), (2, "{"), (3, None), (4, json.dumps({"type": "Feature", "geometry": None})), (5, json.dumps({"type": "Circle"}))], "k int, t string")
    got = symbols.geojson_table(rows, ["k"], "t").collect()
    assert [(r.k, r.kind, [[tuple(p) for p in part] for part in r.parts]) for r in got] == [(1, "line", [[(0, 0), (1, 1)], [(2, 2), (3, 3)]])]


def test_supply_stream(spark, tmp_path):
    """Two batches of files: a later terminal answer replaces the first, delays leave nothing."""
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    schema = "tile long, req_id long, status string"
    stream = supply(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))

    def run():
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(target)).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    (source / "0.json").write_text("\n".join(json.dumps(dict(zip(("tile", "req_id", "status"), r, strict=True))) for r in [(1, 1, "not_ready"), (1, 2, "ok"), (2, 1, "not_ready"), (3, 5, "failed")]))
    run()
    (source / "1.json").write_text("\n".join(json.dumps(dict(zip(("tile", "req_id", "status"), r, strict=True))) for r in [(1, 1, "empty"), (1, 4, "empty"), (2, 3, "ok"), (3, 5, "ok")]))
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(target)).select("tile", "req_id", "status").collect())
    assert got == [(1, 2, "ok"), (1, 4, "empty"), (2, 3, "ok"), (3, 5, "failed")]
