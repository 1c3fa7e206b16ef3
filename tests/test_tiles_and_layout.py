import math
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartolex.functions import geo
from cartolex.operators import layout
from cartolex.sources import mvt, pmtiles
from cartolex.sources.varint import Malformed
from cartolex.streaming.supply import next_state


def put(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(no, b):
    return put(no << 3 | 2) + put(len(b)) + b


def tile():
    point = put(1 << 3 | 1) + put(50) + put(34)
    feature = put(1 << 3) + put(7) + field(2, put(0) + put(0)) + put(3 << 3) + put(1) + field(4, point)
    layer = field(1, b"roads") + field(2, feature) + field(3, b"class") + field(4, field(1, b"street")) + put(5 << 3) + put(4096)
    return field(3, layer)


def test_mvt():
    (f,) = mvt.decode(tile())
    assert f == {"layer": "roads", "extent": 4096, "feature_seq": 0, "id": 7, "geom_type": "point", "parts": [[(25, 17)]], "props": {"class": "street"}}


def test_mvt_truncation():
    b = tile()
    for n in range(len(b)):
        try:
            mvt.decode(b[:n])
        except (Malformed, UnicodeDecodeError, struct.error):
            pass


def test_mvt_rows(spark):
    df = spark.createDataFrame([(1, 0, 1, bytearray(tile()))], "z int, x int, y int, data binary")
    r = mvt.decode_tiles(df).first()
    assert (r.layer, r.geom_type, r.props, r.parts[0][0].x) == ("roads", "point", {"class": '"street"'}, 25)


def test_pmtiles(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    pmtiles.write(path, {0: b"root", 1: b"sea", 2: b"sea", 7: b"land"})
    a = pmtiles.Archive(path)
    assert a.tile(a.find(2)) == b"sea" and a.find(3) is None and a.metadata() == b"{}"
    assert [e.run for e in a.root()] == [1, 2, 1]
    spark.dataSource.register(pmtiles.PMTilesSource)
    rows = spark.read.format("pmtiles").load(path).orderBy("tile_id").collect()
    assert [(r.tile_id, r.z, bytes(r.data)) for r in rows] == [(0, 0, b"root"), (1, 1, b"sea"), (2, 1, b"sea"), (7, 2, b"land")]


def test_hilbert_round_trip(spark):
    rows = spark.range(256).select((F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y"))
    for r in rows.select("x", "y", geo.hilbert_id(4, F.col("x"), F.col("y")).alias("t")).collect():
        assert pmtiles.tile_zxy(r.t) == (4, r.x, r.y)


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(10.0, 50.0), (-179.0, -80.0), (0.0, 0.0)], "lon double, lat double")
    x, y = geo.to_world(F.col("lon"), F.col("lat"))
    df = df.withColumns({"x": x, "y": y})
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat))


def test_within(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (3.0, 3.0), (5.0, 5.0)], "lon double, lat double")
    square = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (2, 3.5), (3.5, 3.5), (3.5, 2)]]
    assert [r[0] for r in df.select(geo.within(F.col("lon"), F.col("lat"), [square])).collect()] == [True, False, False, False]


def test_triangulation_keeps_area():
    ring = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1)]
    for rings in ([ring], [ring, hole]):
        want = sum(layout.area2(r) for r in rings)
        got = sum(layout.area2(list(t)) for t in layout.triangulate(rings))
        assert got == pytest.approx(want)


def test_dashes():
    assert layout.dash_runs(10, [2, 1], 1) == [(0, 2), (3, 5), (6, 8), (9, 10)]
    assert layout.dash_runs(10, [3], 1) == [(0, 3), (6, 9)]
    assert layout.dash_runs(10, [0, 5], 1) == []
    assert layout.dash_runs(10, [1, 0], 1) == [(0.0, 10)]
    assert layout.dash_runs(1e6, [1, 1], 1) == [(0.0, 1e6)]


def test_anchors():
    assert [a[0] for a in layout.anchors_along([(0, 0), (250, 0)], 100)] == [50, 150]
    assert layout.anchors_along([(0, 0), (30, 0)], 100) == [(15, 0, 0)]
    assert layout.anchors_along([(0, 0), (200, 0)], 100, extent=100) == [(50, 0, 0)]


def test_collision():
    boxes = pd.DataFrame({"label": [0, 1, 2, 3], "x0": [0, 5, 10, 5], "y0": [0, 0, 0, 0], "x1": [10, 15, 20, 15], "y1": [10] * 4, "allow": [False, False, False, True], "ignore": [False] * 4})
    assert layout.place_boxes(boxes).placed.tolist() == [True, False, True, True]


def test_stroke_and_hillshade():
    assert len(layout.stroke([(0, 0), (10, 0)], 2)) == 2
    assert abs(layout.hillshade([[5, 5], [5, 5]], 10)).max() < 1e-12
    assert layout.wrap_text("aa bb cc", lambda c: 1, 5) == ["aa bb", "cc"]
    assert math.isclose(layout.hillshade([[0, 10, 20]], 10).max(), layout.hillshade([[0, 10, 20]], 10)[0].max())


def test_supply():
    state, out = next_state(None, [(1, "not_ready"), (2, "ok"), (2, "ok")])
    assert (state, out) == (("ok", 2), [("ok", 2)])
    assert next_state(state, [(1, "failed"), (3, "not_ready")]) == (("ok", 2), [])
