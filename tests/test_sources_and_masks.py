import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.operators import masks
from geoloom.sources import readers, shapefile, tiff
from geoloom.streaming import incremental


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
@pytest.mark.parametrize("bands", [1, 3])
def test_tiff_round_trip(dtype, bands):
    rng = np.random.default_rng(1)
    data = (rng.random((bands, 130, 77)) * 200).astype(dtype)
    for deflate in (True, False):
        r = tiff.decode(tiff.encode(tiff.Raster(data, [100.0, 2.0, 0.0, 50.0, 0.0, -2.0], 26910, -9999.0), deflate))
        assert (r.data == data).all() and r.gt == [100.0, 2.0, 0.0, 50.0, 0.0, -2.0] and (r.epsg, r.nodata) == (26910, -9999.0)
    rotated = tiff.decode(tiff.encode(tiff.Raster(data, [1.0, 0.5, 0.25, 2.0, 0.125, -0.5])))
    assert rotated.gt == [1.0, 0.5, 0.25, 2.0, 0.125, -0.5] and rotated.epsg is None


def lzw(data):
    """A plain encoder of the format's LZW, to test the decoder with."""
    table, codes, s = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    n, width = 258, 9
    for b in data:
        if s + bytes([b]) in table:
            s += bytes([b])
            continue
        codes.append((table[s], width))
        table[s + bytes([b])] = n
        n += 1
        if n == 4094:
            codes.append((256, 12))
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        s = bytes([b])
    if s:
        codes.append((table[s], width))
        n += 1
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 40))
def test_lzw(part, times):
    data = part * times
    assert tiff._lzw(lzw(data)) == data


def test_rasters_through_spark(spark, tmp_path):
    rng = np.random.default_rng(2)
    px = spark.createDataFrame([(f"r{k}", 1, y, x, float(v)) for k in range(2) for (y, x), v in np.ndenumerate(rng.integers(0, 99, (40, 33)))], "raster_id string, band int, y int, x int, v double")
    out = readers.pixels_to_tiff(px, [0.0, 1.0, 0.0, 40.0, 0.0, -1.0], 26911, -9999.0)
    assert readers.save_files(out, f"file://{tmp_path}/tif").count() == 2
    (tmp_path / "tif/broken.tif").write_bytes(b"no tiff")
    heads = {r.raster_id: r for r in readers.raster_headers(spark, str(tmp_path / "tif")).collect()}
    assert (heads["r0"].width, heads["r0"].height, heads["r0"].epsg) == (33, 40, 26911) and heads["broken"].error
    tiles = readers.read_tiles(spark, str(tmp_path / "tif"), 16)
    assert tiles.filter("error is null").count() == 2 * 3 * 3
    assert tiles.filter("raster_id = 'r1' and tile_y = 1 and tile_x = 2").first().gt == [32.0, 1.0, 0.0, 24.0, 0.0, -1.0]
    back = readers.tile_pixels(tiles)
    assert back.exceptAll(px).count() == px.exceptAll(back).count() == 0
    assert {r.stem for r in readers.inventory(spark, str(tmp_path / "tif")).collect()} == {"r0", "r1", "broken"}
    sizes = {r.stem: (r.width, r.height) for r in readers.image_sizes(spark, str(tmp_path / "tif")).collect()}
    assert sizes == {"r0": (33, 40), "r1": (33, 40), "broken": (None, None)}


def test_shapefiles(spark, tmp_path):
    fields = [("fid_src", "N", 9, 0), ("name", "C", 12, 0), ("len", "N", 18, 3)]
    shapes = [[[(0.0, 0.0), (1.5, 2.0)]], None, [[(3.0, 3.0), (4.0, 4.0), (5.0, 3.0)], [(9.0, 9.0), (8.0, 8.0)]]]
    records = [{"fid_src": 7, "name": "Größe", "len": 2.5}, {"fid_src": None, "name": "", "len": None}, {"fid_src": -3, "name": "c", "len": 1e6}]
    shp, shx, dbf = shapefile.write_layer("LineString", shapes, fields, records)
    assert shapefile.read_shapes(shp) == [s and ("LineString", s) for s in shapes] and shapefile.read_fields(dbf) == fields
    for ext, b in (("shp", shp), ("shx", shx), ("dbf", dbf)):
        (tmp_path / f"lines.{ext}").write_bytes(b)
    layer = readers.read_shapefile(spark, str(tmp_path / "lines.shp"))
    rows = layer.orderBy("fid").collect()
    assert [r.fid_src for r in rows] == [7, None, -3] and rows[0].name == "Größe" and rows[1].geom is None and rows[2].len == 1e6
    assert layer.schema["len"].metadata == {"width": 18, "decimals": 3}
    again = {r.name: bytes(r.content) for r in readers.shapefile_bytes(layer, "LineString", fields, "copy").collect()}
    assert again["copy.shp"] == shp and again["copy.dbf"] == dbf


def test_polygon_masks_touch_all_pixels_of_the_border():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ring = [tuple(p) for p in rng.random((5, 2)) * 20]
        got = masks.polygon_mask([ring], 20, 20)
        inner = masks.polygon_mask([ring], 20, 20, all_touched=False)
        assert (got | inner == got).all()
        for a, b in zip(ring, ring[1:] + ring[:1]):
            for t in np.linspace(0, 1, 200):
                x, y = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
                assert got[min(int(y), 19), min(int(x), 19)]
    assert masks.polygon_mask([[(2, 2), (6, 2), (6, 5), (2, 5)]], 8, 8, all_touched=False).sum() == 12


def test_contours_and_round_trip():
    mask = np.zeros((30, 40), np.uint8)
    mask[3:10, 5:20] = 255
    mask[15:28, 22:38] = 128
    mask[20:23, 2:5] = 255  # too small
    found = masks.mask_labels(mask, {255: 0, 128: 1}, min_area=10)
    assert [c for c, _ in found] == [0, 1]
    for cls, xy in found:
        ring = [(x * 40 + 0.5, y * 30 + 0.5) for x, y in zip(xy[::2], xy[1::2])]
        assert (masks.polygon_mask([ring], 30, 40) == (mask == (255, 128)[cls]) * (masks.components8(mask == (255, 128)[cls]) == 1)).all()
    assert masks.outer_contours(np.ones((1, 1), bool)) == [[(0, 0)]]
    assert len(masks.outer_contours(np.eye(5, dtype=bool))) == 1


def test_labels_and_masks_through_spark(spark):
    tiles = spark.createDataFrame([("a", 32, 32), ("b", 32, 32)], "tile string, h int, w int")
    square = [{"x": float(x), "y": float(y)} for x, y in ((4, 4), (20, 4), (20, 20), (4, 20))]
    small = [{"x": float(x), "y": float(y)} for x, y in ((10, 10), (14, 10), (14, 14), (10, 14))]
    line = [{"x": 2.0, "y": 28.0}, {"x": 30.0, "y": 28.0}]
    feats = spark.createDataFrame([("a", 1, 255, "Polygon", [square]), ("a", 2, 128, "Polygon", [small]), ("a", 3, 128, "LineString", [line])], "tile string, seq int, value int, kind string, parts array<array<struct<x:double,y:double>>>")
    out = {r.tile: np.frombuffer(r.data, np.uint8).reshape(r.h, r.w) for r in masks.rasterize(feats, tiles, 1.5).collect()}
    assert (out["b"] == 0).all() and out["a"][6, 6] == 255 and out["a"][12, 12] == 128 and out["a"][28, 15] == 128
    labels = masks.trace(masks.rasterize(feats, tiles, 1.5), {255: 0, 128: 1}, 5)
    assert sorted(r.class_id for r in labels.collect()) == [0, 1, 1] and labels.filter("stem = 'b'").count() == 0
    again = masks.labels_to_masks(labels, tiles, {0: 255, 1: 128})
    assert {r.tile for r in again.collect()} == {"a", "b"}


def test_line_kernels():
    m = masks.line_mask([[(2.5, 5.5), (17.5, 5.5)]], 12, 20, 1.2)
    assert m[5, 2:18].all() and m[4, 2:18].all() and not m[2].any()
    lines = masks.skeleton_lines(m, 1.0)
    assert len(lines) == 1 and len(lines[0]) == 2
    assert masks.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1) == [(0, 0), (2, 0), (3, 5)]
    assert masks.ring_area(masks.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5)], 0, 0, 10, 10)) == 25


def test_stream_processes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def run():
        q = incremental.process_new(incremental.new_files(spark, str(src), "*.txt"), lambda f: f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length"), f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination(120)
        return sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (src / "a.txt").write_text("x")
    assert run() == ["a.txt"]
    (src / "b.txt").write_text("yy")
    assert run() == ["a.txt", "b.txt"]


def test_instances(spark):
    proto = np.zeros((2, 8, 8))
    proto[0], proto[1, :4] = -4.0, 9.0
    det = spark.createDataFrame([(1, 0, 0.9, 2.0, 2.0, 30.0, 30.0, [1.0, 1.0]), (2, 1, 0.8, 5.0, 5.0, 5.0, 9.0, [1.0, 1.0])], "det long, cls int, conf double, x1 double, y1 double, x2 double, y2 double, coef array<double>")
    got = masks.decode_instances(det, proto, 32, 50).collect()
    assert {r.det for r in got} == {1} and all(2 <= r.y < 17 and 2 <= r.x < 30 for r in got)
