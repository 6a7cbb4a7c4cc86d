"""Formats that were read wrongly, windows, logs, settings, and operators that no query reaches."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import grid
from geoloom.operators import files, labels, network, raster, vector, workflow
from geoloom.sources import logs, readers, shapefile, tiff


def test_tiff_layouts_and_windows():
    rng = np.random.default_rng(1)
    for dtype in ("uint8", "int16", "float32", "float64"):
        for bands in (1, 3, 4):
            data = (rng.random((bands, 70, 45)) * 200).astype(dtype)
            for kind in ({}, {"deflate": False}, {"lzw": True}, {"tile": 16}, {"tile": 32, "lzw": True, "big": True}, {"big": True}):
                blob = tiff.encode(tiff.Raster(data, [1.0, 2.0, 0.0, 3.0, 0.0, -2.0], 26910, -9999.0), **kind)
                assert blob[2] == (43 if kind.get("big") else 42)
                r = tiff.decode(blob)
                assert (r.data == data).all() and (r.gt, r.epsg, r.nodata) == ([1.0, 2.0, 0.0, 3.0, 0.0, -2.0], 26910, -9999.0)
                part = tiff.decode(blob, (33, 10, 20, 50))
                assert (part.data == data[:, 33:53, 10:60]).all() and part.gt == [21.0, 2.0, 0.0, -63.0, 0.0, -2.0]


def test_a_header_reads_few_bytes_and_a_window_few_blocks():
    blob = tiff.encode(tiff.Raster(np.arange(2000 * 500, dtype="float32").reshape(1, 2000, 500)), deflate=False)
    seen = []

    def read(at, size):
        seen.append(size)
        return blob[at : at + size]

    assert tiff.header(read)[:2] == (500, 2000) and sum(seen) < 64 << 10
    seen.clear()
    assert tiff.decode(read, (640, 0, 10, 10)).data[0, 0, 0] == 640 * 500
    assert sum(seen) < 64 * 500 * 4 + (64 << 10)


def predicted(rows):
    """Rows of floats as the floating-point predictor stores them."""
    out = b""
    for row in rows:
        planes = np.frombuffer(row.astype(">f4").tobytes(), np.uint8).reshape(-1, 4).T.reshape(-1)
        out += np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    return out


def test_floating_point_predictor():
    data = np.array([[1.5, 2.5, 3.5, -4.25], [0, 1e30, -1e-30, 7]], "<f4")
    assert (tiff._unpredicted(predicted(data), np.dtype("<f4"), 2, 4, 1, 3)[..., 0] == data).all()
    blob = bytearray(tiff.encode(tiff.Raster(data[None]), deflate=False))
    at = blob.index(bytes([31, 1, 3, 0])) if bytes([31, 1, 3, 0]) in blob else None  # a tag of ours, made the predictor's
    end, tags = tiff._tags(bytes(blob))
    assert at is None and tiff.PREDICTOR not in tags
    place = bytes(blob).index((tiff.PLANAR).to_bytes(2, "little") + b"\x03\x00")
    blob[place : place + 2] = tiff.PREDICTOR.to_bytes(2, "little")
    for value, fails in ((3, False), (9, True)):
        blob[place + 8] = value
        blob[tags[tiff.STRIP_AT][0] :] = predicted(data)
        if fails:
            with pytest.raises(ValueError):
                tiff.decode(bytes(blob))
        else:
            assert (tiff.decode(bytes(blob)).data[0] == data).all()


def test_windows_through_spark(spark, tmp_path):
    data = np.random.default_rng(3).integers(0, 99, (2, 150, 90)).astype("int16")
    (tmp_path / "a.tif").write_bytes(tiff.encode(tiff.Raster(data, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]), tile=32))
    (tmp_path / "b.tif").write_bytes(b"broken")
    got, want = (sorted(map(str, f(spark, str(tmp_path), 64).drop("data").collect())) for f in (readers.read_windows, readers.read_tiles))
    assert [r for r in got if "'b'" not in r] == [r for r in want if "'b'" not in r] and len(got) == len(want) == 7
    pixels = {(r.band, r.y, r.x): r.v for r in readers.tile_pixels(readers.read_windows(spark, str(tmp_path), 64)).collect()}
    assert pixels == {(b + 1, y, x): float(v) for (b, y, x), v in np.ndenumerate(data)}


def test_deleted_records_go_with_their_shapes(spark, tmp_path):
    fields = [("name", "C", 4, 0)]
    shp, shx, dbf = shapefile.write_layer("Point", [[[(float(k), 0.0)]] for k in range(4)], fields, [{"name": f"p{k}"} for k in range(4)])
    table = bytearray(dbf)
    width = 1 + 4
    table[33 + 32 + width] = ord("*")
    for e, c in (("shp", shp), ("shx", shx), ("dbf", bytes(table))):
        (tmp_path / f"l.{e}").write_bytes(c)
    rows = readers.read_shapefile(spark, str(tmp_path / "l.shp")).collect()
    assert [(r["fid"], r["name"], r["geom"].parts[0][0].x) for r in rows] == [(0, "p0", 0.0), (2, "p2", 2.0), (3, "p3", 3.0)]


def test_flattened_names_never_collide(spark):
    rows = [("a/t.tif", "t.tif"), ("b/t.tif", "t.tif"), ("c/t_1.tif", "t_1.tif"), ("d/t.tif", "t.tif"), ("d/u.tif", "u.tif"), ("e/u.tif", "u.tif"), ("f/noext", "noext"), ("g/noext", "noext")]
    out = files.flatten_plan(spark.createDataFrame(rows, "path string, name string"))
    got = {r.src: r.dst for r in out.collect()}
    assert got == {"a/t.tif": "t.tif", "b/t.tif": "t_1.tif", "c/t_1.tif": "t_1_1.tif", "d/t.tif": "t_2.tif", "d/u.tif": "u.tif", "e/u.tif": "u_1.tif", "f/noext": "noext", "g/noext": "noext_1"}


def test_names_that_collide_are_an_error(spark):
    one = spark.createDataFrame([("x_mask", "1"), ("X", "2"), ("x_buffer", "3")], "stem string, path string")
    with pytest.raises(Exception, match="names collide"):
        files.suffix_join(one, one, ["_mask", "_buffer"]).collect()


def test_logs_and_cached_descriptors(spark, tmp_path):
    rows = spark.createDataFrame([("a", "processed", None), ("b", 'x "y", z', 3)], "src string, status string, n int")
    logs.write_csv_log(rows, str(tmp_path / "csv"), ["src", "status", "error"], bom=True)
    text = sorted(p.read_text("utf-8-sig") for p in (tmp_path / "csv").glob("*.csv") if p.stat().st_size)
    assert all(t.startswith("src,status,error") for t in text) and any('"x ""y"", z"' in t for t in text)
    logs.write_json_log(rows, str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["src"])[0] == {"src": "a", "status": "processed", "n": None}
    (tmp_path / "cache").mkdir()
    for name, body in (("p1", '{"bounds": [0, 0, 0, 5, 5, 5]}'), ("p2", "{"), ("p3", "[]")):
        (tmp_path / f"cache/{name}.json").write_text(body)
    found = {r.prefix: (r.ok, r.error) for r in logs.cached_json(spark, str(tmp_path / "cache")).collect()}
    assert found == {"p1": (True, None), "p2": (False, "not a JSON object"), "p3": (False, "not a JSON object")}
    scan = vector.ept_scan(logs.cached_json(spark, str(tmp_path / "cache")), 4, 4, 9, 9)
    assert [r.prefix for r in vector.scan_matches(scan).collect()] == ["p1"]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"out": "x/y", "abs": "/a", "n": 3, "none": None}).encode())
    c = workflow.load_config(str(tmp_path / "c.json"), ("out", "abs", "none"))
    assert c == {"out": str((tmp_path / "x/y").resolve()), "abs": "/a", "n": 3, "none": None}
    assert workflow.merged({"a": None, "b": 1}, {"a": 2, "b": 3}, {"c": 4}) == {"a": 2, "b": 1, "c": 4}
    workflow.check_apart("/d/out", "/d/in", "/d/in2")
    for out in ("/d/in", "/d/in/out", "/d"):
        with pytest.raises(ValueError):
            workflow.check_apart(out, "/d/in")


def test_coco_document_is_written_by_parts(spark):
    images = spark.createDataFrame([(1, "a.png", "val"), (2, "b.png", "val")], "id long, file_name string, split string")
    notes = spark.createDataFrame([(1, 2, 1, [0.0, 0.0, 1.0, 1.0], 1.0, 0, None, "val"), (1, 9, 1, [0.0], 1.0, 0, None, "train")], "id long, image_id int, category_id int, bbox array<double>, area double, iscrowd int, segmentation array<array<double>>, split string")
    kinds = spark.createDataFrame([(1, "ridge")], "id long, name string")
    found = json.loads("".join(r.text for r in labels.coco_document(images, notes, kinds, "val").collect()))
    assert found["images"] == [{"id": 1, "file_name": "a.png"}, {"id": 2, "file_name": "b.png"}] and found["categories"] == [{"id": 1, "name": "ridge"}]
    assert found["annotations"] == [{"id": 1, "image_id": 2, "category_id": 1, "bbox": [0.0, 0.0, 1.0, 1.0], "area": 1.0, "iscrowd": 0, "segmentation": None}]
    empty = json.loads("".join(r.text for r in labels.coco_document(images, notes, kinds, "test").collect()))
    assert empty["images"] == empty["annotations"] == []


def test_reports(spark):
    stems = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "train")], "stem string, split string")
    counts = files.workflow_counts(stems, stems.limit(2), stems, stems)
    assert json.loads(files.json_report(counts).first().report) == {"tiles": 3, "rgb_images": 2, "labels": 3, "train": 2, "val": 1}


def test_utm_there_and_back(spark):
    rows = [(float(lon), float(lat)) for lon in (-123.9, -122.3, -120.1) for lat in (-60.5, -1.0, 0.5, 37.0, 61.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", grid.to_utm(F.col("lon"), F.col("lat"), F.lit(10)))
    north = grid.from_utm(F.col("p.easting"), F.col("p.northing"), F.lit(10))
    south = grid.from_utm(F.col("p.easting"), F.col("p.northing"), F.lit(10), south=True)
    for r in df.select("lon", "lat", F.when(F.col("lat") < 0, south).otherwise(north).alias("q")).collect():
        assert abs(r.q.x - r.lon) < 1e-7 and abs(r.q.y - r.lat) < 1e-7


def test_huge_and_tiny_boxes_meet_once(spark):
    boxes = [(0, 0.0, 0.0, 1e7, 1e7), (1, 5.0, 5.0, 5.5, 5.5), (2, 9e6, 9e6, 9e6 + 300, 9e6 + 1), (3, -5.0, -5.0, -1.0, -1.0), (4, 5.5, 5.5, 5.5, 5.5)]
    df = spark.createDataFrame(boxes, "k int, x1 double, y1 double, x2 double, y2 double")
    out = vector.bbox_join(df, df.withColumnRenamed("k", "j"), 2.0)
    got = sorted((r.k, r.j) for r in out.collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert got == want
    assert vector._cells(df, 2.0).count() < 1000


def random_boxes(seed, n, key, most=400.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-200, 200), rng.uniform(-200, 200), *(rng.choice([0.0, 0.5, 3.0, 40.0, most]) for _ in range(2))
        out.append((i, rng.choice([None, 1, 2]), round(x), round(y), round(x) + w, round(y) + h))
    return [(i, g, float(a), float(b), float(c), float(d)) for i, g, a, b, c, d in out], f"{key} int, g int, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("block", [2000, 3])
def test_boxes_of_mixed_sizes_meet_once_in_cells_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK", block, raising=False)
    (a, s), (b, t) = random_boxes(1, 90, "k"), random_boxes(2, 70, "j", most=1e5)
    meets = [(p, q) for p in a for q in b if p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]]
    left, right = spark.createDataFrame(a, s), spark.createDataFrame(b, t)
    assert sorted((r.k, r.j) for r in vector.bbox_join(left, right.drop("g"), 2.0).collect()) == sorted((p[0], q[0]) for p, q in meets)
    got = vector.bbox_join(left, right, 2.0, on=("g",))
    assert sorted(got.columns) == ["g", "j", "k"]
    assert sorted((r.k, r.j) for r in got.collect()) == sorted((p[0], q[0]) for p, q in meets if p[1] == q[1])
    assert vector.bbox_join(left, right.drop("g").limit(0), 2.0).count() == 0


def test_many_boxes_far_apart_are_not_paired(spark):
    """No pair of small boxes is looked at in the coarse cells that they share."""
    began = time.monotonic()
    k = F.col("id")
    a = spark.range(30_000).select(k, (k * 3.0).alias("x1"), F.lit(1.0).alias("y1"), (k * 3.0 + 1).alias("x2"), F.lit(2.0).alias("y2"))
    assert vector.bbox_join(a, a.withColumnRenamed("id", "j"), 2.0).count() == 30_000
    assert time.monotonic() - began < 60


def lines_frame(spark, rows):
    return spark.createDataFrame([(f, g, [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts]) for f, g, parts in rows], "fid long, grid_code int, parts array<array<struct<x:double,y:double>>>")


def lines_meet(p, q):
    def side(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    def meet(a, b, c, d):
        near = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
        return near and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0

    return any(meet(*s, *t) for u in p for s in zip(u, u[1:]) for v in q for t in zip(v, v[1:]))


def random_lines(seed, n, most=12):
    rng = random.Random(seed)
    out = []
    for f in range(n):
        x, y = rng.randrange(30), rng.randrange(30)
        out.append((f, rng.choice([1, 2]), [[(x + rng.randrange(-most, most), y + rng.randrange(-most, most)) for _ in range(rng.choice([1, 2, 3]))] for _ in range(rng.choice([1, 2]))]))
    return out


@pytest.mark.parametrize("block", [2000, 4])
def test_line_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK", block, raising=False)
    rows = random_lines(5, 60)
    got = sorted(map(tuple, vector.line_pairs(lines_frame(spark, rows), 5.0).collect()))
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and lines_meet(p[2], q[2]))


def test_crowded_lines_are_judged_quickly(spark):
    """4,000 parallel lines whose boxes all overlap, and one across them: its pairs only."""
    began = time.monotonic()
    k = F.col("id")

    def point(x, y):
        return F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))

    rows = spark.range(4000).select(k.alias("fid"), F.lit(1).alias("grid_code"), F.array(F.array(*[point(k / 1000 + y, y) for y in (0, 9, 18)])).alias("parts"))
    across = lines_frame(spark, [(4000, 1, [[(-5.0, 4.5), (50.0, 4.0)]]), (4001, 2, [[(-5.0, 4.5), (50.0, 4.0)]])])
    assert sorted(map(tuple, vector.line_pairs(rows.unionByName(across), 25.0).collect())) == [(f, 4000) for f in range(4000)]
    assert time.monotonic() - began < 60


def plain_choice(order, meets):
    """id, base of one greedy pass."""
    kept, base = [], {}
    for i in order:
        base[i] = next((k for k in kept if meets(i, k)), i)
        if base[i] == i:
            kept.append(i)
    return base


def test_choice_by_parts_equals_one_pass(spark, monkeypatch):
    """Few pairs at once: boxes and lines are decided part by part, with the outcome of one pass; few conflicts are made."""
    rng = random.Random(11)
    boxes = [(i, rng.choice([1, 2]), rng.choice([0.1, 0.5, 0.9, None]), x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(20, 40), y + 30) for i in range(400)]
    df = spark.createDataFrame([(i, c, s, *map(float, r)) for i, c, s, *r in boxes], "det long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")

    def overlap(i, k):
        (_, c, _, *a), (_, d, _, *b) = boxes[i], boxes[k]
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return c == d and w * h > 0.5 * ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    calls = []
    real = network.independent_set
    monkeypatch.setattr(network, "independent_set", lambda nodes, *a: calls.append(nodes.count()) or real(nodes, *a))
    base = plain_choice([b[0] for b in sorted(boxes, key=lambda b: (b[2] is None, -(b[2] or 0), b[0]))], overlap)
    assert sorted(r.det for r in vector.nms(df, 0.5, 64.0, most_pairs=1).collect()) == sorted(i for i, k in base.items() if i == k)
    assert len(calls) > 1 and sum(calls) < len(boxes) * 0.9

    calls.clear()
    lines = random_lines(7, 300)
    base = plain_choice(range(300), lambda i, k: lines[i][1] == lines[k][1] and lines_meet(lines[i][2], lines[k][2]))
    got = {r.fid: (r.members, [[(p.x, p.y) for p in part] for part in r.parts]) for r in vector.dissolve(lines_frame(spark, lines), 25.0, most_pairs=1).collect()}
    assert got == {k: (len(m), [p for i in m for p in lines[i][2]]) for k in set(base.values()) for m in [[i for i in base if base[i] == k]]}
    assert len(calls) > 1


def test_solid_render(spark):
    px = spark.createDataFrame([("r", y, x, 5.0 + x) for y in range(6) for x in range(6)], "raster_id string, y int, x int, v double")
    rows = raster.render(px, 1.0).collect()
    assert len(rows) == 36 and all(r.a == 255 and 0 <= min(r.r, r.g, r.b) for r in rows)


def test_ranked_percentiles_equal_counted_ones(spark):
    rng = np.random.default_rng(5)
    rows = [("a", int(k), 0, None if k % 7 == 0 else float(v)) for k, v in enumerate(rng.integers(0, 30, 101))] + [("b", 0, 0, None), ("b", 1, 0, None), ("c", 0, 0, 4.5)]
    px = spark.createDataFrame(rows, "raster_id string, y int, x int, v double")
    one, two = ({r.raster_id: r.p for r in raster.percentiles(px, {"p": F.col("v")}, [0.02, 0.5, 0.98], most).collect()} for most in (10**6, 0))
    assert one.keys() == two.keys() and two["b"] is None and two["c"] == [4.5] * 3
    assert np.allclose(one["a"], two["a"])


def test_labels_from_vectors_and_images_through_spark(spark, tmp_path):
    """A square and a line over two tiles; one of their label files is empty in a third; PNG out and in again."""
    point = lambda x, y: {"x": float(x), "y": float(y)}
    square = {"type": "Polygon", "parts": [[point(4, -4), point(20, -4), point(20, -20), point(4, -20)]]}
    line = {"type": "LineString", "parts": [[point(25, -10), point(45, -10)]]}
    geom = "struct<type:string,parts:array<array<struct<x:double,y:double>>>>"
    features = spark.createDataFrame([(1, square, "255"), (2, line, "128"), (3, line, "7"), (4, None, "255")], f"fid long, geom {geom}, grid_code string")
    tiles = spark.createDataFrame([(str(k), 32, 32, [32.0 * k, 1.0, 0.0, 0.0, 0.0, -1.0]) for k in range(3)], "tile string, h int, w int, gt array<double>")
    got = {r.stem: [x.split()[0] for x in r.text.split("\n") if x] for r in workflow.vector_labels(features, tiles, line_radius=2.0, cell=16.0).collect()}
    assert got == {"0": ["0", "1"], "1": ["1"], "2": []}
    px = spark.createDataFrame([("p", y, x, 10 * x, y, 7, 255) for y in range(5) for x in range(6)], "raster_id string, y int, x int, r int, g int, b int, a int")
    readers.save_files(readers.pixels_to_png(px), f"file://{tmp_path}").count()
    back = {(r.band, r.y, r.x): r.v & 255 for r in readers.image_pixels(spark, str(tmp_path)).collect()}
    assert all(back[(3, y, x)] == 10 * x and back[(2, y, x)] == y and back[(1, y, x)] == 7 for y in range(5) for x in range(6))
    with pytest.raises(Exception, match="three bands"):
        readers.composite_files(spark.createDataFrame([("r", 4, 0, 0, 0.5)], "raster_id string, band int, y int, x int, v double"), [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]).collect()


def test_tile_files(spark, tmp_path):
    data = np.arange(2 * 40 * 50, dtype="int16").reshape(2, 40, 50)
    (tmp_path / "a.tif").write_bytes(tiff.encode(tiff.Raster(data, [5.0, 1.0, 0.0, 9.0, 0.0, -1.0], 26910, -1.0)))
    files_ = {r.name: tiff.decode(bytes(r.content)) for r in readers.tile_files(readers.read_tiles(spark, str(tmp_path), 32), lzw=True, tile=16).collect()}
    assert sorted(files_) == ["a_0_0.tif", "a_0_1.tif", "a_1_0.tif", "a_1_1.tif"]
    last = files_["a_1_1.tif"]
    assert (last.data == data[:, 32:, 32:]).all() and last.gt == [37.0, 1.0, 0.0, -23.0, 0.0, -1.0] and (last.epsg, last.nodata) == (26910, -1.0)
