import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import color, grid, text
from geoloom.operators import files, labels, raster, vector, workflow


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_grids(spark):
    r = one(spark, a=grid.tile_offsets(F.lit(2500), 1024), b=grid.tile_offsets(F.lit(2500), 1024, 24), c=grid.window_starts(F.lit(2500), 1024, 1000), d=grid.window_starts(F.lit(2048), 1024, 1024), e=grid.window_starts(F.lit(500), 1024, 100), f=grid.tile_offsets(F.lit(20), 1024, 24))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ([0, 1024, 1476], [0, 1000, 1476], [0, 1000, 1476], [0, 1024], [0], [])


def test_zones_and_meridians(spark):
    r = one(spark, a=grid.utm_epsg(F.lit(-122.3)), b=grid.utm_epsg(F.lit(180.0)), p=grid.to_utm(F.lit(-123.0), F.lit(45.0), F.lit(10)), q=grid.to_utm(F.lit(-120.0), F.lit(0.0), F.lit(10)))
    assert (r.a, r.b) == (26910, None)
    assert abs(r.p.easting - 500000) < 1e-6 and abs(r.p.northing - 0.9996 * 4984944.378) < 0.01
    assert abs(r.q.northing) < 1e-6 and 833_000 < r.q.easting < 834_500


def test_stencils_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.random((9, 7))
    px = spark.createDataFrame([(0, y, x, float(v[y, x])) for y in range(9) for x in range(7)] + [(1, 0, x, float(x)) for x in range(3)], "raster_id int, y int, x int, v double")
    p = np.pad(v, 1, mode="reflect")

    def conv(k):
        return sum(k[a][b] * p[a : a + 9, b : b + 7] for a in range(3) for b in range(3))

    sx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = conv(sx), conv(sx.T), conv(np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]]))
    for r in raster.gradients(px).filter("raster_id = 0").collect():
        assert np.allclose([r.dx, r.dy, r.curv], [w[r.y, r.x] for w in want])
    lone = {r.x: (r.dx, r.dy) for r in raster.gradients(px).filter("raster_id = 1").collect()}
    assert lone == {0: (0.0, 0.0), 1: (8.0, 0.0), 2: (0.0, 0.0)}


def test_remap_is_sequential_and_rejects(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (1, 0, 0, 1.0), (1, 0, 1, 900.0)], "raster_id int, y int, x int, v double")
    assert sorted((r.raster_id, r.x, r.v) for r in raster.remap(px, 1, 2, 2, 255).collect()) == [(0, 0, 255), (0, 1, 255)]


def test_blend_keeps_colour_without_shade(spark):
    r = one(spark, **dict(zip("rgb", color.lab_blend(F.lit(0.2), F.lit(0.5), F.lit(0.9), F.lit(1.0)))))
    assert np.allclose([r.r, r.g, r.b], [0.2, 0.5, 0.9], atol=2e-3)
    dark = one(spark, **dict(zip("rgb", color.lab_blend(F.lit(0.2), F.lit(0.5), F.lit(0.9), F.lit(0.0)))))
    assert dark.r < 0.05 and dark.g < 0.05
    assert color.palette("unknown") == color.palette("linsar") and len(color.palette("dem")) == 11


def test_text(spark):
    html = '<meta property="og:image" content="m.png"><img class="x" data-src="a.png" src="b.png"><IMG src=\'c.jpg\'><img data-original="d.gif" src="">'
    r = one(spark, i=text.page_images(F.lit(html)), u=text.absolute_url(F.lit("//h/x")), v=text.joined_url(F.lit("https://h.org/a/b.html?q=1"), F.lit("c.png")), w=text.joined_url(F.lit("https://h.org/a/b.html"), F.lit("/c.png")), x=text.joined_url(F.lit("https://h.org"), F.lit("c.png")), n=text.download_name("p", F.lit(3), F.lit("http://x/y.PNG?z")))
    assert r.i == ["a.png", "c.jpg", "d.gif", "m.png"]
    assert (r.u, r.v, r.w, r.x, r.n) == ("https://h/x", "https://h.org/a/c.png", "https://h.org/c.png", "https://h.org/c.png", "p_0003.png")


def test_bins_and_quotas(spark):
    assert labels.bin_quotas([3, 3, 4], 2) == [0, 1, 1]
    s = spark.createDataFrame([(f"s{k}", k // 2) for k in range(10)], "stem string, density int")
    sizes = {r.bin: r["count"] for r in labels.density_bins(s, 3).groupBy("bin").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 4}
    split = labels.stratified_split(s, 3, 0.3).collect()
    assert sum(r.split == "val" for r in split) == 3
    ranked = labels.global_rank(s.repartition(5), ["density", "stem"]).collect()
    assert [r.stem for r in sorted(ranked, key=lambda r: r["rank"])] == [f"s{k}" for k in range(10)] and sorted(r["rank"] for r in ranked) == list(range(1, 11))


def test_label_lines(spark):
    rows = ["0 .1 .1 .2 .2 .3 .3", "0 .1 .1 .2 .2", "0 .1 .1 .2 .2 .3", "x .1 .1 .2 .2 .3 .3", "0.5 .1 .1 .2 .2 .3 1.3", "", "0 NaN .1 .2 .2"]
    df = spark.createDataFrame([("s", k, r) for k, r in enumerate(rows)], "stem string, line_no int, line string")
    assert {r.line_no: r.issue for r in labels.issues_boxes(df).collect()} == {3: "not_numeric", 4: "out_of_range"}
    got = sorted((r.line_no, r.issue) for r in labels.issues_polygons(df).collect())
    assert got == [(1, "bad_shape"), (2, "bad_shape"), (3, "not_numeric"), (4, "class_not_integer"), (4, "out_of_range"), (6, "bad_shape")]
    assert sorted(r.line_no for r in labels.parse_labels(df, polygons_only=True).collect()) == [0, 4]


def test_files(spark):
    r = one(spark, s=files.strip_suffixes(F.lit("area_a_mask_Cleaned"), ["_buffer", "_cleaned", "_mask"]))
    assert r.s == "area_a"
    a = spark.createDataFrame([("a",), ("b",)], "stem string")
    with pytest.raises(Exception, match="no match for b"):
        files.require_match(a, a.filter("stem = 'a'")).collect()
    stem, ext = files.split_name(F.lit("x.SHP.xml"))
    assert tuple(one(spark, a=stem, b=ext)) == ("x", "shp.xml")


def test_boxes_and_fields(spark):
    assert [vector.is_diagnostic(c) for c in ("LP_X", "len_m", "LEN_M_3", "rm_code_1", "loop_rm", "len_mm", "grid_code")] == [True, True, True, True, True, False, False]
    a = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 30.0, 30.0, 31.0, 31.0)], "i int, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame([(7, 10.0, 10.0, 50.0, 50.0), (8, 10.1, 0.0, 12.0, 5.0)], "j int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, vector.bbox_join(a, b, 4.0).collect())) == [(1, 7), (2, 7)]


def test_configs(spark):
    for bad in ({"annotation_type": "csv"}, {"val_ratio": 1.0}, {"overlap": 1024}):
        with pytest.raises(ValueError):
            workflow.DatasetConfig(**bad)
    edges = spark.createDataFrame([(1, 1, 2, 1.0)], "fid long, u long, v long, len double")
    with pytest.raises(ValueError, match="metres"):
        workflow.clean_network(edges, 0.0174)
    with pytest.raises(ValueError, match="missing"):
        workflow.clean_network(edges.drop("len"))


def test_one_band_is_repeated_and_further_ones_are_cut(spark):
    px = spark.createDataFrame([(0, 1, 0, 0, 0.5), (1, 1, 0, 0, -9999.0), (1, 2, 0, 0, 2.0)] + [(2, b, 0, 0, b / 10) for b in range(1, 6)], "raster_id int, band int, y int, x int, v double")
    got = sorted((r.raster_id, r.band, r.v) for r in raster.normalise_bands(px).collect())
    assert got == [(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.5), (1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.0), (2, 1, 0.1), (2, 2, 0.2), (2, 3, 0.3)]
