"""Raster operators on the pixel relation (raster_id, y, x, v): one row a pixel.

Neighbourhoods are two window passes, along rows and then along columns, so no
task ever holds more than one line of a raster; borders mirror without the edge
pixel (index -1 is 1, n is n - 2; a single line mirrors onto itself).
Statistics are one row a raster, joined back: no unbounded window over a raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NODATA = -9999.0
# Fixed value: values at or below this are taken for broken nodata.
FLOOR = -5000.0


def _v(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(v: str | Column) -> Column:
    v = _v(v)
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def valid(v: str | Column, nodata: float = NODATA, infinite: bool = False) -> Column:
    """Validity: not nodata, not NaN, and not infinite unless allowed."""
    v = _v(v)
    ok = (v != nodata) & ~F.isnan(v)
    return ok if infinite else ok & is_finite(v)


def fix_nodata(v: str | Column, nodata: float = NODATA, floor: float = FLOOR) -> Column:
    """Sentinel repair: nodata, very low values, NaN and infinities all become nodata."""
    v = _v(v)
    return F.when((v == nodata) | (v <= floor) | ~is_finite(v), F.lit(nodata)).otherwise(v)


def remap(px: DataFrame, first: float, second: float, first_to: float = 128, second_to: float = 255) -> DataFrame:
    """Two-value remap, one after the other; rasters with a result outside 0..255 are rejected whole."""
    once = F.when(F.col("v") == first, F.lit(float(first_to))).otherwise(F.col("v"))
    out = px.withColumn("v", once).withColumn("v", F.when(F.col("v") == second, F.lit(float(second_to))).otherwise(F.col("v")))
    good = out.groupBy("raster_id").agg(F.bool_and(F.col("v").between(0, 255)).alias("ok")).filter("ok").select("raster_id")
    return out.join(good, "raster_id", "left_semi").withColumn("v", F.col("v").cast("int"))


#: Values of one raster that an exact percentile may count in one task's buffer; of larger rasters they are ranked by a distributed sort.
MOST_VALUES = 20_000_000


def percentiles(px: DataFrame, values: dict[str, Column], probs: list[float], most: int | None = None) -> DataFrame:
    """raster_id and an array for each name: exact percentiles (interpolated) of the values that are not null; null without any."""
    most = MOST_VALUES if most is None else most
    largest = px.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return px.groupBy("raster_id").agg(*[F.percentile(v, F.array(*map(F.lit, probs))).alias(name) for name, v in values.items()])
    from geoloom.operators.labels import numbered
    from geoloom.session import stored

    out = px.select("raster_id").distinct()
    for name, v in values.items():
        each = px.select("raster_id", v.alias("__v")).filter("__v is not null")
        n = each.groupBy("raster_id").agg(F.count(F.lit(1)).alias("__n"))
        ranked = stored(numbered(each, "raster_id", ["__v"], "__k"), "ranks").join(F.broadcast(n), "raster_id")  # a row a raster
        at = [F.lit(q) * (F.col("__n") - 1) for q in probs]
        low = [F.max(F.when(F.col("__k") == F.floor(a) + 1, F.col("__v"))) for a in at]
        high = [F.max(F.when(F.col("__k") == F.ceil(a) + 1, F.col("__v"))) for a in at]
        part = [F.max(a - F.floor(a)) for a in at]
        found = ranked.groupBy("raster_id").agg(F.array(*[lo + (hi - lo) * p for lo, hi, p in zip(low, high, part)]).alias(name))
        out = out.join(found, "raster_id", "left")
    return out


def stats(px: DataFrame, ok: Column) -> DataFrame:
    """One row a raster: counts, range, mean, population deviation, median and 2/98 percentiles of valid pixels."""
    v = F.when(ok, F.col("v"))
    plain = px.groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_valid"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
    )
    p = percentiles(px, {"p": v}, [0.02, 0.5, 0.98])
    return plain.join(p, "raster_id").select("raster_id", "n", "n_valid", "lo", "hi", "mean", "std", F.coalesce(F.col("p")[1], F.lit(0.0)).alias("median"), F.when(F.col("p").isNotNull(), F.array(F.col("p")[0], F.col("p")[2])).alias("p"))


def zscore(px: DataFrame) -> DataFrame:
    """Deviation from the raster's mean in population deviations (0 if flat); nodata counts too."""
    s = px.groupBy("raster_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = F.when(F.col("s") == 0, F.lit(0.0)).otherwise((F.col("v") - F.col("m")) / F.col("s"))
    return px.join(s, "raster_id").select("raster_id", "y", "x", z.alias("z"))


def stretch(px: DataFrame, value: str, ok: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds ``value``_01: percentiles of valid pixels to 0 and 1, clamped; 0 where invalid."""
    v = F.when(F.col(ok), F.col(value))
    p = percentiles(px, {"p": v}, [low, high])
    lo = F.coalesce(F.col("p")[0], F.lit(0.0))
    hi = F.coalesce(F.col("p")[1], F.lit(0.0))
    hi = F.when(hi <= lo, lo + 1e-6).otherwise(hi)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - lo) / (hi - lo)))
    return px.join(p, "raster_id").withColumn(f"{value}_01", F.when(F.col(ok), scaled).otherwise(F.lit(0.0))).drop("p")


def gradients(px: DataFrame, value: str = "v") -> DataFrame:
    """Adds dx, dy (3 x 3 Sobel) and curv (3 x 3 Laplacian, corners 2, centre -8)."""
    row = Window.partitionBy("raster_id", "y").orderBy("x")
    col = Window.partitionBy("raster_id", "x").orderBy("y")
    v = F.col(value)

    def back(c: str, w):
        return F.coalesce(F.lag(c).over(w), F.lead(c).over(w), F.col(c))

    def fore(c: str, w):
        return F.coalesce(F.lead(c).over(w), F.lag(c).over(w), F.col(c))

    a = px.withColumn("__l", back(value, row)).withColumn("__g", fore(value, row))
    a = a.withColumn("__q", F.col("__g") - F.col("__l")).withColumn("__p", F.col("__l") + 2 * v + F.col("__g")).withColumn("__s", F.col("__l") + F.col("__g"))
    dx = back("__q", col) + 2 * F.col("__q") + fore("__q", col)
    dy = fore("__p", col) - back("__p", col)
    curv = 2 * (back("__s", col) + fore("__s", col)) - 8 * v
    a = a.withColumn("dx", dx).withColumn("dy", dy).withColumn("curv", curv)
    return a.drop("__l", "__g", "__q", "__p", "__s")


def topo_composite(px: DataFrame, nodata: float = NODATA) -> DataFrame:
    """dx, dy and curvature of the hole-filled surface, each stretched to 0..1; 0 where invalid."""
    ok = px.withColumn("ok", valid("v", nodata))
    fill = percentiles(ok, {"p": F.when(F.col("ok"), F.col("v"))}, [0.5]).select("raster_id", F.coalesce(F.col("p")[0], F.lit(0.0)).alias("fill"))
    filled = ok.join(fill, "raster_id").withColumn("f", F.when(F.col("ok"), F.col("v")).otherwise(F.col("fill"))).drop("fill")
    out = gradients(filled, "f")
    out = out.join(percentiles(out, {f"p{k}": F.when(F.col("ok"), F.col(c)) for k, c in enumerate(("dx", "dy", "curv"))}, [0.02, 0.98]), "raster_id")
    bands = []
    for k, (c, name) in enumerate(zip(("dx", "dy", "curv"), ("b1", "b2", "b3"))):
        lo = F.coalesce(F.col(f"p{k}")[0], F.lit(0.0))
        hi = F.coalesce(F.col(f"p{k}")[1], F.lit(0.0))
        hi = F.when(hi <= lo, lo + 1e-6).otherwise(hi)
        bands.append(F.when(F.col("ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / (hi - lo)))).otherwise(F.lit(0.0)).alias(name))
    return out.select("raster_id", "y", "x", *bands)


def hillshade(px: DataFrame, cell: float, azimuth: float = -45, altitude: float = 45, z: float = 1, nodata: float = NODATA) -> DataFrame:
    """Adds shade, 0..1; gradients run through raw nodata values, invalid pixels get 0."""
    out = gradients(px)
    gx, gy = F.col("dx") / (8 * cell), F.col("dy") / (8 * cell)
    slope = F.atan(z * F.sqrt(gx * gx + gy * gy))
    aspect = F.atan2(gy, -gx)
    aspect = F.when(aspect < 0, aspect + F.lit(2.0) * F.pi()).otherwise(aspect)
    az = F.radians(F.lit((360.0 - azimuth + 90.0) if (360.0 - azimuth + 90.0) <= 360 else (360.0 - azimuth + 90.0) - 360.0))
    zenith = F.radians(F.lit(90.0 - altitude))
    shade = F.cos(zenith) * F.cos(slope) + F.sin(zenith) * F.sin(slope) * F.cos(az - aspect)
    shade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade))
    return out.withColumn("shade", F.when(valid("v", nodata, infinite=True), shade).otherwise(F.lit(0.0))).drop("curv")


def terrain_stack(px: DataFrame, res: float, azimuth: float = 315, altitude: float = 45) -> DataFrame:
    """z-score elevation, min-max slope and hillshade / 255 of each pixel.

    Border pixels have no slope or shade (nodata -9999 and 0), and the range of
    the slope takes them in.
    """
    g = gradients(px)
    row, col = Window.partitionBy("raster_id", "y").orderBy("x"), Window.partitionBy("raster_id", "x").orderBy("y")
    inner = F.lag("v").over(row).isNotNull() & F.lead("v").over(row).isNotNull() & F.lag("v").over(col).isNotNull() & F.lead("v").over(col).isNotNull()
    gx, gy = -F.col("dx") / (8 * res), F.col("dy") / (8 * res)
    steep = gx * gx + gy * gy
    az, alt = F.radians(F.lit(float(azimuth))), F.radians(F.lit(float(altitude)))
    cang = (F.sin(alt) - F.cos(alt) * F.sqrt(steep) * F.sin(F.atan2(gy, gx) - az)) / F.sqrt(1 + steep)
    g = g.withColumn("__in", inner)
    g = g.withColumn("slope", F.when(F.col("__in"), F.degrees(F.atan(F.sqrt(steep)))).otherwise(F.lit(NODATA)))
    g = g.withColumn("shade", F.when(F.col("__in"), F.when(cang <= 0, F.lit(1.0)).otherwise(1 + 254 * cang)).otherwise(F.lit(0.0)) / 255)
    s = g.groupBy("raster_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("slope").alias("lo"), F.max("slope").alias("hi"))
    g = g.join(s, "raster_id")
    z = F.when(F.col("s") == 0, F.lit(0.0)).otherwise((F.col("v") - F.col("m")) / F.col("s"))
    s01 = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("slope") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return g.select("raster_id", "y", "x", z.alias("b1"), s01.alias("b2"), F.col("shade").alias("b3"))


def _sweep(px: DataFrame, value: str, radius: int, f) -> DataFrame:
    """Running minimum or maximum over a square, one direction at a time; what lies outside is ignored."""
    for keys, order in ((("raster_id", "y"), "x"), (("raster_id", "x"), "y")):
        px = px.withColumn(value, f(value).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(-radius, radius)))
    return px


def erode3(px: DataFrame, mask: str) -> DataFrame:
    """3 x 3 erosion of a 0/1 mask; the image's border does not erode."""
    return _sweep(px, mask, 1, F.min)


def close5(px: DataFrame, mask: str) -> DataFrame:
    """5 x 5 closing: dilation, then erosion."""
    return _sweep(_sweep(px, mask, 2, F.max), mask, 2, F.min)


def widen(px: DataFrame, mask: str, width: float = 2.5) -> DataFrame:
    """Pixels within width / 2 of a set pixel; a width of 1 or less changes nothing."""
    r2, k = (width / 2) ** 2, int(width // 2)
    near = [(dy, dx) for dy in range(-k, k + 1) for dx in range(-k, k + 1) if dy * dy + dx * dx <= r2] if width > 1 else [(0, 0)]
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in near])
    hits = px.filter(F.col(mask) > 0).select("raster_id", "y", "x", F.explode(steps).alias("s"))
    hits = hits.select("raster_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct().withColumn("__hit", F.lit(1))
    return px.join(hits, ["raster_id", "y", "x"], "left").withColumn(mask, F.coalesce("__hit", F.lit(0))).drop("__hit")


def skip_nodata_tiles(px: DataFrame, size: int, nodata: float = NODATA) -> DataFrame:
    """Tiles (ty, tx) that are not nodata throughout (1e-8), with their pixel counts."""
    tiles = px.groupBy("raster_id", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    out = tiles.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(F.col("v") - nodata) <= 1e-8).alias("void"))
    return out.filter("not void").drop("void")


def resample_bilinear(px: DataFrame, factor: float) -> DataFrame:
    """Bilinear resampling to pixels ``factor`` times as large; centres outside clamp to the border."""
    size = px.groupBy("raster_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    grid = size.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / factor).cast("int") - 1)).alias("oy"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / factor).cast("int") - 1)).alias("ox"))
    sy = F.greatest(F.lit(0.0), F.least((F.col("oy") + 0.5) * factor - 0.5, F.col("h") - F.lit(1.0)))
    sx = F.greatest(F.lit(0.0), F.least((F.col("ox") + 0.5) * factor - 0.5, F.col("w") - F.lit(1.0)))
    grid = grid.withColumn("sy", sy).withColumn("sx", sx).withColumn("fy", F.floor("sy")).withColumn("fx", F.floor("sx"))
    corners = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)])
    taps = grid.select("*", F.explode(corners).alias("c"))
    ty, tx = F.col("sy") - F.col("fy"), F.col("sx") - F.col("fx")
    weight = F.when(F.col("c.dy") == 1, ty).otherwise(1 - ty) * F.when(F.col("c.dx") == 1, tx).otherwise(1 - tx)
    taps = taps.withColumn("wt", weight).withColumn("y", F.least(F.col("fy") + F.col("c.dy"), F.col("h") - 1)).withColumn("x", F.least(F.col("fx") + F.col("c.dx"), F.col("w") - 1))
    out = taps.join(px, ["raster_id", "y", "x"]).groupBy("raster_id", "oy", "ox").agg(F.sum(F.col("wt") * F.col("v")).alias("v"))
    return out.select("raster_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def regrid_nearest(px: DataFrame, grid: DataFrame, scale: float, background: float = 0) -> DataFrame:
    """Value of the source pixel under each centre of grid (raster_id, y, x), whose pixels are ``scale`` source pixels."""
    at = grid.select("raster_id", "y", "x", F.floor((F.col("y") + 0.5) * scale).alias("sy"), F.floor((F.col("x") + 0.5) * scale).alias("sx"))
    src = px.select("raster_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return at.join(src, ["raster_id", "sy", "sx"], "left").select("raster_id", "y", "x", F.coalesce("v", F.lit(float(background))).alias("v"))


def points_to_grid(points: DataFrame, res: float) -> DataFrame:
    """Highest z of the points of each cell."""
    return points.groupBy(F.floor(F.col("py") / res).alias("y"), F.floor(F.col("px") / res).alias("x")).agg(F.max("z").alias("z"), F.count(F.lit(1)).alias("n"))


def fill_grid(cells: DataFrame, height: int, width: int, nodata: float = NODATA) -> DataFrame:
    """Every pixel of a template grid: the cell's z, or nodata."""
    spark = cells.sparkSession
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    return grid.join(cells, ["y", "x"], "left").select("y", "x", F.coalesce("z", F.lit(nodata)).alias("z"))


def normalise_bands(px: DataFrame, channels: int = 3, clip: bool = True, nodata: float = NODATA) -> DataFrame:
    """Pixels of bands 1 to ``channels`` of (raster_id, band, y, x, v): invalid ones are 0.

    One band is repeated for three channels, further bands are cut off, missing
    ones are zeros; values are clipped to 0..1 if asked.
    """
    v = F.when(valid("v", nodata), F.col("v")).otherwise(F.lit(0.0))
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) if clip else v
    n = px.groupBy("raster_id").agg(F.max("band").alias("__n"))
    at = px.withColumn("v", v).join(n, "raster_id")
    single = (F.col("__n") == 1) & F.lit(channels == 3)
    copies = F.when(single, F.sequence(F.lit(1), F.lit(channels))).when(F.col("band") == 1, F.concat(F.array(F.lit(1)), F.filter(F.sequence(F.lit(1), F.lit(channels)), lambda b: b > F.col("__n")))).otherwise(F.array(F.col("band").cast("int")))
    out = at.select("raster_id", "y", "x", "__n", F.col("band").alias("__b"), "v", F.explode(copies).alias("band"), single.alias("__s"))
    padded = F.when(F.col("__s") | (F.col("band") == F.col("__b")), F.col("v")).otherwise(F.lit(0.0))
    return out.filter(F.col("band") <= channels).select("raster_id", "band", "y", "x", padded.alias("v"))


def solid_images(px: DataFrame, least: float = 1.0) -> DataFrame:
    """raster_id, std of images whose deviation over all channels is below ``least``."""
    return px.groupBy("raster_id").agg(F.stddev_pop("v").alias("std")).filter(F.col("std") < least)


def repaired_stats(px: DataFrame) -> DataFrame:
    """Statistics that a raster should carry once its nodata is repaired."""
    return stats(px.withColumn("v", fix_nodata("v")), F.col("v") != NODATA)


def invert(v: str | Column) -> Column:
    """Inverted 8-bit value."""
    return F.lit(255) - _v(v)


def carried_nodata(nodata: Column) -> Column:
    """The nodata value that an 8-bit copy keeps: one from 0 to 255, else none."""
    return F.when(nodata.between(0, 255), nodata)


def slope(px: DataFrame, res: float) -> DataFrame:
    """raster_id, y, x, slope in degrees (3 x 3 gradients)."""
    g = gradients(px)
    steep = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (8 * res)
    return g.select("raster_id", "y", "x", F.degrees(F.atan(steep)).alias("slope"))


def class_histogram(px: DataFrame, value: Column, confidence: Column | None = None) -> DataFrame:
    """raster_id, bin, n (and mean confidence) of each value of a raster."""
    extra = [] if confidence is None else [F.avg(confidence).alias("mean")]
    return px.groupBy("raster_id", value.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *extra)


def band_mean(px: DataFrame) -> DataFrame:
    """One band of several (raster_id, band, y, x, v): their mean at each pixel."""
    return px.groupBy("raster_id", "y", "x").agg(F.avg("v").alias("v"))


def aligned_grid(headers: DataFrame, xres: float, yres: float) -> DataFrame:
    """raster_id, gt, w, h of the grid whose pixels are multiples of the resolution and that covers each raster (raster_id, gt, w, h)."""
    gt = F.col("gt")
    x2, y2 = gt[0] + F.col("w") * gt[1], gt[3] + F.col("h") * gt[5]
    left, right = F.floor(F.least(gt[0], x2) / xres) * xres, F.ceil(F.greatest(gt[0], x2) / xres) * xres
    low, top = F.floor(F.least(gt[3], y2) / yres) * yres, F.ceil(F.greatest(gt[3], y2) / yres) * yres
    out = F.array(left.cast("double"), F.lit(float(xres)), F.lit(0.0), top.cast("double"), F.lit(0.0), F.lit(-float(yres)))
    return headers.select("raster_id", out.alias("gt"), F.round((right - left) / xres).cast("int").alias("w"), F.round((top - low) / yres).cast("int").alias("h"))


def warp(px: DataFrame, src: DataFrame, dst: DataFrame, bilinear: bool = True, nodata: float = NODATA, background: float | None = None, to_source=None, tile: str | None = None) -> DataFrame:
    """raster_id, y, x, v of rasters on other grids: src and dst hold raster_id, gt, w, h (north up, no rotation); dst may hold more columns.

    Every pixel of a target grid is made, its centre taken to the source's
    coordinates (``to_source(gx, gy)`` gives a struct of x, y; equal systems if
    None), and joined with the source pixels there: the one under it, or the
    four around it, weighted; invalid ones leave their weight to the others.
    What lies outside the source, or on invalid pixels, is ``background`` (nodata).
    Several targets of one raster are told apart by the column ``tile`` of dst.
    """
    background = nodata if background is None else background
    keys = ["raster_id", *([tile] if tile else []), "y", "x"]
    grid = dst.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    gx, gy = F.col("gt")[0] + (F.col("x") + 0.5) * F.col("gt")[1], F.col("gt")[3] + (F.col("y") + 0.5) * F.col("gt")[5]
    grid = grid.withColumn("__g", F.struct(gx.alias("x"), gy.alias("y")) if to_source is None else to_source(gx, gy)).drop("gt", "w", "h")
    head = src.select("raster_id", F.col("gt").alias("__gt"), F.col("w").alias("__w"), F.col("h").alias("__h"))
    grid = grid.join(head, "raster_id")
    grid = grid.withColumn("__u", (F.col("__g.x") - F.col("__gt")[0]) / F.col("__gt")[1]).withColumn("__v", (F.col("__g.y") - F.col("__gt")[3]) / F.col("__gt")[5])
    inside = (F.col("__u") >= 0) & (F.col("__u") < F.col("__w")) & (F.col("__v") >= 0) & (F.col("__v") < F.col("__h"))
    at = grid.filter(inside).select(*keys, "__u", "__v", "__w", "__h")
    if bilinear:
        at = at.withColumn("__u", F.col("__u") - 0.5).withColumn("__v", F.col("__v") - 0.5)
        corners = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)])
        at = at.select("*", F.explode(corners).alias("c"))
        tu, tv = F.col("__u") - F.floor("__u"), F.col("__v") - F.floor("__v")
        weight = F.when(F.col("c.dy") == 1, tv).otherwise(1 - tv) * F.when(F.col("c.dx") == 1, tu).otherwise(1 - tu)
        at = at.select(*keys, weight.alias("__wt"), F.greatest(F.lit(0), F.least(F.floor("__v") + F.col("c.dy"), F.col("__h") - 1)).cast("int").alias("__sy"), F.greatest(F.lit(0), F.least(F.floor("__u") + F.col("c.dx"), F.col("__w") - 1)).cast("int").alias("__sx"))
    else:
        at = at.select(*keys, F.lit(1.0).alias("__wt"), F.floor("__v").cast("int").alias("__sy"), F.floor("__u").cast("int").alias("__sx"))
    taps = at.join(px.select("raster_id", F.col("y").cast("int").alias("__sy"), F.col("x").cast("int").alias("__sx"), "v"), ["raster_id", "__sy", "__sx"])
    taps = taps.filter(valid("v", nodata) & (F.col("__wt") > 0))
    found = taps.groupBy(*keys).agg((F.sum(F.col("__wt") * F.col("v")) / F.sum("__wt")).alias("v"))
    return grid.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("v", F.lit(float(background))).alias("v"))


def render(px: DataFrame, cell: float, palette: str = "linsar", azimuth: float = -45, altitude: float = 45, z: float = 1, boost: float = 1.0, lo: float | None = None, hi: float | None = None, nodata: float = NODATA) -> DataFrame:
    """raster_id, y, x, r, g, b, a (0..255) of elevations: validity eroded by a pixel, palette, hillshade, Lab blend; invalid pixels are clear."""
    from geoloom.functions import color

    ok = erode3(px.withColumn("__ok", valid("v", nodata, infinite=True).cast("int")), "__ok")
    v = F.when(F.col("__ok") == 1, F.col("v"))
    ends = ok.groupBy("raster_id").agg((F.min(v) if lo is None else F.lit(float(lo))).alias("__lo"), (F.max(v) if hi is None else F.lit(float(hi))).alias("__hi"))
    shaded = hillshade(ok, cell, azimuth, altitude, z, nodata).join(ends, "raster_id")
    on = F.col("__ok") == 1
    rgb = color.elevation_color(F.col("v"), on, F.col("__lo"), F.col("__hi"), palette)
    shaded = shaded.select("raster_id", "y", "x", "__ok", *[c.alias(n) for c, n in zip(rgb, "rgb")], F.when(on, F.col("shade")).otherwise(F.lit(0.0)).alias("__s"))
    out = color.blended(shaded, ("r", "g", "b"), "__s", boost)
    bands = [F.when(on, color.to_bytes(F.col(n))).otherwise(F.lit(0)).alias(n) for n in "rgb"]
    return out.select("raster_id", "y", "x", *bands, F.when(on, F.lit(255)).otherwise(F.lit(0)).alias("a"))
