"""Column builders for grids, affine transforms and coordinate systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0


def tile_offsets(dim: Column, size: int, overlap: int = 0) -> Column:
    """Offsets of the tiles of one axis; the last tile is moved back to end at the border."""
    step = size - overlap if overlap < size else 1
    n = F.ceil((dim - overlap) / F.lit(float(step))).cast("int")
    last = F.greatest(F.lit(0), dim - size)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.when(k == n - 1, last).otherwise(k * step))).otherwise(F.array().cast("array<int>"))


def window_starts(dim: Column, size: int, stride: int) -> Column:
    """Starts of sliding windows that cover an axis; one window if it is short."""
    body = F.sequence(F.lit(0), F.greatest(dim - size, F.lit(0)), F.lit(stride))
    return F.when(dim <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(body, F.array(dim - size))))


def tile_transform(gt: Column, x: Column, y: Column) -> Column:
    """Six-number transform of the window at pixel (x, y)."""
    return F.array(gt[0] + x * gt[1] + y * gt[2], gt[1], gt[2], gt[3] + x * gt[4] + y * gt[5], gt[4], gt[5])


def pixel_to_geo(gt: Column, x: Column, y: Column) -> Column:
    return F.struct((gt[0] + x * gt[1] + y * gt[2]).alias("gx"), (gt[3] + x * gt[4] + y * gt[5]).alias("gy"))


def geo_to_pixel(gt: Column, gx: Column, gy: Column) -> Column:
    """Inverse affine; null where the transform is singular."""
    det = F.nullif(gt[1] * gt[5] - gt[2] * gt[4], F.lit(0.0))
    dx, dy = gx - gt[0], gy - gt[3]
    return F.struct(((gt[5] * dx - gt[2] * dy) / det).alias("x"), ((gt[1] * dy - gt[4] * dx) / det).alias("y"))


def geo_extent(gt: Column, w: Column, h: Column) -> Column:
    """Corner origins of the first and last pixel (not the outer edges), ordered."""
    a, b = pixel_to_geo(gt, F.lit(0), F.lit(0)), pixel_to_geo(gt, w - 1, h - 1)
    return F.struct(F.least(a["gx"], b["gx"]).alias("xmin"), F.least(a["gy"], b["gy"]).alias("ymin"), F.greatest(a["gx"], b["gx"]).alias("xmax"), F.greatest(a["gy"], b["gy"]).alias("ymax"))


def utm_epsg(lon: Column) -> Column:
    """NAD83 / UTM code of a longitude; null outside zones 1 to 60."""
    zone = F.floor((lon + 180) / 6) + 1
    return F.when((zone >= 1) & (zone <= 60), zone + 26900)


def mercator(lon: Column, lat: Column) -> Column:
    """Spherical Web Mercator of degrees."""
    return F.struct((F.radians(lon) * RADIUS).alias("mx"), (F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * RADIUS).alias("my"))


def bbox_mercator(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Box of the four projected corners."""
    a, b = mercator(xmin, ymin), mercator(xmax, ymax)
    return F.struct(F.least(a["mx"], b["mx"]).alias("mxmin"), F.least(a["my"], b["my"]).alias("mymin"), F.greatest(a["mx"], b["mx"]).alias("mxmax"), F.greatest(a["my"], b["my"]).alias("mymax"))


def bbox_meets(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Closed boxes (xmin, ymin, xmax, ymax) that touch or overlap."""
    return (F.col(a[0]) <= F.col(b[2])) & (F.col(b[0]) <= F.col(a[2])) & (F.col(a[1]) <= F.col(b[3])) & (F.col(b[1]) <= F.col(a[3]))


def epsg_of_wkt(wkt: Column) -> Column:
    """Code of the outermost authority; else of the last one named; null without any."""
    outer = F.nullif(F.regexp_extract(wkt, r'AUTHORITY\["EPSG","(\d+)"\]\]$', 1), F.lit(""))
    some = F.nullif(F.regexp_extract(wkt, r'(?s).*AUTHORITY\["EPSG","(\d+)"\]', 1), F.lit(""))
    return F.coalesce(outer, some).cast("int")


def raster_info(gt: Column, w: Column, h: Column) -> Column:
    """Extent (outer edges, ordered) and absolute resolution."""
    x2, y2 = gt[0] + w * gt[1], gt[3] + h * gt[5]
    return F.struct(F.least(gt[0], x2).alias("xmin"), F.least(gt[3], y2).alias("ymin"), F.greatest(gt[0], x2).alias("xmax"), F.greatest(gt[3], y2).alias("ymax"), F.abs(gt[1]).alias("xres"), F.abs(gt[5]).alias("yres"))


def utm_inverse_series() -> tuple[float, float, float]:
    """First three Krueger coefficients of the GRS80 ellipsoid, from its flattening."""
    n = (1 / 298.257222101) / (2 - 1 / 298.257222101)
    return n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """Transverse Mercator (Krueger series) of degrees in a zone; NAD83 is taken for WGS84."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, alpha in enumerate(utm_inverse_series(), 1):
        x = x + alpha * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + alpha * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((500000 + 0.9996 * a * x).alias("easting"), (F.when(lat < 0, F.lit(1e7)).otherwise(F.lit(0.0)) + 0.9996 * a * y).alias("northing"))


def mapper_json(gt: Column, projection: Column, w: Column, h: Column) -> Column:
    """Coordinate mapper of an image as JSON."""
    return F.to_json(F.struct(gt.alias("geotransform"), projection.alias("projection"), F.array(h, w).alias("image_shape"), geo_extent(gt, w, h).alias("geo_extent")))


def from_utm(easting: Column, northing: Column, zone: Column, south: bool = False) -> Column:
    """Degrees (x: longitude, y: latitude) of a point in a zone: the inverse of ``to_utm``, by the inverse series and a fixed number of steps."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    xi, eta = (northing - (1e7 if south else 0.0)) / (0.9996 * a), (easting - 500000) / (0.9996 * a)
    x, y = xi, eta
    for k, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    t = F.sin(x) / F.sqrt(F.sinh(y) * F.sinh(y) + F.cos(x) * F.cos(x))  # tangent of the conformal latitude
    psi = F.asinh(t)
    phi = F.asin(F.tanh(psi))
    for _ in range(4):  # each step gains more than two digits
        phi = F.asin(F.tanh(psi + e * F.atanh(e * F.sin(phi))))
    lon = F.atan2(F.sinh(y), F.cos(x))
    return F.struct((F.degrees(lon) + zone * 6 - 183).alias("x"), F.degrees(phi).alias("y"))


def geo_box(gt: Column, box: Column) -> Column:
    """Map box (xmin, ymin, xmax, ymax, ordered) of a pixel box of four numbers (column, row, column, row); null for other arrays."""
    a, b = pixel_to_geo(gt, F.get(box, F.lit(0)), F.get(box, F.lit(1))), pixel_to_geo(gt, F.get(box, F.lit(2)), F.get(box, F.lit(3)))
    out = F.struct(F.least(a["gx"], b["gx"]).alias("xmin"), F.least(a["gy"], b["gy"]).alias("ymin"), F.greatest(a["gx"], b["gx"]).alias("xmax"), F.greatest(a["gy"], b["gy"]).alias("ymax"))
    return F.when(F.size(box) == 4, out)
