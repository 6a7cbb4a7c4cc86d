"""Spark readers and writers over the codecs. Bytes come through ``binaryFile``, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.sources import shapefile, tiff

GEOMETRY = "struct<type:string,parts:array<array<struct<x:double,y:double>>>>"
HEADER = "path string, raster_id string, width int, height int, bands int, dtype string, gt array<double>, epsg int, nodata double, error string"
TILE = "raster_id string, tile_y int, tile_x int, y_off int, x_off int, h int, w int, bands int, dtype string, gt array<double>, epsg int, nodata double, data binary, error string"
STEM = r"([^/]+?)(\.[^./]*)?$"


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, stem, ext, length of files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), F.regexp_extract(name, STEM, 1).alias("stem"), F.lower(F.ltrim(F.regexp_extract(name, STEM, 2), F.lit("."))).alias("ext"), "length", "modificationTime")


def _blobs(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.regexp_extract("path", STEM, 1).alias("stem"), "content")


def raster_headers(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """A row a raster; a file that is none has its reason in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, s, c in zip(b.path, b.stem, b.content):
                try:
                    w, h, bands, dtype, gt, epsg, nodata = tiff.header(bytes(c))
                    rows.append((p, s, w, h, bands, dtype.lstrip("<>=|"), gt, epsg, nodata, None if gt else "no geotransform"))
                except Exception as e:  # one broken file must not end the job
                    rows.append((p, s, None, None, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEADER.split(", ")]).astype({"width": "Int32", "height": "Int32", "bands": "Int32", "epsg": "Int32"})

    return _blobs(spark, path, pattern).mapInPandas(run, HEADER)


def _ranges(path: str):
    """``read(at, size)`` over a file of any store that pyarrow opens."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or ":" not in path else path.replace(":", "://", 1))
    f = store.open_input_file(at)

    def read(at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)

    return read


def read_windows(spark: SparkSession, path: str, size: int = 1024, pattern: str = "*.tif") -> DataFrame:
    """The tiles of ``read_tiles``, each read by itself: headers by ranges, then only the blocks that meet a tile.

    No file is ever held whole, and a raster of any size is spread over tasks;
    paths must be of a store that pyarrow opens.
    """
    names = [x.split()[0] for x in TILE.split(", ")]
    plan = "path string, stem string, y int, x int, error string"

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, s in zip(b.path, b.stem):
                try:
                    w, h = tiff.header(_ranges(p))[:2]
                    rows = [(p, s, y, x, None) for y in range(0, h, size) for x in range(0, w, size)]
                except Exception as e:  # reported, not raised
                    rows = [(p, s, 0, 0, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "stem", "y", "x", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b.itertuples():
                try:
                    if t.error:
                        raise ValueError(t.error)
                    r = tiff.decode(_ranges(t.path), (t.y, t.x, size, size))
                except Exception as e:  # reported, not raised
                    yield pd.DataFrame([(t.stem, *[None] * 12, str(e) or type(e).__name__)], columns=names)
                    continue
                bands, h, w = r.data.shape
                yield pd.DataFrame([(t.stem, t.y // size, t.x // size, t.y, t.x, h, w, bands, r.data.dtype.str.lstrip("<>=|"), r.gt, r.epsg, r.nodata, r.data.tobytes(), None)], columns=names)

    found = inventory(spark, path, pattern).select("path", "stem").mapInPandas(windows, plan)
    return found.repartition("path", "y", "x").mapInPandas(run, TILE)


def read_tiles(spark: SparkSession, path: str, size: int = 1024, pattern: str = "*.tif") -> DataFrame:
    """Rasters below a folder in tiles of at most size x size; whole files are read (see ``read_windows``)."""
    return decode_tiles(_blobs(spark, path, pattern), size)


def decode_tiles(blobs: DataFrame, size: int = 1024) -> DataFrame:
    """Tiles of GeoTIFF bytes (stem, content): bytes of bands x h x w samples, with their own transform."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TILE.split(", ")]
        for b in batches:
            for s, c in zip(b.stem, b.content):
                try:
                    r = tiff.decode(bytes(c))
                except Exception as e:  # reported, not raised
                    yield pd.DataFrame([(s, *[None] * 12, str(e) or type(e).__name__)], columns=names)
                    continue
                bands, h, w = r.data.shape
                for ty, y in enumerate(range(0, h, size)):
                    for tx, x in enumerate(range(0, w, size)):
                        part = r.data[:, y : y + size, x : x + size]
                        gt = [r.gt[0] + x * r.gt[1] + y * r.gt[2], r.gt[1], r.gt[2], r.gt[3] + x * r.gt[4] + y * r.gt[5], r.gt[4], r.gt[5]]
                        yield pd.DataFrame([(s, ty, tx, y, x, part.shape[1], part.shape[2], bands, r.data.dtype.str.lstrip("<>=|"), gt, r.epsg, r.nodata, part.tobytes(), None)], columns=names)

    return blobs.select("stem", "content").mapInPandas(run, TILE)


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """The pixel relation (raster_id, band, y, x, v) of tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for t in b[b.error.isna()].itertuples():
                data = np.frombuffer(t.data, "<" + t.dtype).reshape(int(t.bands), int(t.h), int(t.w))
                band, y, x = np.indices(data.shape).reshape(3, -1)
                yield pd.DataFrame({"raster_id": t.raster_id, "band": band + 1, "y": y + int(t.y_off), "x": x + int(t.x_off), "v": data.reshape(-1).astype("float64")})

    return tiles.mapInPandas(run, "raster_id string, band int, y int, x int, v double")


def pixels_to_tiff(px: DataFrame, gt: list[float], epsg: int | None = None, nodata: float | None = None, dtype: str = "float32") -> DataFrame:
    """name, content: one GeoTIFF for each raster_id of (raster_id, band, y, x, v); for rasters that a task can hold."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        data = np.full((part.band.max(), part.y.max() + 1, part.x.max() + 1), nodata if nodata is not None else 0, dtype)
        data[part.band - 1, part.y, part.x] = part.v
        return pd.DataFrame({"name": [f"{part.raster_id.iloc[0]}.tif"], "content": [tiff.encode(tiff.Raster(data, gt, epsg, nodata))]})

    return px.groupBy("raster_id").applyInPandas(run, "name string, content binary")


def tile_files(tiles: DataFrame, lzw: bool = False, tile: int | None = None) -> DataFrame:
    """name, content: a GeoTIFF for each tile of ``read_tiles`` (without errors), ``{raster}_{y}_{x}.tif``, with its own transform."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            rows = []
            for t in b[b.error.isna()].itertuples():
                data = np.frombuffer(t.data, "<" + t.dtype).reshape(int(t.bands), int(t.h), int(t.w))
                epsg, nodata = (None if pd.isna(v) else v for v in (t.epsg, t.nodata))
                rows.append((f"{t.raster_id}_{int(t.tile_y)}_{int(t.tile_x)}.tif", tiff.encode(tiff.Raster(data, list(t.gt), epsg and int(epsg), nodata), lzw=lzw, tile=tile)))
            yield pd.DataFrame(rows, columns=["name", "content"])

    return tiles.mapInPandas(run, "name string, content binary")


def composite_files(px: DataFrame, gt: list[float], epsg: int | None = None) -> DataFrame:
    """name, content: float32 GeoTIFFs of three bands clipped to 0..1 (raster_id, band 1..3, y, x, v); any other band is an error."""
    ok = F.when(F.col("band").between(1, 3), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v")))).otherwise(F.raise_error(F.lit("a composite has three bands")))
    return pixels_to_tiff(px.withColumn("v", ok), gt, epsg, None, "float32")


def pixels_to_png(px: DataFrame) -> DataFrame:
    """name, content: a PNG with alpha for each raster of (raster_id, y, x, r, g, b, a); for rasters that a task can hold."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = np.zeros((part.y.max() + 1, part.x.max() + 1, 4), np.uint8)
        out[part.y, part.x] = part[["r", "g", "b", "a"]].to_numpy(np.uint8)
        return pd.DataFrame({"name": [f"{part.raster_id.iloc[0]}.png"], "content": [tiff.encode_png(out)]})

    return px.groupBy("raster_id").applyInPandas(run, "name string, content binary")


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """stem, band (1: blue, 2: green, 3: red, 4: alpha; gray has one), y, x, v of ordinary images, as Spark's image reader decodes them."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    slim = images.select(F.regexp_extract("image.origin", STEM, 1).alias("stem"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for t in b.itertuples():
                data = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, t.nChannels)
                y, x, band = np.indices(data.shape).reshape(3, -1)
                yield pd.DataFrame({"stem": t.stem, "band": band + 1, "y": y, "x": x, "v": data.reshape(-1)})

    return slim.mapInPandas(run, "stem string, band int, y int, x int, v int")


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) below a folder of any store that pyarrow opens; name, status. A file that exists is replaced whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            names = b.column("name").to_pylist()
            for name, content in zip(names, b.column("content").to_pylist()):
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(["written"] * len(names))], ["name", "status"])

    return files.select("name", "content").mapInArrow(run, "name string, status string")


def shapefile_schema(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """Fields of one layer's table (the header only reaches the driver)."""
    head = spark.read.format("binaryFile").load(path.rsplit(".", 1)[0] + ".dbf").select(F.substring("content", 1, 65_535).alias("c")).first()
    return shapefile.read_fields(bytes(head.c))


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """fid, geom, and the attributes of a layer (path of its .shp) but for deleted records; width and decimals are kept in the fields' metadata."""
    fields = shapefile_schema(spark, path)
    kinds = {"N": lambda d: T.DoubleType() if d else T.LongType(), "F": lambda d: T.DoubleType()}
    attributes = [T.StructField(n, kinds.get(t, lambda d: T.StringType())(d), True, {"width": w, "decimals": d}) for n, t, w, d in fields]
    geom = T._parse_datatype_string(f"g {GEOMETRY}")["g"].dataType
    schema = T.StructType([T.StructField("fid", T.LongType()), T.StructField("geom", geom), *attributes])
    stem = path.rsplit(".", 1)[0]
    both = [spark.read.format("binaryFile").load(f"{stem}.{e}").select(F.lit(0).alias("__k"), F.col("content").alias(e)) for e in ("shp", "dbf")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shp, dbf in zip(b.column("shp").to_pylist(), b.column("dbf").to_pylist()):
                shapes, records = shapefile.read_shapes(shp), shapefile.read_records(dbf)
                for start in range(0, len(shapes), 5000):
                    rows = [{"fid": start + k, "geom": None if s is None else {"type": s[0], "parts": [[{"x": p[0], "y": p[1]} for p in part] for part in s[1]]}, **{f.name: (float(r[f.name]) if isinstance(f.dataType, T.DoubleType) and r[f.name] is not None else r[f.name]) for f in attributes}} for k, (s, r) in enumerate(zip(shapes[start : start + 5000], records[start : start + 5000])) if r is not None]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return both[0].join(both[1], "__k").mapInArrow(run, schema)  # a row each


def shapefile_bytes(layer: DataFrame, kind: str, fields: list[tuple[str, str, int, int]], name: str) -> DataFrame:
    """name, content of the three files of one layer (fid, geom, attributes): for layers that a task can hold."""

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["fid"])
        shapes = [None if r["geom"] is None else [[(p["x"], p["y"]) for p in ring] for ring in r["geom"]["parts"]] for r in rows]
        content = shapefile.write_layer(kind, shapes, fields, rows)
        return pa.table({"name": [f"{name}.{e}" for e in ("shp", "shx", "dbf")], "content": pa.array(content, pa.binary())})

    return layer.groupBy(F.lit(0).alias("__one")).applyInArrow(run, "name string, content binary")


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """stem, line_no, line of label text files below a folder; empty files have one empty line."""
    blobs = _blobs(spark, path, "*.txt").select("stem", F.decode("content", "UTF-8").alias("text"))
    return blobs.select("stem", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """stem, path, width, height of images; null sizes are unreadable files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [tiff.image_size(bytes(c)) or (None, None) for c in b.content]
            yield pd.DataFrame({"stem": b.stem, "path": b.path, "width": [s[0] for s in sizes], "height": [s[1] for s in sizes]}).astype({"width": "Int32", "height": "Int32"})

    return _blobs(spark, path, "*").mapInPandas(run, "stem string, path string, width int, height int")
