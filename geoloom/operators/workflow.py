"""The two fixed chains of operators, as plans: nothing is written, and only the audit runs at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import detect, files, labels, masks, network, raster, vector
from geoloom.session import stored


def merged(*settings: dict | None) -> dict:
    """First value that is not None for each key: command line, then file, then defaults."""
    out: dict = {}
    for s in settings:
        for k, v in (s or {}).items():
            if out.get(k) is None:
                out[k] = v
    return out


def load_config(path: str, paths: tuple[str, ...] = ()) -> dict:
    """A JSON file of settings (a byte order mark is ignored); the named keys are paths, relative ones against the file's folder."""
    import json
    from pathlib import Path

    found = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(found, dict):
        raise ValueError("settings are an object")
    here = Path(path).resolve().parent
    return {k: str((here / v).resolve()) if k in paths and v else v for k, v in found.items()}


def check_apart(output: str, *inputs: str) -> None:
    """Refuses an output folder that is, holds or lies in an input folder."""
    from pathlib import PurePosixPath

    out = PurePosixPath(output)
    for i in map(PurePosixPath, inputs):
        if out == i or out in i.parents or i in out.parents:
            raise ValueError(f"{output} and {i} are nested")


@dataclass(frozen=True)
class DatasetConfig:
    """Settings of a dataset build; checked when made."""

    annotation_type: str = "mask"
    tile_size: int = 1024
    overlap: int = 0
    val_ratio: float = 0.2
    seed: int = 42
    min_area: float = 10.0
    epsilon: float = 0.0
    line_radius: float = 1.25
    classes: dict[int, int] = field(default_factory=lambda: {255: 0, 128: 1})

    def __post_init__(self) -> None:
        if self.annotation_type not in ("shp", "mask"):
            raise ValueError("annotation_type is shp or mask")
        if not 0 <= self.val_ratio < 1:
            raise ValueError("val_ratio is in [0, 1)")
        if self.tile_size < 1 or not 0 <= self.overlap < self.tile_size:
            raise ValueError("overlap is in [0, tile_size)")


@dataclass(frozen=True)
class Dataset:
    composites: DataFrame
    labels: DataFrame
    split: DataFrame
    plan: DataFrame
    report: DataFrame


def build_dataset(px: DataFrame, annotations: DataFrame, tiles: DataFrame, config: DatasetConfig = DatasetConfig()) -> Dataset:
    """Composites, labels, split, copy plan and report of tiles.

    px: pixels (raster_id = tile, y, x, v). annotations: masks (tile, h, w, data)
    or features (tile, seq, value, kind, parts in pixels). tiles: (tile, h, w).
    The audit fails the build on a tile without composite or on a broken label line.
    """
    composites = raster.topo_composite(px)
    if config.annotation_type == "shp":
        annotations = masks.rasterize(annotations, tiles, config.line_radius)
    found = masks.trace(annotations, config.classes, config.min_area, config.epsilon)
    text = labels.yolo_text(found, tiles.select(F.col("tile").alias("stem")))
    text = stored(text, "labels")  # read by the audit, the split and the caller
    lines = text.filter("text <> ''").select("stem", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    stems = composites.select(F.col("raster_id").cast("string").alias("stem")).distinct()
    lacking, broken = files.missing(text, stems).count(), labels.issues_polygons(lines).count()
    if lacking or broken:
        raise ValueError(f"audit: {lacking} tiles have no composite, {broken} label lines are broken")
    samples = text.join(stems, "stem").select("stem", F.concat(F.lit("rgb/"), "stem", F.lit(".tif")).alias("img_path"), F.concat(F.lit("labels/"), "stem", F.lit(".txt")).alias("lbl_path"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("density"))
    split = labels.random_split(samples, config.val_ratio, config.seed)
    report = split.agg(F.count(F.lit(1)).alias("tiles"), F.sum("density").alias("instances"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    return Dataset(composites, text, split, labels.dataset_plan(split), report)


def clean_network(edges: DataFrame, srs_unit: float | None = 1.0, allow_degrees: bool = False, length: float = 300) -> DataFrame:
    """Topology clean-up of a layer in metres; other units are refused unless allowed."""
    lacking = {"fid", "u", "v", "len"} - set(edges.columns)
    if lacking:
        raise ValueError(f"fields are missing: {sorted(lacking)}")
    if not allow_degrees and (srs_unit is None or abs(srs_unit - 1) > 1e-9):
        raise ValueError("lengths are not in metres")
    return network.cleanup(edges, length)


def status_counts(log: DataFrame) -> DataFrame:
    """Rows of each status (a column: retries count nothing twice)."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def vector_labels(features: DataFrame, tiles: DataFrame, field: str = "grid_code", classes: dict[int, int] | None = None, line_radius: float = 1.25, min_area: float = 10.0, epsilon: float = 0.0, cell: float = 1000.0) -> DataFrame:
    """stem, text: label files of tiles (tile, h, w, gt) from features (fid, geom, a class field) of the same coordinate system.

    Features meet tiles by their boxes, are taken to pixels, drawn (later fid over
    earlier) and traced; a tile without any keeps an empty file.
    """
    classes = classes or {255: 0, 128: 1}
    points = F.flatten("geom.parts")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    ends = [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]
    found = vector.decode_classes(features.filter("geom is not null"), field, classes)
    found = found.select(F.col("fid").alias("seq"), "cls", F.col("geom.type").alias("kind"), F.col("geom.parts").alias("parts"), *ends)
    gt = F.col("gt")
    x2, y2 = gt[0] + F.col("w") * gt[1], gt[3] + F.col("h") * gt[5]
    extents = tiles.select("tile", "gt", F.least(gt[0], x2).alias("x1"), F.least(gt[3], y2).alias("y1"), F.greatest(gt[0], x2).alias("x2"), F.greatest(gt[3], y2).alias("y2"))
    met = vector.bbox_join(extents, found, cell)
    value = F.element_at(F.create_map(*[F.lit(x) for v, k in classes.items() for x in (k, v)]), F.col("cls"))
    drawn = met.select("tile", "seq", value.alias("value"), "kind", F.transform("parts", lambda p: vector.affine_points(p, F.col("gt"))).alias("parts"))
    traced = masks.trace(masks.rasterize(drawn, tiles, line_radius), classes, min_area, epsilon)
    return labels.yolo_text(traced, tiles.select(F.col("tile").alias("stem")))


def tile_masks(px: DataFrame, src: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile, h, w, data: large masks (raster_id, y, x, v; headers src) on the grids of tiles (raster_id, tile, gt, w, h), nearest, 0 outside."""
    import numpy as np
    import pandas as pd

    at = raster.warp(px, src, tiles, bilinear=False, background=0.0, tile="tile").join(tiles.select("tile", F.col("h").alias("__h"), F.col("w").alias("__w")), "tile")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        h, w = int(part["__h"].iloc[0]), int(part["__w"].iloc[0])
        out = np.zeros((h, w), np.uint8)
        out[part.y, part.x] = part.v.astype(np.uint8)
        return pd.DataFrame({"tile": [part.tile.iloc[0]], "h": [h], "w": [w], "data": [out.tobytes()]})

    return at.select("tile", "__h", "__w", "y", "x", "v").groupBy("tile").applyInPandas(run, masks.MASK)


def mask_labels(px: DataFrame, src: DataFrame, tiles: DataFrame, classes: dict[int, int] | None = None, min_area: float = 10.0, epsilon: float = 0.0) -> DataFrame:
    """stem, text: label files of tiles from large masks (see ``tile_masks``)."""
    traced = masks.trace(tile_masks(px, src, tiles), classes or {255: 0, 128: 1}, min_area, epsilon)
    return labels.yolo_text(traced, tiles.select(F.col("tile").alias("stem")))


@dataclass(frozen=True)
class Inference:
    classes: DataFrame
    confidence: DataFrame


def infer(tiles: DataFrame, load, class_offset: int = 1) -> Inference:
    """Class raster (raster_id, y, x, cls, conf) and confidence of each class (raster_id, y, x, cls, conf) of tiles.

    ``load()`` gives a model: a function from a pandas frame of tiles to one of mask
    pixels (raster_id, seq, y, x in the whole raster, cls, conf). Tiles may overlap:
    the highest confidence wins, of equal ones the first seq.
    """
    found = stored(masks.run_model(tiles, load, "raster_id string, seq long, y int, x int, cls int, conf double"), "pixels")
    keys = ("raster_id", "y", "x")
    best = detect.merge_strict(found, keys).withColumn("cls", (F.col("cls") + class_offset).cast("int"))
    return Inference(best, detect.class_confidence(found, keys))
