"""Mask kernels on one tile (numpy), and the operators that run them tile by tile with Arrow.

Polygons and lines become masks, masks become polygons. Every kernel holds one
tile; tiles are dealt by key, so a task never sees a whole raster or layer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def _touched(a: tuple[float, float], b: tuple[float, float], h: int, w: int, mask: np.ndarray) -> None:
    """Marks every pixel that a segment passes through."""
    (x0, y0), (x1, y1) = a, b
    cuts = [0.0, 1.0]
    for p, q, n in ((x0, x1, w), (y0, y1, h)):
        if p != q:
            lo, hi = sorted((p, q))
            k = np.arange(max(0, np.ceil(lo)), min(n, np.floor(hi)) + 1)
            cuts += ((k - p) / (q - p)).tolist()
    t = np.unique(np.clip(cuts, 0, 1))
    middle = (t[1:] + t[:-1]) / 2 if len(t) > 1 else np.array([0.0])
    x, y = np.floor(x0 + (x1 - x0) * middle).astype(int), np.floor(y0 + (y1 - y0) * middle).astype(int)
    ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    mask[y[ok], x[ok]] = True


def polygon_mask(rings: list[Ring], h: int, w: int, all_touched: bool = True) -> np.ndarray:
    """Pixels whose centre is inside (even-odd), and with all_touched those that the border passes."""
    inside = np.zeros((h, w), bool)
    for y in range(h):
        cross = []
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if (y0 <= y + 0.5) != (y1 <= y + 0.5):
                    cross.append(x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0))
        cross.sort()
        for a, b in zip(cross[::2], cross[1::2]):
            lo, hi = int(np.ceil(a - 0.5)), int(np.ceil(b - 0.5))
            inside[y, max(lo, 0) : max(min(hi, w), 0)] = True
    if all_touched:
        for ring in rings:
            for a, b in zip(ring, ring[1:] + ring[:1]):
                _touched(a, b, h, w, inside)
    return inside


def line_mask(parts: list[Ring], h: int, w: int, radius: float) -> np.ndarray:
    """Pixels whose centre is within ``radius`` of a line: its buffer, without a polygon in between."""
    out = np.zeros((h, w), bool)
    for line in parts:
        for (x0, y0), (x1, y1) in zip(line, line[1:]):
            left, right = max(0, int(min(x0, x1) - radius - 1)), min(w, int(max(x0, x1) + radius + 2))
            top, low = max(0, int(min(y0, y1) - radius - 1)), min(h, int(max(y0, y1) + radius + 2))
            if left >= right or top >= low:
                continue
            y, x = np.mgrid[top:low, left:right] + 0.5
            dx, dy = x1 - x0, y1 - y0
            t = np.clip(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0.0
            out[top:low, left:right] |= (x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2 <= radius * radius
    return out


def clip_ring(ring: Ring, x0: float, y0: float, x1: float, y1: float) -> Ring:
    """Part of a ring inside a rectangle (edge by edge)."""
    for axis, limit, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out: Ring = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ain, bin_ = keep * (a[axis] - limit) >= 0, keep * (b[axis] - limit) >= 0
            if ain:
                out.append(a)
            if ain != bin_:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
    return ring


def ring_area(ring: Ring) -> float:
    x, y = np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def simplify(points: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker: drops points closer than the tolerance to the line of those kept."""
    if tolerance <= 0 or len(points) < 3:
        return points
    keep, todo, p = {0, len(points) - 1}, [(0, len(points) - 1)], np.array(points, float)
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        n = np.hypot(*d)
        off = p[a + 1 : b] - p[a]
        far = np.abs(off[:, 0] * d[1] - off[:, 1] * d[0]) / n if n else np.hypot(off[:, 0], off[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[k] for k in sorted(keep)]


STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def components8(mask: np.ndarray) -> np.ndarray:
    """Labels 1.. of 8-connected parts, by runs of pixels and a union-find over rows."""
    h, w = mask.shape
    parent = [0]

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out, above = np.zeros((h, w), np.int64), []
    for y in range(h):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        runs = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            touching = [find(k) for c, d, k in above if c <= b and d >= a]
            if touching:
                k = min(touching)
                for t in touching:
                    parent[t] = k
            else:
                k = len(parent)
                parent.append(k)
            runs.append((a, b, k))
            out[y, a:b] = k
        above = runs
    names = np.array([find(k) for k in range(len(parent))])
    return np.unique(names[out], return_inverse=True)[1].reshape(h, w) if mask.any() and not mask.all() else mask.astype(np.int64)


def outer_contours(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """(x, y) pixels around each 8-connected part, clockwise from its first pixel in reading order (Moore walk)."""
    labels, out = components8(mask), []
    padded = np.pad(labels, 1)
    for k in range(1, int(labels.max()) + 1):
        ys, xs = np.nonzero(labels == k)
        y, x = int(ys[0]) + 1, int(xs[0]) + 1
        start, direction, path, first = (y, x), 0, [(x - 1, y - 1)], None
        while True:
            for turn in range(8):
                d = (direction + 5 + turn) % 8 if len(path) > 1 or first else (4 + turn) % 8
                dy, dx = STEPS[d]
                if padded[y + dy, x + dx] == k:
                    break
            else:
                break  # a single pixel
            if (y, x) == start and first == d:
                break
            first = d if first is None else first
            y, x, direction = y + dy, x + dx, d
            path.append((x - 1, y - 1))
        out.append(path[:-1] if len(path) > 1 and path[-1] == path[0] else path)
    return out


def mask_labels(mask: np.ndarray, classes: dict[int, int], min_area: float = 10, epsilon: float = 0.0) -> list[tuple[int, list[float]]]:
    """(class, normalised clamped coordinates) of each outer contour whose area is large enough."""
    h, w = mask.shape
    out = []
    for value, cls in classes.items():
        for contour in outer_contours(mask == value):
            if len(contour) < 3 or ring_area(contour) < min_area:
                continue
            if epsilon > 0:
                around = sum(np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(contour, contour[1:] + contour[:1]))
                contour = simplify([*contour, contour[0]], epsilon * around)[:-1]
            if len(contour) >= 3:
                out.append((cls, [min(1.0, max(0.0, c / n)) for p in contour for c, n in zip(p, (w, h))]))
    return out


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton of a mask (Zhang-Suen passes until nothing changes)."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for first in (True, False):
            p = [m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            count = sum(p)
            turns = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            open_ = ((n * e * s == 0) & (e * s * w == 0)) if first else ((n * e * w == 0) & (n * s * w == 0))
            gone = (m[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & open_
            if gone.any():
                m[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def skeleton_lines(mask: np.ndarray, tolerance: float = 0.0) -> list[list[tuple[int, int]]]:
    """Polylines (x, y) along a thinned mask, cut at ends and crossings: a best-effort vectoriser."""
    m = np.pad(thin(mask), 1)
    near = sum(m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx].astype(int) for dy, dx in STEPS)
    deg = np.pad(near, 1) * m
    used, out = set(), []
    starts = sorted(zip(*np.nonzero(m)), key=lambda p: (deg[p] == 2, p))
    for s in starts:
        for dy, dx in STEPS:
            path, prev, here = [s], s, (s[0] + dy, s[1] + dx)
            if not m[here] or frozenset((prev, here)) in used:
                continue
            while True:
                used.add(frozenset((prev, here)))
                path.append(here)
                if deg[here] != 2 or here == s:
                    break
                nxt = [(here[0] + a, here[1] + b) for a, b in STEPS if m[here[0] + a, here[1] + b] and (here[0] + a, here[1] + b) != prev and frozenset((here, (here[0] + a, here[1] + b))) not in used]
                if not nxt:
                    break
                prev, here = here, nxt[0]
            out.append(simplify([(int(x) - 1, int(y) - 1) for y, x in path], tolerance))
    return out


MASK = "tile string, h int, w int, data binary"
LABELS = "stem string, line_no int, class_id int, coords array<double>"


def rasterize(features: DataFrame, tiles: DataFrame, line_radius: float = 0.0) -> DataFrame:
    """tile, h, w, data (a byte a pixel) of features (tile, seq, value, kind, parts in pixels); later seq overwrites; tiles without any are 0."""

    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        h, w = rows[0]["h"], rows[0]["w"]
        out = np.zeros((h, w), np.uint8)
        for f in sorted((r for r in rows if r["seq"] is not None), key=lambda r: r["seq"]):
            rings = [[(p["x"], p["y"]) for p in ring] for ring in f["parts"]]
            if f["kind"] == "LineString":
                hit = line_mask(rings, h, w, line_radius) if line_radius > 0 else np.zeros((h, w), bool)
            else:
                hit = polygon_mask(rings, h, w)
            out[hit] = int(f["value"])
        schema = pa.schema([("tile", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])
        return pa.Table.from_pylist([{"tile": rows[0]["tile"], "h": h, "w": w, "data": out.tobytes()}], schema=schema)

    both = tiles.select("tile", "h", "w").join(features.select("tile", "seq", "value", "kind", "parts"), "tile", "left")
    return both.groupBy("tile").applyInArrow(run, MASK)


def trace(masks: DataFrame, classes: dict[int, int], min_area: float = 10, epsilon: float = 0.0) -> DataFrame:
    """stem, line_no, class_id, coords of the contours of masks (tile, h, w, data)."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.itertuples():
                mask = np.frombuffer(t.data, np.uint8).reshape(t.h, t.w)
                rows += [(t.tile, k, c, xy) for k, (c, xy) in enumerate(mask_labels(mask, classes, min_area, epsilon))]
            yield pd.DataFrame(rows, columns=["stem", "line_no", "class_id", "coords"])

    return masks.mapInPandas(run, LABELS)


def labels_to_masks(labels: DataFrame, tiles: DataFrame, values: dict[int, int] | None = None) -> DataFrame:
    """Masks of label polygons (normalised); the value of a class is class + 1 unless given."""
    value = F.col("class_id") + 1
    if values:
        value = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("class_id")), value)
    size = tiles.select(F.col("tile").alias("stem"), "h", "w")
    n = F.floor(F.size("coords") / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((F.element_at("coords", 2 * k + 1) * F.col("w")).alias("x"), (F.element_at("coords", 2 * k + 2) * F.col("h")).alias("y")))
    f = labels.filter(F.size("coords") >= 6).join(size, "stem").select(F.col("stem").alias("tile"), F.col("line_no").alias("seq"), value.alias("value"), F.lit("Polygon").alias("kind"), F.array(points).alias("parts"))
    return rasterize(f, tiles)


def decode_instances(detections: DataFrame, proto: np.ndarray, size: int, min_pixels: int = 100) -> DataFrame:
    """det, cls, conf, y, x of mask pixels: coefficients x prototypes, logistic, bilinear to size, above 0.5, inside the rounded box.

    Degenerate boxes and instances under ``min_pixels`` go.
    """

    def run(batches):
        k, ph, pw = proto.shape
        yy, xx = (np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1) for n in (ph, pw))
        y0, x0 = np.floor(yy).astype(int), np.floor(xx).astype(int)
        y1, x1, fy, fx = np.minimum(y0 + 1, ph - 1), np.minimum(x0 + 1, pw - 1), (yy - y0)[:, None], (xx - x0)[None]
        for b in batches:
            for d in b.itertuples():
                p = 1 / (1 + np.exp(-np.tensordot(np.array(d.coef, float), proto, 1)))
                up = (p[y0][:, x0] * (1 - fy) + p[y1][:, x0] * fy) * (1 - fx) + (p[y0][:, x1] * (1 - fy) + p[y1][:, x1] * fy) * fx
                box = np.zeros((size, size), bool)
                box[max(0, round(d.y1)) : max(0, round(d.y2)), max(0, round(d.x1)) : max(0, round(d.x2))] = True
                y, x = np.nonzero((up > 0.5) & box)
                if len(y) >= min_pixels:
                    yield pd.DataFrame({"det": d.det, "cls": d.cls, "conf": d.conf, "y": y, "x": x})

    return detections.mapInPandas(run, "det long, cls int, conf double, y int, x int")


def run_model(tiles: DataFrame, load, schema: str) -> DataFrame:
    """Applies a model to tiles: ``load()`` is called once a task and gives a function from a pandas frame of tiles to one of detections."""

    def run(batches):
        model = load()
        for b in batches:
            yield model(b)

    return tiles.mapInPandas(run, schema)


def tile_tensor(data: np.ndarray, size: int, bgr: bool = False) -> np.ndarray:
    """Bands x h x w samples as a 1 x bands x size x size tensor: zero-padded; 8-bit BGR images become RGB over 255."""
    out = np.zeros((1, data.shape[0], size, size), np.float32)
    part = data[::-1] / 255.0 if bgr else data
    out[0, :, : data.shape[1], : data.shape[2]] = part[:, :size, :size]
    return out
