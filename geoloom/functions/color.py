"""Elevation palettes and shading in the Lab colour space, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RGB steps of the named palettes, from low to high.
PALETTES = {
    "linsar": [
        (200, 215, 133), (171, 217, 177), (124, 196, 120), (117, 193, 120), (175, 204, 166), (219, 208, 78), (241, 207, 14),
        (242, 167, 0), (192, 159, 13), (211, 192, 112), (240, 219, 161), (252, 236, 192), (248, 250, 234), (229, 254, 250),
        (219, 255, 253), (214, 251, 252), (183, 244, 247), (115, 224, 241), (29, 188, 239), (0, 137, 245), (0, 80, 250),
    ],
    "terrain": [(0, 128, 0), (0, 200, 0), (128, 200, 0), (200, 200, 0), (200, 150, 0), (180, 120, 60), (150, 100, 50), (200, 180, 140), (230, 220, 200), (255, 255, 255)],
    "elevation": [(0, 0, 200), (0, 100, 255), (0, 200, 200), (0, 255, 0), (128, 255, 0), (255, 255, 0), (255, 128, 0), (255, 0, 0), (128, 0, 0), (255, 255, 255)],
    "dem": [(0, 100, 0), (50, 150, 50), (100, 180, 80), (150, 200, 100), (200, 200, 100), (220, 180, 80), (200, 150, 80), (180, 120, 80), (160, 100, 80), (200, 200, 200), (255, 255, 255)],
}
# sRGB primaries to XYZ, the D65 white point, and the Lab curve's constants.
TO_XYZ = [(0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227)]
TO_RGB = [(3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311)]
WHITE = (0.950456, 1.0, 1.088754)
KNEE, SLOPE = 0.008856, 7.787


def palette(name: str) -> list[tuple[int, int, int]]:
    """Steps of a palette; an unknown name gives the first one."""
    return PALETTES.get(name, PALETTES["linsar"])


def elevation_color(v: Column, ok: Column, lo: Column, hi: Column, name: str = "linsar") -> list[Column]:
    """Red, green and blue (0..1) of an elevation; invalid pixels and flat ranges take the first step."""
    steps = palette(name)
    at = F.greatest(lo, F.least(hi, v)) - lo
    at = F.when(ok & (hi > lo), at / (hi - lo) * (len(steps) - 1)).otherwise(F.lit(0.0))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    bands = [F.array(*[F.lit(float(s[k])) for s in steps]) for k in range(3)]
    return [(b[low] * (1 - (at - low)) + b[high] * (at - low)) / 255 for b in bands]


def sql_elevation(v: str, lo: str, hi: str, name: str) -> list[str]:
    """The same as DuckDB SQL, with nodata -9999."""
    steps = palette(name)
    at = f"(case when {v} <> -9999 and {hi} > {lo} then (greatest({lo}, least({hi}, {v})) - {lo}) / ({hi} - {lo}) * {len(steps) - 1} else 0 end)"
    bands = ["[" + ", ".join(str(float(s[k])) for s in steps) + "]" for k in range(3)]
    return [f"(({b})[cast(floor({at}) as integer) + 1] * (1 - ({at} - floor({at}))) + ({b})[cast(ceil({at}) as integer) + 1] * ({at} - floor({at}))) / 255" for b in bands]


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _gamma(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def lab_blend(r: Column, g: Column, b: Column, shade: Column, boost: float = 1.0) -> list[Column]:
    """RGB (0..1) with its Lab lightness scaled by shade ** (1 / boost)."""
    c = [_linear(x) for x in (r, g, b)]
    xyz = [sum(m * x for m, x in zip(row, c)) / w for row, w in zip(TO_XYZ, WHITE)]
    fx, fy, fz = (F.when(t > KNEE, F.cbrt(t)).otherwise(SLOPE * t + 16 / 116) for t in xyz)
    light = F.when(xyz[1] > KNEE, 116 * F.cbrt(xyz[1]) - 16).otherwise(903.3 * xyz[1])
    light = F.greatest(F.lit(0.0), F.least(F.lit(100.0), light * (F.pow(shade, F.lit(1.0 / boost)) if boost != 1 else shade)))
    ny = F.when(light <= 903.3 * KNEE, light / 903.3).otherwise(F.pow((light + 16) / 116, F.lit(3.0)))
    gy = F.when(light <= 903.3 * KNEE, SLOPE * ny + 16 / 116).otherwise((light + 16) / 116)
    gx, gz = gy + (fx - fy), gy - (fy - fz)
    back = [F.when(t <= SLOPE * KNEE + 16 / 116, (t - 16 / 116) / SLOPE).otherwise(t * t * t) * w for t, w in ((gx, WHITE[0]), (gz, WHITE[2]))]
    x, y, z = back[0], ny, back[1]
    rgb = [_gamma(m[0] * x + m[1] * y + m[2] * z) for m in TO_RGB]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) for t in rgb]


def blended(df: DataFrame, names: tuple[str, str, str], shade: str, boost: float = 1.0) -> DataFrame:
    """df with its RGB columns (0..1) of a Lab lightness that is scaled by shade ** (1 / boost).

    Step by step: each step uses the last one's columns several times, so the
    optimizer keeps them as projections of their own, and no expression is copied.
    """
    df = df.withColumns({f"__c{k}": _linear(F.col(n)) for k, n in enumerate(names)})
    df = df.withColumns({f"__t{k}": sum(m * F.col(f"__c{j}") for j, m in enumerate(row)) / w for k, (row, w) in enumerate(zip(TO_XYZ, WHITE))})
    t = [F.col(f"__t{k}") for k in range(3)]
    cube = [F.when(v > KNEE, F.cbrt(v)).otherwise(SLOPE * v + 16 / 116) for v in t]
    light = F.when(t[1] > KNEE, 116 * F.cbrt(t[1]) - 16).otherwise(903.3 * t[1])
    light = F.greatest(F.lit(0.0), F.least(F.lit(100.0), light * (F.pow(F.col(shade), F.lit(1.0 / boost)) if boost != 1 else F.col(shade))))
    df = df.withColumns({"__l": light, "__f0": cube[0], "__f1": cube[1], "__f2": cube[2]})
    low = F.col("__l") <= 903.3 * KNEE
    df = df.withColumn("__y", F.when(low, F.col("__l") / 903.3).otherwise(F.pow((F.col("__l") + 16) / 116, F.lit(3.0))))
    df = df.withColumn("__g", F.when(low, SLOPE * F.col("__y") + 16 / 116).otherwise((F.col("__l") + 16) / 116))
    df = df.withColumns({"__gx": F.col("__g") + (F.col("__f0") - F.col("__f1")), "__gz": F.col("__g") - (F.col("__f1") - F.col("__f2"))})
    back = [F.when(v <= SLOPE * KNEE + 16 / 116, (v - 16 / 116) / SLOPE).otherwise(v * v * v) * w for v, w in ((F.col("__gx"), WHITE[0]), (F.col("__gz"), WHITE[2]))]
    df = df.withColumns({"__x": back[0], "__z": back[1]})
    df = df.withColumns({f"__c{k}": m[0] * F.col("__x") + m[1] * F.col("__y") + m[2] * F.col("__z") for k, m in enumerate(TO_RGB)})
    df = df.withColumns({n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), _gamma(F.col(f"__c{k}")))) for k, n in enumerate(names)})
    return df.drop(*[f"__{a}{k}" for a in "ctf" for k in range(3)], "__l", "__y", "__g", "__gx", "__gz", "__x", "__z")


def to_bytes(c: Column) -> Column:
    """0..1 to 0..255, truncated."""
    return F.floor(c * 255).cast("int")


def sql_blend(r: str, g: str, b: str, shade: str, boost: float) -> str:
    """lab_blend as DuckDB SQL: three rounded columns out_r, out_g, out_b."""
    lin = [f"(case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end)" for c in (r, g, b)]
    xyz = [f"(({' + '.join(f'{m} * {x}' for m, x in zip(row, lin))}) / {w})" for row, w in zip(TO_XYZ, WHITE)]
    f = [f"(case when {t} > {KNEE} then cbrt({t}) else {SLOPE} * {t} + 16.0 / 116 end)" for t in xyz]
    light = f"greatest(0, least(100, (case when {xyz[1]} > {KNEE} then 116 * cbrt({xyz[1]}) - 16 else 903.3 * {xyz[1]} end) * pow({shade}, {1.0 / boost})))"
    low = f"({light}) <= {903.3 * KNEE}"
    ny = f"(case when {low} then ({light}) / 903.3 else pow((({light}) + 16) / 116, 3) end)"
    gy = f"(case when {low} then {SLOPE} * {ny} + 16.0 / 116 else (({light}) + 16) / 116 end)"
    back = {k: f"(case when ({t}) <= {SLOPE * KNEE + 16 / 116} then (({t}) - 16.0 / 116) / {SLOPE} else pow({t}, 3) end * {w})" for k, t, w in (("x", f"{gy} + ({f[0]} - {f[1]})", WHITE[0]), ("z", f"{gy} - ({f[1]} - {f[2]})", WHITE[2]))}
    out = []
    for m, name in zip(TO_RGB, ("out_r", "out_g", "out_b")):
        v = f"({m[0]} * {back['x']} + {m[1]} * {ny} + {m[2]} * {back['z']})"
        gamma = f"(case when {v} <= 0.0031308 then {v} * 12.92 else pow(greatest({v}, 0), {1 / 2.4}) * 1.055 - 0.055 end)"
        out.append(f"round(greatest(0, least(1, {gamma})), 4) as {name}")
    return ", ".join(out)
