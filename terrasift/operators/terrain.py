"""Terrain channels from an elevation raster: relief, hillshade, line, ring, ridge and texture responses."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid, stats
from ..functions.durable import durable

# Scales in metres of relief, pattern and line responses; how many are used grows with the level.
RELIEF_SCALES = (1.5, 2.5, 4.0, 6.0, 10.0, 16.0, 24.0, 36.0, 54.0, 80.0)
PATTERN_SCALES = (3.0, 6.0, 12.0, 24.0, 48.0)
LINE_SCALES = (3.0, 5.0, 8.0, 12.0, 20.0, 32.0)


def relief_scales(level: int) -> tuple[float, ...]:
    return tuple(s for s in RELIEF_SCALES if s <= 10 + 8 * level)


def pattern_scales(level: int) -> tuple[float, ...]:
    return tuple(s for s in PATTERN_SCALES if s <= 12 + 5 * level)


def line_scales(level: int) -> tuple[float, ...]:
    return tuple(s for s in LINE_SCALES if s <= pattern_scales(level)[-1])


#: Those of level 5.
SCALES, PATTERN, LINES = relief_scales(5), pattern_scales(5), line_scales(5)


def fill_nearest(cells: DataFrame, col: str = "v") -> DataFrame:
    """Empty cells take the nearest cell's value (ties: the first in row order).

    Two passes along the lines, whatever the holes' sizes: the nearest value in each column, then, for each empty cell of
    a row, the nearest of what the columns have. A raster without any value is an error; cells must fill a rectangle.
    """
    if cells.where(F.col(col).isNotNull()).isEmpty():
        raise ValueError("no cell has a value")

    def down(line: pd.DataFrame) -> dict[str, np.ndarray]:
        v, rows = line["v"].to_numpy(float), line["r"].to_numpy(float)
        at = grid.nearest_along(~np.isnan(v))
        return {"_row": np.where(at < 0, np.nan, rows[at]), "_value": np.where(at < 0, np.nan, v[at])}

    def across(line: pd.DataFrame) -> dict[str, np.ndarray]:
        row, value, v = line["_row"].to_numpy(), line["_value"].to_numpy(), line["v"].to_numpy(float).copy()
        g2 = np.where(np.isnan(row), np.inf, (row - line["r"].to_numpy()) ** 2)
        far = grid.row_distances(g2)
        for i in np.flatnonzero(np.isnan(v)):
            reach = int(far[i] ** 0.5)
            near = np.arange(max(0, i - reach), min(len(v), i + reach + 1))
            near = near[(near - i) ** 2 + g2[near] == far[i]]
            v[i] = value[near[np.argmin(row[near])]]
        return {"_filled": v}

    lined = grid.by_lines(cells.select("r", "c", F.col(col).cast("double").alias("v")), "y", ["_row", "_value"], down)
    return grid.by_lines(lined, "x", ["_filled"], across).select("r", "c", F.col("_filled").alias("v"))


def slope(cells: DataFrame, col: str = "v") -> DataFrame:
    # A smoothed frame is partitioned by column already, so gy needs no shuffle.
    return cells.withColumn("gy", grid.gradient(col, "y")).withColumn("gx", grid.gradient(col, "x")).withColumn("slope", F.hypot("gx", "gy"))


def curvature(cells: DataFrame, out: str) -> DataFrame:
    """out: |d gx / dx + d gy / dy|, from a frame that slope() leaves partitioned by row."""
    cells = cells.withColumn("_cx", grid.gradient("gx", "x")).withColumn("_cy", grid.gradient("gy", "y"))
    return cells.withColumn(out, F.abs(F.col("_cx") + F.col("_cy"))).drop("_cx", "_cy")


def shade(azimuth: float, altitude: float) -> Column:
    """0..255 from gx and gy, not yet truncated."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    steep = math.pi / 2 - F.atan(F.hypot("gx", "gy"))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    s = math.sin(alt) * F.sin(steep) + math.cos(alt) * F.cos(steep) * F.cos(az - aspect)
    return stats.clip((s + 1) * 127.5, 0.0, 255.0)


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, sigma: float = 0.6) -> DataFrame:
    """shade: 0..255, truncated."""
    return slope(grid.gauss(cells, "v", sigma, "s"), "s").withColumn("shade", F.floor(shade(azimuth, altitude)))


def hillshade_multi(cells: DataFrame, altitude: float = 35.0, sigma: float = 0.6) -> DataFrame:
    """shade: mean of eight truncated azimuths, truncated."""
    sloped = slope(grid.gauss(cells, "v", sigma, "s"), "s")
    each = [F.floor(shade(az, altitude)) for az in range(0, 360, 45)]
    return sloped.withColumn("shade", F.floor(sum(each[1:], each[0]) / 8))


def hillshade_arch(cells: DataFrame) -> DataFrame:
    """shade: seven tenths multidirectional, three tenths north-west, stretched between the 2nd and 98th percentile, gamma 0.9."""
    sloped = slope(grid.gauss(cells, "v", 0.6, "s"), "s")
    each = [F.floor(shade(az, 38.0)) for az in range(0, 360, 45)]
    mixed = sloped.withColumn("m", 0.7 * F.floor(sum(each[1:], each[0]) / 8) + 0.3 * F.floor(shade(315.0, 42.0)))
    ranged = stats.with_facts(mixed, stats.quantile("m", 0.02).alias("lo"), stats.quantile("m", 0.98).alias("hi"))
    unit = stats.clip((F.col("m") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)))
    return ranged.withColumn("shade", F.rint(255 * F.pow(unit, 0.9)))


def reliefs(cells: DataFrame, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """rel_0 ...: value minus its Gaussian mean at each scale."""
    cells = grid.convolve_all(cells, [("v", grid.gauss_kernel(grid.relief_sigma(s)), f"_g{i}") for i, s in enumerate(scales)])
    return cells.withColumns({f"rel_{i}": F.col("v") - F.col(f"_g{i}") for i in range(len(scales))}).drop(*(f"_g{i}" for i in range(len(scales))))


def relief_z(cells: DataFrame, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """z_0 ...: robust z of the reliefs."""
    return stats.mad_zs(reliefs(cells, scales), {f"rel_{i}": f"z_{i}" for i in range(len(scales))})


def with_strongest(cells: DataFrame, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """cells with scale and relief where the z is highest; the first scale wins ties."""
    best = F.array_max(F.array(*(F.struct(F.col(f"z_{i}").alias("z"), F.lit(-i).alias("k"), F.lit(s).alias("scale"), F.col(f"rel_{i}").alias("relief")) for i, s in enumerate(scales))))
    return cells.withColumn("_b", best).withColumn("scale", F.col("_b.scale")).withColumn("relief", F.col("_b.relief")).drop("_b")


def strongest(cells: DataFrame, scales: tuple[float, ...] = SCALES) -> DataFrame:
    return with_strongest(cells, scales).select("r", "c", "scale", "relief")


def persistence_cutoff(level: int) -> float:
    return max(1.25, 2.5 - 0.08 * level)


def relief_channels(cells: DataFrame, level: int = 5, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """max_relief (robust unit of the z, so normalised twice) and persistence (share of scales beyond the cut-off)."""
    cells = stats.robust_units(relief_z(cells, scales), {f"z_{i}": f"u_{i}" for i in range(len(scales))}, 0.997)
    over = [(F.col(f"z_{i}") >= persistence_cutoff(level)).cast("int") for i in range(len(scales))]
    return cells.withColumn("max_relief", reduce(F.greatest, (F.col(f"u_{i}") for i in range(len(scales))))).withColumn("persistence", sum(over[1:], over[0]) / len(scales))


def coherence(cells: DataFrame, gx: str, gy: str, sigma: float) -> DataFrame:
    """coherence of the structure tensor, 0 where there is no gradient."""
    products = cells.withColumn("_xx", F.col(gx) * F.col(gx)).withColumn("_xy", F.col(gx) * F.col(gy)).withColumn("_yy", F.col(gy) * F.col(gy))
    products = grid.convolve_all(products, [(p, grid.gauss_kernel(sigma), p) for p in ("_xx", "_xy", "_yy")])
    return products.withColumn("coherence", _coherent("_xx", "_xy", "_yy")).drop("_xx", "_xy", "_yy")


def _coherent(xx: str, xy: str, yy: str) -> Column:
    trace = F.col(xx) + F.col(yy)
    root = F.sqrt((F.col(xx) - F.col(yy)) ** 2 + 4 * F.col(xy) ** 2)
    return F.when(trace > 1e-9, root / (trace + 1e-9)).otherwise(0.0)


def linear(cells: DataFrame, scales: tuple[float, ...] = LINES) -> DataFrame:
    """linear: the strongest line response over the scales; linear_scale: the scale that has it (the first of equals; 0 without any response).

    At each scale: relief * edge * (0.30 + 0.50 coherence + 0.20 curvature). All scales go through each step together, so
    that any number of them takes as many shuffles and aggregates as one.
    """
    each = range(len(scales))

    def on(name: str, col: str, axis: str) -> dict[str, Column]:
        return {f"{name}{i}": grid.gradient(f"{col}{i}", axis) for i in each}

    df = grid.convolve_all(cells, [("v", grid.gauss_kernel(grid.relief_sigma(s)), f"_s{i}") for i, s in enumerate(scales)])
    df = df.withColumns(on("_gy", "_s", "y")).withColumns(on("_gx", "_s", "x")).withColumns(on("_cx", "_gx", "x")).withColumns(on("_cy", "_gy", "y"))
    x, y = (lambda i: F.col(f"_gx{i}")), (lambda i: F.col(f"_gy{i}"))
    df = df.withColumns({f"_k{i}": F.abs(F.col(f"_cx{i}") + F.col(f"_cy{i}")) for i in each} | {f"_e{i}": F.abs(F.col("v") - F.col(f"_s{i}")) for i in each} | {f"_d{i}": F.hypot(x(i), y(i)) for i in each})
    df = df.withColumns({f"_{k}{i}": p for i in each for k, p in (("xx", x(i) * x(i)), ("xy", x(i) * y(i)), ("yy", y(i) * y(i)))})
    products = [f"_{k}{i}" for i in each for k in ("xx", "xy", "yy")]
    df = grid.convolve_all(df.drop(*(f"_{k}{i}" for i in each for k in ("s", "gx", "gy", "cx", "cy"))), [(p, grid.gauss_kernel(1.4), p) for p in products])
    names = [f"_{k}{i}" for i in each for k in "ked"]
    df = stats.robust_units(df, {n: f"_u{n}" for n in names}, 0.997)

    def response(i: int) -> Column:
        return F.col(f"_u_e{i}") * F.col(f"_u_d{i}") * (0.30 + 0.50 * stats.clip(_coherent(f"_xx{i}", f"_xy{i}", f"_yy{i}")) + 0.20 * F.col(f"_u_k{i}"))

    best = F.array_max(F.array(*(F.struct(response(i).alias("v"), F.lit(-i).alias("k"), F.lit(s).alias("scale")) for i, s in enumerate(scales))))
    df = df.withColumn("_b", best)
    return df.select(*cells.columns, stats.clip(F.col("_b.v")).alias("linear"), F.when(F.col("_b.v") > 0, F.col("_b.scale")).otherwise(0.0).alias("linear_scale"))


def annular(cells: DataFrame, scales: tuple[float, ...] = PATTERN) -> DataFrame:
    """Ring response: difference of nested box means, the strongest over the scales."""
    sizes = [(f"_{k}{i}", grid.odd_pixels(f * s, least)) for i, s in enumerate(scales) for k, f, least in (("o", 2.4, 5), ("i", 0.75, 3))]
    df = grid.convolve_all(cells, [("v", grid.box_kernel(n), out) for out, n in sizes])
    df = df.withColumns({f"_d{i}": F.abs(F.col(f"_o{i}") - F.col(f"_i{i}")) for i in range(len(scales))})
    df = stats.robust_units(df, {f"_d{i}": f"_a{i}" for i in range(len(scales))}, 0.997)
    return df.select(*cells.columns, reduce(F.greatest, (F.col(f"_a{i}") for i in range(len(scales)))).alias("annular"))


def ridge_valley(cells: DataFrame, scales: tuple[float, ...] = PATTERN) -> DataFrame:
    """Height over the lowest and depth under the highest cell near by, the strongest over the scales."""
    df = grid.box_all(cells, [("v", grid.odd_pixels(s, 3), how, f"_{k}{i}") for i, s in enumerate(scales) for k, how in (("hi", F.max), ("lo", F.min))])
    df = df.withColumns({f"_up{i}": F.col("v") - F.col(f"_lo{i}") for i in range(len(scales))} | {f"_dn{i}": F.col(f"_hi{i}") - F.col("v") for i in range(len(scales))})
    names = [f"{k}{i}" for i in range(len(scales)) for k in ("_up", "_dn")]
    df = stats.robust_units(df, {n: f"_u{n}" for n in names}, 0.997)
    return df.select(*cells.columns, reduce(F.greatest, (F.col(f"_u{n}") for n in names)).alias("ridge_valley"))


def texture(cells: DataFrame, scales: tuple[float, ...] = SCALES, base: float = 6.0) -> DataFrame:
    """texture and coherence at the base scale."""
    df = reliefs(cells, scales)
    df = grid.convolve_all(df, [(f"rel_{i}", grid.gauss_kernel(1.2), f"_t{i}") for i in range(len(scales))] + [("v", grid.gauss_kernel(grid.relief_sigma(base)), "s")])
    df = df.withColumn("_tex", reduce(F.greatest, (F.abs(F.col(f"rel_{i}") - F.col(f"_t{i}")) for i in range(len(scales)))))
    df = curvature(slope(df, "s"), "_curv")
    df = stats.robust_units(coherence(df, "gx", "gy", 1.6), {"_tex": "_rt", "_curv": "_rc", "slope": "_rs"}, 0.997)
    value = F.greatest(F.col("_rt"), 0.55 * F.col("_rc") + 0.45 * F.col("_rs") * stats.clip(F.col("coherence")))
    return df.withColumn("texture", value).withColumn("coherence", stats.clip(F.col("coherence"))).select(*cells.columns, "texture", "coherence")


#: Weights of the discovery score (plain; with local learning; with a stored model).
DISCOVERY = {
    "plain": {"max_relief": 0.25, "persistence": 0.13, "linear": 0.16, "annular": 0.13, "ridge_valley": 0.11, "texture": 0.08, "terrain_novelty": 0.10, "coherence": 0.04},
    "local": {"max_relief": 0.18, "persistence": 0.11, "linear": 0.13, "annular": 0.10, "ridge_valley": 0.09, "texture": 0.07, "terrain_novelty": 0.07, "coherence": 0.03, "archaeology": 0.22},
    "stored": {"max_relief": 0.12, "persistence": 0.08, "linear": 0.09, "annular": 0.07, "ridge_valley": 0.07, "texture": 0.06, "terrain_novelty": 0.06, "coherence": 0.02, "archaeology": 0.11, "trained": 0.32},
}


def discovery(kind: str) -> Column:
    terms = [F.col(c) * w for c, w in DISCOVERY[kind].items()]
    return sum(terms[1:], terms[0])


def spectral_anomaly(cells: DataFrame, col: str, sigma: float = 3.0) -> DataFrame:
    """Distance from the Gaussian background in six robust deviations, clipped."""
    df = grid.gauss(cells, col, sigma, "_g").withColumn("_off", F.abs(F.col(col) - F.col("_g")))
    df = stats.with_quantiles(durable(df), {"_mad": ("_off", 0.5)})
    return df.withColumn("anomaly", stats.clip(F.col("_off") / F.greatest(6 * F.col("_mad"), F.lit(1e-6))))


def stride(cells: DataFrame, step: int) -> DataFrame:
    return cells.where((F.col("r") % step == 0) & (F.col("c") % step == 0))


def zoom(coarse: DataFrame, step: int, side: int) -> DataFrame:
    """Bilinear: a coarse raster (r, c, v) of n x n cells back to side x side; corners meet corners."""
    n = -(-side // step)
    ratio = (n - 1) / (side - 1)
    spark = coarse.sparkSession
    fine = spark.range(side).select(F.col("id").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(side - 1)).cast("array<long>")))
    y, x = F.col("r") * ratio, F.col("c") * ratio
    at = fine.select("r", "c", F.floor(y).alias("y0"), F.floor(x).alias("x0"), (y - F.floor(y)).alias("fy"), (x - F.floor(x)).alias("fx"))
    corners = at.withColumn("d", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
    weight = F.when(F.col("d.i") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("d.j") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    look = corners.select("r", "c", F.least(F.col("y0") + F.col("d.i"), F.lit(n - 1)).alias("_r"), F.least(F.col("x0") + F.col("d.j"), F.lit(n - 1)).alias("_c"), weight.alias("w"))
    return look.join(coarse.select(F.col("r").alias("_r"), F.col("c").alias("_c"), "v"), ["_r", "_c"]).groupBy("r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
