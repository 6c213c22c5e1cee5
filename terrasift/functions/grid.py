"""Cell frames: a raster is a DataFrame (r, c, channels ...), all channels of a cell in one row.

Focal operators are separable: along the rows first, then along the columns. Both have a partition key, so no group is
more than a line of the raster. Kernels are NumPy convolutions of a line, whose time grows with the line's length and the
kernel's; windows of SQL would need an expression for each of the kernel's places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from .ship import ship

SIDE = 32


def surface(spark: SparkSession, sf_dir: str, side: int = SIDE, value: str = "l_quantity") -> DataFrame:
    """A dense side x side raster (r, c, v) of a sum over lineitem; cells without rows are 0."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = items.groupBy((F.col("l_orderkey") % side).alias("r"), (F.col("l_partkey") % side).alias("c")).agg(F.sum(value).alias("v"))
    line = spark.range(side)
    grid = line.select(F.col("id").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(side - 1)).cast("array<long>")))
    return grid.join(sums, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def along(axis: str) -> W:
    """axis 'x': cells of a row by column; 'y': cells of a column by row."""
    return W.partitionBy("r").orderBy("c") if axis == "x" else W.partitionBy("c").orderBy("r")


def gauss_kernel(sigma: float) -> list[tuple[int, float]]:
    h = int(4 * sigma + 0.5)
    raw = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-h, h + 1)]
    whole = sum(x for _, x in raw)
    return [(k, x / whole) for k, x in raw]


def box_kernel(size: int) -> list[tuple[int, float]]:
    return [(k, 1 / size) for k in range(-(size // 2), size // 2 + 1)]


def by_lines(df: DataFrame, axis: str, new: list[str], run: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """df with the columns `new` (doubles), which run() makes of each line in order: a group is one line of the raster."""
    ship(df.sparkSession)
    key, place = ("r", "c") if axis == "x" else ("c", "r")
    schema = StructType([*(f for f in df.schema if f.name not in new), *(StructField(n, DoubleType()) for n in new)])

    def one(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values(place, ignore_index=True)
        return line.assign(**run(line))[schema.names]

    return df.groupBy(key).applyInPandas(one, schema)


def _kernels(df: DataFrame, specs: list[tuple[str, list[tuple[int, float]], str]], axis: str) -> DataFrame:
    plans = [(col, np.array([w for _, w in kernel]), out) for col, kernel, out in specs]

    def run(line: pd.DataFrame) -> dict[str, np.ndarray]:
        return {out: np.convolve(np.pad(line[col].to_numpy(float), len(w) // 2, "edge"), w, "valid") for col, w, out in plans}

    return by_lines(df, axis, [out for _, _, out in plans], run)


def convolve_all(df: DataFrame, specs: list[tuple[str, list[tuple[int, float]], str]]) -> DataFrame:
    """For each (column, symmetric kernel, out): the column under the kernel along both axes; the edge's value goes on beyond it.

    All lines along the rows come first and then all along the columns, so that any number of them takes two shuffles.
    """
    df = _kernels(df, [(col, kernel, f"_line_{i}") for i, (col, kernel, _) in enumerate(specs)], "x")
    df = _kernels(df, [(f"_line_{i}", kernel, out) for i, (_, kernel, out) in enumerate(specs)], "y")
    return df.drop(*(f"_line_{i}" for i in range(len(specs))))


def convolve(df: DataFrame, col: str, kernel: list[tuple[int, float]], out: str) -> DataFrame:
    return convolve_all(df, [(col, kernel, out)])


def gauss(df: DataFrame, col: str, sigma: float, out: str) -> DataFrame:
    return convolve(df, col, gauss_kernel(sigma), out)


def box_all(df: DataFrame, specs: list[tuple[str, int, Callable[[Column], Column], str]]) -> DataFrame:
    """For each (column, size, max or min, out): the column's extreme over a size x size window, in two shuffles."""
    df = df.withColumns({f"_line_{i}": how(F.col(col)).over(along("x").rowsBetween(-(size // 2), size // 2)) for i, (col, size, how, _) in enumerate(specs)})
    df = df.withColumns({out: how(F.col(f"_line_{i}")).over(along("y").rowsBetween(-(size // 2), size // 2)) for i, (_, size, how, out) in enumerate(specs)})
    return df.drop(*(f"_line_{i}" for i in range(len(specs))))


def box(df: DataFrame, col: str, size: int, how: Callable[[Column], Column], out: str) -> DataFrame:
    return box_all(df, [(col, size, how, out)])


def gradient(col: str, axis: str) -> Column:
    """Central differences, one-sided at the edges."""
    v, w = F.col(col), along(axis)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)


def odd_pixels(metres: float, least: int, resolution: float = 1.0) -> int:
    return max(least, int(round(metres / resolution)) | 1)


def relief_sigma(scale: float, resolution: float = 1.0) -> float:
    return max(0.7, scale / (2.355 * resolution))


def row_distances(g2: np.ndarray) -> np.ndarray:
    """min over j of (i - j)^2 + g2[j] for each i, by the lower envelope of the parabolas (Felzenszwalb and Huttenlocher, 2012); linear time."""
    n, out = len(g2), np.full(len(g2), np.inf)
    at: list[int] = []  # parabolas of the envelope, and where each begins
    begins: list[float] = []
    for j in np.flatnonzero(np.isfinite(g2)):
        start = -np.inf
        while at:
            k = at[-1]
            start = (g2[j] + j * j - g2[k] - k * k) / (2 * (j - k))
            if start > begins[-1]:
                break
            at.pop()
            begins.pop()
            start = -np.inf
        at.append(int(j))
        begins.append(start)
    if at:
        x = np.arange(n)
        own = np.array(at)[np.searchsorted(np.array(begins), x, side="right") - 1]
        out = (x - own) ** 2 + g2[own]
    return out


def nearest_along(known: np.ndarray) -> np.ndarray:
    """For each place the nearest place that is known (the earlier of two as near), -1 if there is none."""
    n = len(known)
    x = np.arange(n)
    before = np.maximum.accumulate(np.where(known, x, -1))
    after = n - 1 - np.maximum.accumulate(np.where(known[::-1], x, -1))[::-1]
    after = np.where(after >= n, -1, after)
    far = after < 0
    return np.where((before >= 0) & (far | (x - before <= after - x)), before, after)
