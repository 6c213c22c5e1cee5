"""Masks of cells: thresholds, votes, morphology, components and what is measured on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import grid, stats
from ..functions.durable import durable


def thresholds(cells: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """One row: the exact percentile (0..100) of each channel, in one aggregate."""
    return cells.agg(*(F.percentile(c, F.lit(p / 100)).alias(c) for c, p in cuts.items()))


def vote(cells: DataFrame, cuts: dict[str, float], level: int) -> DataFrame:
    """hits: channels at or above their percentile; mask: enough of them (2 up to level 4, then 1)."""
    limits = thresholds(cells, cuts).select(*(F.col(c).alias(f"_t_{c}") for c in cuts))
    hits = [(F.col(c) >= F.col(f"_t_{c}")).cast("int") for c in cuts]
    out = cells.crossJoin(F.broadcast(limits)).withColumn("hits", sum(hits[1:], hits[0]))
    return out.withColumn("mask", F.col("hits") >= (2 if level <= 4 else 1)).drop(*(f"_t_{c}" for c in cuts))


def ridge_floor(level: int) -> float:
    return max(0.45, 0.76 - 0.025 * level)


def dilate(cells: DataFrame, mask: str, size: int, out: str) -> DataFrame:
    """Square dilation of a 0/1 column."""
    return grid.box(cells, mask, size, F.max, out)


def dilate_cross(cells: DataFrame, mask: str, times: int, out: str) -> DataFrame:
    """Dilation by the four-neighbour cross, repeated."""
    df = cells.withColumn(out, F.col(mask))
    for _ in range(times):
        across = F.max(out).over(grid.along("x").rowsBetween(-1, 1))
        down = F.max(out).over(grid.along("y").rowsBetween(-1, 1))
        df = df.withColumn("_a", across).withColumn("_b", down).withColumn(out, F.greatest("_a", "_b")).drop("_a", "_b")
    return df


def close(cells: DataFrame, mask: str, k: int, out: str) -> DataFrame:
    """Closing by a (2k+1) square; erosion takes cells outside the raster as empty."""
    df = grid.box(cells, mask, 2 * k + 1, F.max, "_d")
    for axis in ("x", "y"):
        w = grid.along(axis).rowsBetween(-k, k)
        df = df.withColumn("_d", F.when(F.count("_d").over(w) == 2 * k + 1, F.min("_d").over(w)).otherwise(0))
    return df.withColumn(out, F.col("_d")).drop("_d")


def local_maxima(cells: DataFrame, col: str, size: int, above: Column, out: str) -> DataFrame:
    return grid.box(cells, col, size, F.max, "_m").withColumn(out, (F.col(col) >= F.col("_m")) & above).drop("_m")


def components(cells: DataFrame, mask: str, side: int) -> DataFrame:
    """r, c, label of the masked cells: eight-connected; a label is the smallest r * side + c of its component.

    Each round takes the least label of the 3 x 3 neighbourhood and then the label of the label's own cell, so the
    number of rounds grows with the logarithm of a component's length; each round's labels are checkpointed.
    """
    own = F.col("r") * side + F.col("c")
    df = durable(cells.select("r", "c", F.when(F.col(mask), own).alias("label")))
    while True:
        near = F.min("label").over(grid.along("x").rowsBetween(-1, 1))
        step = df.withColumn("_n", near).withColumn("_n", F.min("_n").over(grid.along("y").rowsBetween(-1, 1)))
        step = step.select("r", "c", "label", F.when(F.col("label").isNotNull(), F.col("_n")).alias("_n"))
        roots = step.where("label IS NOT NULL").select(own.alias("_id"), F.col("_n").alias("_up"))
        step = step.join(roots, F.col("_n") == F.col("_id"), "left")
        step = durable(step.select("r", "c", (F.col("_up") < F.col("label")).alias("_moved"), F.col("_up").alias("label")))
        if step.where("_moved").isEmpty():
            return step.where("label IS NOT NULL").select("r", "c", "label")
        df = step.select("r", "c", "label")


def component_stats(labelled: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """By label: size, bounding box, mean, the signed value of largest size (first in row order), quantiles."""
    j = labelled.join(values, ["r", "c"])
    peak = F.max_by(col, F.struct(F.abs(F.col(col)), -F.col("r"), -F.col("c")))
    return j.groupBy("label").agg(
        F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
        F.avg(col).alias("mean"), peak.alias("peak"), F.percentile(col, F.lit(0.82)).alias("q82"), F.percentile(col, F.lit(0.85)).alias("q85"),
    )


def resegment(cells: DataFrame, mask: str, core: str, most: int, side: int) -> DataFrame:
    """Components of the mask; if one has more than `most` cells, those of the core mask instead."""
    first = components(cells, mask, side)  # written already
    if first.groupBy("label").count().where(F.col("count") > most).isEmpty():
        return first
    return components(cells, core, side)


def descriptor(labelled: DataFrame, channels: DataFrame, names: list[str]) -> DataFrame:
    """By label: the 0.50, 0.80 and 0.92 quantiles of each channel, clipped to 0..1."""
    j = labelled.join(channels, ["r", "c"])
    qs = [F.percentile(stats.clip(F.col(c)), F.lit(q)).alias(f"{c}_{int(q * 100)}") for c in names for q in (0.5, 0.8, 0.92)]
    return j.groupBy("label").agg(*qs)


#: Highest penalty and distance of decay in metres, by kind of modern feature.
MODERN = {"building": (1.00, 8.0), "road": (0.98, 7.0), "track": (0.90, 5.0), "path": (0.55, 3.5), "boundary": (0.65, 3.0), "water": (0.88, 5.0)}


def modern_penalty(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """r, c, penalty: the largest weight * exp(-distance / decay) over the kinds marked at (r, c, kind).

    Exact Euclidean distances in two passes along the lines, at any distance: to the nearest mark in each column, then
    the lower envelope along each row. cells must fill a rectangle; marks outside it don't count.
    """
    known = list(MODERN)
    marked = marks.groupBy("r", "c").agg(*(F.max((F.col("kind") == k).cast("int")).alias(f"_m{i}") for i, k in enumerate(known)))
    df = cells.select("r", "c").join(marked, ["r", "c"], "left").na.fill(0)

    def down(line: pd.DataFrame) -> dict[str, np.ndarray]:
        out, rows = {}, line["r"].to_numpy(float)
        for i in range(len(known)):
            at = grid.nearest_along(line[f"_m{i}"].to_numpy() > 0)
            out[f"_g{i}"] = np.where(at < 0, np.nan, (rows[at] - rows) ** 2)
        return out

    def across(line: pd.DataFrame) -> dict[str, np.ndarray]:
        worst = np.zeros(len(line))
        for i, k in enumerate(known):
            g2 = line[f"_g{i}"].to_numpy(float)
            worst = np.maximum(worst, MODERN[k][0] * np.exp(-np.sqrt(grid.row_distances(np.where(np.isnan(g2), np.inf, g2))) / MODERN[k][1]))
        return {"penalty": worst}

    df = grid.by_lines(df, "y", [f"_g{i}" for i in range(len(known))], down)
    return grid.by_lines(df, "x", ["penalty"], across).select("r", "c", "penalty")


def hough(cells: DataFrame, mask: str, least: int, gap: int = 3, angles: int = 90) -> DataFrame:
    """Straight runs of masked cells: angle, rho, first and last place along the line, cells.

    A standard Hough transform: each cell votes for a line at every angle; along a line, a step longer than `gap` ends
    a run; runs of `least` cells or more are lines.
    """
    t = F.col("a") * (3.141592653589793 / angles)
    votes = cells.where(mask).select("r", "c", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("a"))
    votes = votes.select("a", F.rint(F.col("c") * F.cos(t) + F.col("r") * F.sin(t)).cast("long").alias("rho"), F.rint(-F.col("c") * F.sin(t) + F.col("r") * F.cos(t)).cast("long").alias("s"))
    w = W.partitionBy("a", "rho").orderBy("s")
    runs = votes.withColumn("_new", (F.col("s") - F.lag("s").over(w) > gap).cast("int")).withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    return runs.groupBy("a", "rho", "_run").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.count("*").alias("cells")).where(F.col("cells") >= least).drop("_run")


def straight(cells: DataFrame, mask: str, least: int, gap: int, reach: int, out: str, angles: int = 90) -> DataFrame:
    """cells with out (0/1): within `reach` of a masked cell that lies on a straight run of `least` cells' length (see hough())."""
    t = F.col("a") * (3.141592653589793 / angles)
    votes = cells.where(mask).select("r", "c", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("a"))
    votes = votes.select("r", "c", "a", F.rint(F.col("c") * F.cos(t) + F.col("r") * F.sin(t)).cast("long").alias("rho"), F.rint(-F.col("c") * F.sin(t) + F.col("r") * F.cos(t)).cast("long").alias("s"))
    w = W.partitionBy("a", "rho").orderBy("s")
    runs = votes.withColumn("_new", (F.col("s") - F.lag("s").over(w) > gap).cast("int")).withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    whole = W.partitionBy("a", "rho", "_run")
    runs = runs.withColumn("_long", F.max("s").over(whole) - F.min("s").over(whole) + 1).withColumn("_n", F.count("*").over(whole))
    found = runs.where((F.col("_long") >= least) & (2 * F.col("_n") >= F.col("_long"))).select("r", "c").distinct().withColumn("_on", F.lit(1))
    df = cells.join(found, ["r", "c"], "left").withColumn("_on", F.coalesce("_on", F.lit(0)))
    return dilate(df, "_on", 2 * reach + 1, out).drop("_on")


def components_of_boxes(boxes: DataFrame, pad: float, side: int) -> DataFrame:
    """r, c and the boxes' other columns: a row for each cell that a box (x0, y0, x1, y1; x along columns), widened by pad, touches."""

    def span(a: str, b: str) -> Column:
        lo, hi = F.greatest(F.lit(0), F.floor(F.col(a) - pad)), F.least(F.lit(side - 1), F.floor(F.col(b) + pad))
        return F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<long>"))

    others = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    return boxes.withColumn("r", F.explode(span("y0", "y1"))).withColumn("c", F.explode(span("x0", "x1"))).select("r", "c", *others)
