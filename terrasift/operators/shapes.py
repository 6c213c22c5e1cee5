"""Shapes of point sets and rings: what SQL can't express runs in Arrow batches, a ring a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, anticlockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Long side, short side and the long side's direction (degrees, 0 to 180) of the rectangle of least area: it lies along a side of the hull."""
    h = hull(points)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    best = (np.inf, 0.0, 0.0, 0.0)
    for side in np.roll(h, -1, axis=0) - h:
        u = side / np.hypot(*side)
        a, b = np.ptp(h @ u), np.ptp(h @ np.array([-u[1], u[0]]))
        along = np.degrees(np.arctan2(u[1], u[0])) % 180
        if a * b < best[0] - 1e-12:
            best = (a * b, max(a, b), min(a, b), float(along if a >= b else (along + 90) % 180))
    return best[1:]


def representative(ring: np.ndarray) -> tuple[float, float]:
    """A point inside a ring: the middle of the widest stretch inside, half way up."""
    y = (ring[:, 1].min() + ring[:, 1].max()) / 2
    a, b = ring, np.roll(ring, -1, axis=0)
    cross = (a[:, 1] <= y) != (b[:, 1] <= y)
    xs = np.sort(a[cross, 0] + (y - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1]))
    if len(xs) < 2:
        return float(ring[:, 0].mean()), float(y)
    wide = (xs[1::2] - xs[::2]).argmax()
    return float((xs[2 * wide] + xs[2 * wide + 1]) / 2), float(y)


def shapes(rows: DataFrame, xs: str, ys: str) -> DataFrame:
    """rows with shape: hull area, sides and direction of the smallest rectangle, a point inside, of the ring (xs, ys)."""
    ship(rows.sparkSession)

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(x, y, strict=True):
            ring = np.column_stack([np.asarray(a, float), np.asarray(b, float)])
            h = hull(ring)
            area = abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2 if len(h) > 2 else 0.0
            out.append((area, *smallest_rectangle(ring), *representative(ring)))
        return pd.DataFrame(out, columns=["hull_area", "long", "short", "direction", "px", "py"])

    measure = F.pandas_udf(run, "hull_area double, long double, short double, direction double, px double, py double", F.PandasUDFType.SCALAR)
    return rows.withColumn("shape", measure(xs, ys))


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed area of a ring (first point not repeated); a column of built-in functions."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2


def inside(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies in a ring, by the crossings of a ray; a column of built-in functions."""
    n = F.size(xs)

    def crosses(i: Column) -> Column:
        j = (i + 1) % n
        ax, ay, bx, by = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        at = ax + (y - ay) * (bx - ax) / F.when(by != ay, by - ay)
        return F.when(((ay > y) != (by > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def outline(labelled: DataFrame) -> DataFrame:
    """label, cells, edges: the exposed edges of each component's cells, which are its outline's length in cells."""
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))))
    sides = labelled.withColumn("s", step).select("label", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
    shared = sides.join(labelled, ["label", "r", "c"]).groupBy("label").agg(F.count("*").alias("_shared"))
    whole = labelled.groupBy("label").agg(F.count("*").alias("cells"))
    return whole.join(shared, "label", "left").select("label", "cells", (4 * F.col("cells") - F.coalesce("_shared", F.lit(0))).alias("edges"))
