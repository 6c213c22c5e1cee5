"""Invariants on synthetic surfaces, and the scalar cases with known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import grid, stats
from terrasift.operators import learning, masks, terrain, vector


def raster(spark, z):
    h, w = z.shape
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(h) for c in range(w)], "r long, c long, v double")


def array(df, col, shape):
    out = np.full(shape, np.nan)
    for x in df.select("r", "c", col).collect():
        out[x["r"], x["c"]] = np.nan if x[col] is None else x[col]
    return out


YY, XX = np.mgrid[0:40, 0:40].astype(float)


def test_ramp_hillshade(spark):
    z = np.arange(100, dtype=float).reshape(10, 10)
    s = array(terrain.hillshade(raster(spark, z)), "shade", z.shape)
    assert s.min() >= 0 and s.max() <= 255 and np.isfinite(s).all()


def test_gauss_and_gradient_against_numpy(spark):
    z = np.random.default_rng(1).normal(size=(12, 9))
    k = dict(grid.gauss_kernel(1.0))

    def line(a):
        return sum(w * a[:, np.clip(np.arange(a.shape[1]) + o, 0, a.shape[1] - 1)] for o, w in k.items())

    want = line(line(z).T).T
    assert np.allclose(array(grid.gauss(raster(spark, z), "v", 1.0, "s"), "s", z.shape), want)
    gy, gx = np.gradient(z)
    got = terrain.slope(raster(spark, z))
    assert np.allclose(array(got, "gx", z.shape), gx) and np.allclose(array(got, "gy", z.shape), gy)


def test_ring_is_annular(spark):
    r = np.hypot(YY - 20, XX - 20)
    z = 2.5 * np.exp(-((r - 10) ** 2) / 4)
    a = array(terrain.annular(raster(spark, z)), "annular", z.shape)
    assert a[np.abs(r - 10) < 1].mean() > 2 * a[r > 18].mean()


def test_line_is_linear(spark):
    z = 0.015 * YY + np.where(np.abs(XX - 20) <= 1, 1.25, 0)
    a = array(terrain.linear(raster(spark, z), (3.0,)), "linear", z.shape)
    assert a[:, 18:23].max() > 0.5 > a[:, :10].max()


def test_components_against_flood_fill(spark):
    z = (np.random.default_rng(2).random((20, 20)) < 0.4).astype(float)
    got = {(x["r"], x["c"]): x["label"] for x in masks.components(raster(spark, z).withColumn("m", F.col("v") > 0), "m", 20).collect()}
    want, seen = {}, set()
    for r in range(20):
        for c in range(20):
            if z[r, c] and (r, c) not in seen:
                todo, group = [(r, c)], set()
                while todo:
                    p = todo.pop()
                    if p in group:
                        continue
                    group.add(p)
                    todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= p[0] + i < 20 and 0 <= p[1] + j < 20 and z[p[0] + i, p[1] + j]]
                seen |= group
                want |= dict.fromkeys(group, min(a * 20 + b for a, b in group))
    assert got == want


def test_fill_needs_a_value(spark):
    empty = spark.createDataFrame([(0, 0, None)], "r long, c long, v double")
    with pytest.raises(ValueError, match="no cell"):
        terrain.fill_nearest(empty)


def test_road_penalty(spark):
    cells = raster(spark, np.zeros((30, 30)))
    marks = cells.where("r = 15").select("r", "c", F.lit("road").alias("kind"))
    p = array(masks.modern_penalty(cells, marks), "penalty", (30, 30))
    assert p[15, 15] > 0.9 and p[0, 0] < 0.2 and p[14, 3] == pytest.approx(0.98 * math.exp(-1 / 7))


def test_hough_finds_the_row(spark):
    cells = raster(spark, np.zeros((30, 30))).withColumn("m", F.col("r") == 7)
    best = masks.hough(cells, "m", 25).orderBy(F.col("cells").desc()).first()
    assert best["cells"] == 30 and best["rho"] == 7


def test_profile_is_monotone(spark):
    from terrasift.plans.feature_queries import sensitivity_profile

    p = sensitivity_profile(spark, "").orderBy("level").toPandas()
    assert (p["min_area"].diff().dropna() < 0).all() and p["max_candidates"].iloc[-1] == 735


def test_scalar_cases(spark):
    one = spark.range(1)
    sq = one.select(vector.grid_square(F.lit(523915.55), F.lit(108829.39)).alias("a"), vector.grid_square(F.lit(-5.0), F.lit(1.0)).alias("b")).first()
    assert sq["a"] == "TQ" and sq["b"] is None
    s = one.select(vector.feature_scale(F.lit(4.0), F.lit(4.0), F.lit(16.0)).alias("a"), vector.feature_scale(F.lit(200.0), F.lit(200.0), F.lit(4e4)).alias("b")).first()
    assert (s["a"], s["b"]) == (32.0, 256.0)
    tiles = vector.tiles(spark.createDataFrame([(1, 0.0, 0.0, 2500.0, 1800.0)], "id long, x0 double, y0 double, x1 double, y1 double"), 1000)
    assert tiles.count() == 6 and tiles.agg(F.sum((F.col("tx1") - F.col("tx0")) * (F.col("ty1") - F.col("ty0")))).first()[0] == 2500 * 1800
    with pytest.raises(ValueError, match="positive"):
        vector.tiles(tiles, 0)


def test_isolation_finds_the_outlier(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(200)] + [(999, 60.0, -40.0)], "id long, a double, b double")
    assert learning.isolation(rows, ["id"], ["a", "b"], trees=30).orderBy(F.col("novelty").desc()).first()["id"] == 999


def test_patch_descriptor_is_finite(spark):
    z = np.exp(-((YY - 20) ** 2 + (XX - 20) ** 2) / 50)
    d = learning.patch_descriptors(raster(spark, z), spark.createDataFrame([(1, 20, 20)], "id long, r long, c long"), 8).first()["descriptor"]
    assert len(d) == 3072 and np.isfinite(d).all()


def test_no_cartesian_product(spark, data):
    from terrasift.plans.feature_queries import bbox_intersects

    plan = bbox_intersects(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_constant_surface_has_no_relief(spark):
    z = np.full((8, 8), 3.0)
    assert array(stats.robust_unit(raster(spark, z), "v", "u"), "u", z.shape).max() == 0


def test_shapes():
    from terrasift.operators import shapes

    square = np.array([(0, 0), (4, 0), (4, 2), (0, 2), (2, 1)], float)
    turn = np.array([(np.cos(0.5), np.sin(0.5)), (-np.sin(0.5), np.cos(0.5))])
    assert len(shapes.hull(square)) == 4
    long, short, direction = shapes.smallest_rectangle(square @ turn)
    assert (long, short) == (pytest.approx(4), pytest.approx(2)) and direction == pytest.approx(math.degrees(0.5))
    u = np.array([(0, 0), (6, 0), (6, 6), (5, 6), (5, 1), (1, 1), (1, 6), (0, 6)], float)
    x, y = shapes.representative(u)
    assert y == 3 and (0 < x < 1 or 5 < x < 6)


def test_shape_columns(spark, data):
    from terrasift.plans.shape_queries import shape_metrics

    s = shape_metrics(spark, data).toPandas()
    assert np.allclose(s["hull_area"], s["w"] * s["h"]) and np.allclose(s["long"], s[["w", "h"]].max(axis=1))
