"""The detector on a made-up landscape, its parts by hand-worked cases, and the statistics that scale."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import grid, stats
from terrasift.operators import learning, masks, terrain, vector
from terrasift.plans import detect

N = 64


def frame(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "r long, c long, v double")


@pytest.fixture(scope="module")
def land():
    y, x = np.mgrid[:N, :N].astype(float)
    rng = np.random.default_rng(4)
    z = 0.02 * x + 0.01 * y + 0.01 * rng.standard_normal((N, N))
    z += 1.2 * np.exp(-((x - 14) ** 2 + (y - 14) ** 2) / 12)  # a mound
    z += 0.8 * np.exp(-((np.hypot(x - 46, y - 16) - 8) ** 2) / 1.5)  # a ring
    z += 0.7 * np.exp(-((y - 48) ** 2) / 1.5) * (x > 4) * (x < 60)  # a bank
    z[40, 3] = np.nan
    return z


@pytest.fixture(scope="module")
def found(spark, land):
    mapped = spark.createDataFrame([("m1", "Bank", 9.0, 9.0, 19.0, 19.0)], "uid string, label string, x0 double, y0 double, x1 double, y1 double")
    modern = spark.createDataFrame([(r, c, "building") for r in range(58, 63) for c in range(2, 6)], "r long, c long, kind string")
    return detect.detect(frame(spark, land), N, features=mapped, modern=modern).toPandas()


def test_bank_and_ring_are_found_and_ranked(found):
    assert len(found) and (found["score"].diff().dropna() <= 0).all() and list(found["rank"]) == list(range(1, len(found) + 1))
    assert found["score"].between(0, 100).all() and found["area"].between(detect.Level(5).least_area, detect.Level(5).most_area).all()
    holds = lambda r, c: found[(found["r0"] <= r) & (found["r1"] >= r) & (found["c0"] <= c) & (found["c1"] >= c)]
    assert len(holds(48, 30)) and holds(48, 30)["elongation"].max() > 3 and holds(48, 30)["linear"].max() > 0.1
    assert len(holds(16, 54)) or len(holds(24, 46))


def test_mapped_features_are_excluded_and_compared_with(found):
    inside = (found["r0"] >= 9) & (found["r1"] <= 19) & (found["c0"] >= 9) & (found["c1"] <= 19)
    assert not inside.any()
    assert (found["match"] == "m1").all() and (found["label"] == "Bank").all() and found["similarity"].between(0, 1).all() and (found["similarity"] > 0).all()


def test_evidence_is_bounded_and_explained(found):
    for c in ("lidar", "persistence", "linear", "annular", "ridge", "novelty", "texture", "penalty", "morphology"):
        assert found[c].between(0, 1).all(), c
    assert set(found["polarity"]) <= {"positive", "negative"} and set(found["scale"]) <= set(terrain.relief_scales(5))
    assert found["penalty"].max() > 0 and all(len(x) for x in found["reasons"].head(3))


def test_shapes_of_cells():
    y, x = np.mgrid[:21, :21]
    d = np.hypot(x - 10, y - 10)
    ring = detect.shape_of(*np.nonzero((d > 6) & (d < 9)))
    disc = detect.shape_of(*np.nonzero(d < 9))
    line = detect.shape_of(np.full(30, 4), np.arange(30))
    assert ring["holes"] == 1 and disc["holes"] == 0 and disc["convexity"] > 0.9 > ring["convexity"]
    assert line["elongation"] == pytest.approx(30) and line["perimeter"] == 62 and line["rectangularity"] == pytest.approx(1) and line["direction"] == pytest.approx(0)
    assert detect.shape_of(np.array([3]), np.array([5]))["area"] == 1


def test_levels_widen():
    a, b = detect.Level(1), detect.Level(10)
    assert (a.threshold, a.least_area, a.most, b.most) == (99.7, 22.0, 105, 735) and b.threshold < a.threshold and b.line < a.line
    assert [len(terrain.relief_scales(k)) for k in (1, 5, 10)] == [6, 8, 10] and terrain.line_scales(5) == (3.0, 5.0, 8.0, 12.0, 20.0) and terrain.pattern_scales(5) == (3.0, 6.0, 12.0, 24.0)


def test_exact_quantiles_without_one_task(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal(3000), np.full(500, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(x), float(i % 7), None) for i, x in enumerate(v)], "a double, b double, n double")
    qs = (0.0, 0.01, 0.5, 0.9, 0.997, 1.0)
    got = stats.quantiles(df, {f"{c}{q}": (c, q) for c in "ab" for q in qs} | {"n": ("n", 0.5)}, few=5)
    for q in qs:
        assert got[f"a{q}"] == pytest.approx(np.quantile(v, q)) and got[f"b{q}"] == pytest.approx(np.quantile(np.arange(len(v)) % 7, q))
    assert got["n"] is None
    big = stats.with_quantiles(df, {"m": ("a", 0.5)}, exact=10).select("m").first()["m"]
    assert big == pytest.approx(np.median(v))


def test_distances_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        g2 = np.where(rng.random(n) < 0.5, np.inf, rng.integers(0, 40, n).astype(float) ** 2)
        x = np.arange(n)
        want = ((x[:, None] - x[None]) ** 2 + g2[None]).min(axis=1)
        assert np.array_equal(grid.row_distances(g2), want)
    assert list(grid.nearest_along(np.array([False, True, False, False, True, False]))) == [1, 1, 1, 4, 4, 4]
    assert list(grid.nearest_along(np.zeros(3, bool))) == [-1, -1, -1]


def test_a_wide_hole_is_filled(spark):
    z = np.full((30, 30), np.nan)
    z[0, 0], z[29, 29] = 1.0, 2.0
    got = {(r["r"], r["c"]): r["v"] for r in terrain.fill_nearest(frame(spark, z)).collect()}
    assert got[5, 5] == 1.0 and got[20, 20] == 2.0 and got[0, 29] == 1.0  # as far from both: the first in row order


def test_penalty_has_no_reach(spark):
    cells = frame(spark, np.zeros((1, 200)))
    p = masks.modern_penalty(cells, spark.createDataFrame([(0, 0, "building")], "r long, c long, kind string"))
    assert p.where("c = 150").first()["penalty"] == pytest.approx(math.exp(-150 / 8))


def test_moments_by_hand(spark):
    z = np.zeros((3, 3))
    z[1, 0] = z[1, 2] = 1 - 1e-3
    m = learning.moments(frame(spark, z)).first()
    w = np.full((3, 3), 1e-3)
    w[1, 0] = w[1, 2] = 1.0
    y, x = np.mgrid[:3, :3] - 1.0
    xx, yy = (w * x * x).sum() / w.sum(), (w * y * y).sum() / w.sum()
    assert (m["minor"], m["major"]) == (pytest.approx(yy), pytest.approx(xx)) and m["ratio"] == pytest.approx(xx / yy)
    assert m["skew"] == pytest.approx(0, abs=1e-12) and m["kurtosis"] == pytest.approx((((x**4 + y**4) * w).mean()) / w.sum()) and m["weight"] == pytest.approx(w.mean())


def test_only_buildings_are_polygons(spark):
    from terrasift.sources import features as src

    ring = [(0, 0), (1, 0), (1, 1), (0, 0)]
    rows = [(1, ring, False), (2, ring, True), (3, ring[:3], True), (4, ring[:2], True), (5, ring[:1], True)]  # 1: a closed hedge
    df = spark.createDataFrame(rows, "id long, p array<struct<x:int,y:int>>, b boolean")
    assert [r["k"] for r in df.select("id", src.way_kind(F.col("p"), F.col("b")).alias("k")).orderBy("id").collect()] == ["line", "polygon", "polygon", "line", None]


def test_similarity_in_blocks_and_with_shapes(spark):
    rng = np.random.default_rng(6)
    x, f = rng.random((40, 3)), rng.random((40, 6))
    names, shape = ["a", "b", "c"], [f"s{i}" for i in range(6)]
    rows = spark.createDataFrame([(i, *map(float, x[i]), *map(float, f[i])) for i in range(10)], "id long, a double, b double, c double, " + ", ".join(f"{s} double" for s in shape))
    bank = spark.createDataFrame([(i, "k", *map(float, x[i]), *map(float, f[i])) for i in range(10, 40)], "uid long, label string, a double, b double, c double, " + ", ".join(f"{s} double" for s in shape))
    scale = np.maximum(1.4826 * np.median(np.abs(x[10:] - np.median(x[10:], axis=0)), axis=0), 0.25)
    d = 0.88 * np.sqrt((((x[:10, None] - x[None, 10:]) / scale) ** 2).mean(axis=2)) + 0.12 * np.sqrt((((f[:10, None] - f[None, 10:]) / np.array(vector.SHAPE_SCALES)) ** 2).mean(axis=2))
    for block in (1000, 7):
        got = sorted((r["id"], r["match"], r["similarity"]) for r in vector.similarity(rows, bank, names, shape=shape, block=block).collect())
        assert [(i, m) for i, m, _ in got] == [(i, 10 + int(d[i].argmin())) for i in range(10)] and np.allclose([s for *_, s in got], np.exp(-2 * d.min(axis=1)))


def test_leaving_one_out_of_any_number_of_references(spark):
    rng = np.random.default_rng(7)
    for uids in (np.arange(31), np.arange(30), np.array([0, 1, 1, 1, 2, 3, 3, 4, 5]), np.array([0, 1]), np.array([3])):
        x = rng.integers(0, 6, (len(uids), 3)) * 0.7
        bank = spark.createDataFrame([(i, int(u), "k", *map(float, x[i])) for i, u in enumerate(uids)], "id long, uid long, label string, a double, b double, c double")
        want = []
        for i, u in enumerate(uids):
            r, left = x[uids != u], uids[uids != u]
            if len(r):
                scale = np.maximum(1.4826 * np.median(np.abs(r - np.median(r, axis=0)), axis=0), 0.25) if len(r) > 1 else 1.0
                d = 0.88 * np.sqrt((((r - x[i]) / scale) ** 2).mean(axis=1))
                want.append((i, int(left[d == d.min()].min()), np.exp(-2 * d.min())))
        got = sorted((r["id"], r["match"], r["similarity"]) for r in vector.similarity(bank, bank, ["a", "b", "c"], leave_out=True, block=7).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
