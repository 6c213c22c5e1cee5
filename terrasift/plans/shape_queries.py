"""Registered queries over shapes and training examples, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning, masks, shapes, vector
from . import feature_queries as fq
from . import terrain_queries as tq

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add



@query(
    f"""WITH p AS (SELECT o_orderkey AS id, (o_orderkey % 100)::DOUBLE + 0.37 AS x, (o_custkey % 100)::DOUBLE + 0.21 AS y, (o_orderkey % 90)::DOUBLE AS ax, (o_custkey % 90)::DOUBLE AS ay, (o_orderkey % 90 + 30)::DOUBLE AS bx, (o_custkey % 90 + 5)::DOUBLE AS by_, (o_orderkey % 90 + 8)::DOUBLE AS cx, (o_custkey % 90 + 25)::DOUBLE AS cy FROM orders),
s AS (SELECT id, ((x - bx) * (ay - by_) - (ax - bx) * (y - by_)) AS s1, ((x - cx) * (by_ - cy) - (bx - cx) * (y - cy)) AS s2, ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) AS s3, abs((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay)) / 2 AS area FROM p)
SELECT id, (s1 > 0 AND s2 > 0 AND s3 > 0) OR (s1 < 0 AND s2 < 0 AND s3 < 0) AS inside, round(area, 6) AS area FROM s"""
)
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Points against triangles."""
    o = fq.t(spark, d, "orders")
    a, b = (F.col("o_orderkey") % 90).cast("double"), (F.col("o_custkey") % 90).cast("double")
    o = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100 + 0.37).alias("x"), (F.col("o_custkey") % 100 + 0.21).alias("y"), F.array(a, a + 30, a + 8).alias("xs"), F.array(b, b + 5, b + 25).alias("ys"))
    return o.select("id", shapes.inside(F.col("xs"), F.col("ys"), F.col("x"), F.col("y")).alias("inside"), F.round(F.abs(shapes.ring_area(F.col("xs"), F.col("ys"))), 6).alias("area"))


@query(
    tq.recursive(tq.G, tq.CH, tq.MASK, tq.LABELS)
    + "SELECT a.label, count(DISTINCT a.r * 32 + a.c) AS cells, 4 * count(DISTINCT a.r * 32 + a.c) - count(b.r) AS edges FROM lab a LEFT JOIN lab b ON b.label = a.label AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.label"
)
def component_outline(spark: SparkSession, d: str) -> DataFrame:
    return shapes.outline(masks.components(tq.masked(spark, d), "k", tq.SIDE))


@query()
def shape_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hull, smallest rectangle and a point inside, of boxes turned by an angle."""
    f = fq.features(spark, d)
    turn = F.radians(F.col("id") % 180)
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    xs = F.array(*(F.col("w") * i * F.cos(turn) - F.col("h") * j * F.sin(turn) for i, j in corners))
    ys = F.array(*(F.col("w") * i * F.sin(turn) + F.col("h") * j * F.cos(turn) for i, j in corners))
    return shapes.shapes(f.select("id", "w", "h", xs.alias("xs"), ys.alias("ys")), "xs", "ys").select("id", "w", "h", "shape.*")


BASE = "least(256, greatest(32, 2.5 * greatest(w * 8, h * 8, 2 * sqrt(w * h * 64 / pi()))))"


@query(f"WITH {fq.FE}, s AS (SELECT DISTINCT id, least(256, greatest(32, {BASE} * f)) AS scale FROM fe, (VALUES (0.75::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) v(f) WHERE p_size <= 10) SELECT id, round(scale, 6) AS scale, r.range * 45.0::DOUBLE AS rotation FROM s, range(8) r")
def dataset_builder(spark: SparkSession, d: str) -> DataFrame:
    f = fq.features(spark, d).where("p_size <= 10")
    base = vector.feature_scale(F.col("w") * 8, F.col("h") * 8, F.col("w") * F.col("h") * 64)
    return learning.examples(f, base).select("id", F.round("scale", 6).alias("scale"), "rotation")


def sql_unit(tag: str) -> str:
    return f"(CAST(('0x' || substr(md5('n{tag}-' || id || '-' || k), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(
    f"""WITH {fq.FE}, tl AS (SELECT i.range * 4 + j.range AS id, i.range * 25.0::DOUBLE AS x0, j.range * 15.0::DOUBLE AS y0 FROM range(4) i, range(4) j), c AS (SELECT id, k.range AS k, x0, y0 FROM tl, range(300) k),
q AS (SELECT id, k, x0 + {sql_unit('x')} * 25 AS x, y0 + {sql_unit('y')} * 15 AS y FROM c), free AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM fe WHERE p_size <= 4 AND x BETWEEN fe.x0 - 1 AND fe.x1 + 1 AND y BETWEEN fe.y0 - 1 AND fe.y1 + 1))
SELECT id, k, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM free) WHERE n <= 10"""
)
def negative_samples(spark: SparkSession, d: str) -> DataFrame:
    tiles = spark.range(16).select("id", (F.floor(F.col("id") / 4) * 25.0).alias("x0"), (F.col("id") % 4 * 15.0).alias("y0"))
    tiles = tiles.withColumn("x1", F.col("x0") + 25).withColumn("y1", F.col("y0") + 15)
    out = learning.negatives(tiles, fq.features(spark, d).where("p_size <= 4"), 10, 1.0)
    return out.select("id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
