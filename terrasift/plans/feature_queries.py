"""Registered queries over vector features, the catalogue and learning, each with the SQL of the same result.

Parts are features: a box at (p_partkey % 100, p_size), 1 + p_partkey % 7 wide and 1 + p_size % 5 high; those with
p_size <= 10 are the known ones. Orders are points at (o_orderkey % 100, o_custkey % 100).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, stats
from ..operators import catalog, learning, vector
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


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def features(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    x0, y0 = (F.col("p_partkey") % 100).cast("double"), F.col("p_size").cast("double")
    w, h = (1 + F.col("p_partkey") % 7).cast("double"), (1 + F.col("p_size") % 5).cast("double")
    return p.select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size", x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"), w.alias("w"), h.alias("h"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).cast("double").alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"))


FE = """fe AS (SELECT p_partkey AS id, p_name, p_type, p_size, (p_partkey % 100)::DOUBLE AS x0, p_size::DOUBLE AS y0, (p_partkey % 100 + 1 + p_partkey % 7)::DOUBLE AS x1, (p_size + 1 + p_size % 5)::DOUBLE AS y1,
(1 + p_partkey % 7)::DOUBLE AS w, (1 + p_size % 5)::DOUBLE AS h FROM part)"""
PT = "pt AS (SELECT o_orderkey AS id, (o_orderkey % 100)::DOUBLE AS x, (o_custkey % 100)::DOUBLE AS y FROM orders)"
BOX = ["x0", "y0", "x1", "y1"]
TOUCH = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"


def cases(text: str, rules) -> str:  # noqa: ANN001
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in rules) + " END"


NORM = "trim(regexp_replace(translate(lower(coalesce({0}, '')), '_-', '  '), '\\s+', ' ', 'g'))"
#: Words for the part types, so that classes occur.
WORD_SQL = "CASE p_partkey % 8 WHEN 0 THEN 'Old_Building' WHEN 1 THEN 'foot-path' WHEN 2 THEN 'farm track' WHEN 3 THEN 'Main Road' WHEN 4 THEN 'stone  wall' WHEN 5 THEN 'bridleway' WHEN 6 THEN p_type ELSE NULL END"


@query(f"SELECT p_partkey AS id, {cases(NORM.format(f'(p_name || chr(32) || coalesce({WORD_SQL}, chr(32)))'), vector.OS_CLASSES)} AS class FROM part")
def os_classify(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), vector.os_class(F.col("p_name"), F.expr(WORD_SQL)).alias("class"))


TAGS = "CASE WHEN p_partkey % 11 = 0 THEN 'yes' END AS building, CASE p_partkey % 5 WHEN 1 THEN 'fence' WHEN 2 THEN 'gate' END AS barrier, CASE WHEN p_partkey % 13 = 4 THEN 'hedge' END AS natural_, CASE p_partkey % 9 WHEN 0 THEN 'Footway' WHEN 1 THEN 'track' WHEN 2 THEN 'primary' WHEN 3 THEN 'corridor' WHEN 4 THEN 'living_street' END AS highway"


@query(
    f"""WITH g AS (SELECT p_partkey AS id, {TAGS} FROM part) SELECT id, CASE WHEN building IS NOT NULL THEN 'building' WHEN barrier IN {vector.BARRIERS} OR natural_ = 'hedge' THEN 'boundary'
WHEN lower(highway) IN {vector.PATHS} THEN 'path' WHEN lower(highway) = 'track' THEN 'track' WHEN lower(highway) IN {vector.ROADS} THEN 'road' END AS class FROM g"""
)
def osm_classify(spark: SparkSession, d: str) -> DataFrame:
    tags = t(spark, d, "part").selectExpr("p_partkey AS id", *TAGS.split(", "))
    return tags.select("id", vector.osm_class(F.col("building"), F.col("barrier"), F.col("natural_"), F.col("highway")).alias("class"))


LAYER = "CASE p_partkey % 7 WHEN 0 THEN 'BANK' WHEN 1 THEN 'Scarp_Slope_Edge' WHEN 2 THEN 'Extent of  feature' WHEN 3 THEN 'nonsense' END"
KIND = "CASE p_partkey % 6 WHEN 0 THEN 'Hollow Way' WHEN 1 THEN 'BARROW' WHEN 2 THEN 'ridge and furrow' WHEN 3 THEN 'Military camp' WHEN 4 THEN 'scarp' END"


@query(
    f"SELECT p_partkey AS id, coalesce(CASE {NORM.format(LAYER)} " + " ".join(f"WHEN '{a}' THEN '{vector.COLOURS[b]}'" for a, b in vector.ALIASES.items()) + " END, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains({NORM.format(KIND)}, '{w}')" for w in ws) + f" THEN '{vector.COLOURS[n]}'" for n, ws in vector.SEMANTIC[:2])
    + f" WHEN contains({NORM.format(KIND)}, 'ridge') AND contains({NORM.format(KIND)}, 'furrow') THEN '{vector.COLOURS['Ridge and Furrow Area']}' "
    + " ".join("WHEN " + " OR ".join(f"contains({NORM.format(KIND)}, '{w}')" for w in ws) + f" THEN '{vector.COLOURS[n]}'" for n, ws in vector.SEMANTIC[2:]) + f" END, '{vector.DEFAULT_COLOUR}') AS colour FROM part"
)
def layer_style(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), vector.style(F.expr(LAYER), F.expr(KIND)).alias("colour"))


@query(f"SELECT p_partkey AS id, {NORM.format('(p_name || chr(95) || chr(45) || p_type)')} AS name FROM part")
def normalise_name(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), vector.normalise(F.concat("p_name", F.lit("_-"), "p_type")).alias("name"))


EMPTY = ("CASE p_partkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_brand END", "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END")


@query(f"SELECT p_partkey AS id, coalesce(nullif(nullif(trim({EMPTY[0]}), ''), '-'), nullif(nullif(trim({EMPTY[1]}), ''), '-'), 'feature-' || p_partkey) AS uid FROM part")
def feature_uid(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), vector.first_non_empty(F.expr(EMPTY[0]), F.expr(EMPTY[1]), F.concat(F.lit("feature-"), F.col("p_partkey"))).alias("uid"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long")
    return t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), links.alias("links"))


@query("SELECT p_partkey AS id, sha256(concat_ws('|', p_partkey % 100, p_size, p_name)) AS hash FROM part")
def geometry_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sha2(F.concat_ws("|", F.col("p_partkey") % 100, "p_size", "p_name"), 256).alias("hash"))


@query(f"""WITH s(n, row) AS (VALUES {", ".join(f"({i}, '{' '.join(s)}')" for i, s in enumerate(vector.SQUARES))}), o AS (SELECT o_orderkey AS id, (o_orderkey * 7919) % 700000 AS e, (o_custkey * 104729) % 1400000 AS n FROM orders)
SELECT id, split_part(s.row, ' ', CAST(e // 100000 + 1 AS INT)) AS square FROM o LEFT JOIN s ON s.n = o.n // 100000""")
def grid_square(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919) % 700000).alias("e"), ((F.col("o_custkey") * 104729) % 1400000).alias("n"))
    return o.select("id", vector.grid_square(F.col("e"), F.col("n")).alias("square"))


LONLAT = "(o_orderkey % 3600) / 10.0::DOUBLE - 180 AS lon, (o_custkey % 1700) / 10.0::DOUBLE - 85 AS lat"


@query(f"""WITH o AS (SELECT o_orderkey AS id, {LONLAT} FROM orders) SELECT id, CAST(least(greatest(floor((lon + 180) / 360 * 65536), 0), 65535) AS BIGINT) AS x,
CAST(least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536), 0), 65535) AS BIGINT) AS y FROM o""")
def mercator_tile(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").selectExpr("o_orderkey AS id", "(o_orderkey % 3600) / 10.0D - 180 AS lon", "(o_custkey % 1700) / 10.0D - 85 AS lat")
    return o.select("id", vector.tile_x(F.col("lon"), 16).alias("x"), vector.tile_y(F.col("lat"), 16).alias("y"))


@query(f"""WITH {FE}, n AS (SELECT *, greatest(1, CAST(ceil((x1 - x0 - 1e-9) / 2.5) AS INT)) AS nx, greatest(1, CAST(ceil((y1 - y0 - 1e-9) / 2.5) AS INT)) AS ny FROM fe)
SELECT id, i.range AS i, j.range AS j, x0 + i.range * 2.5::DOUBLE AS tx0, y0 + j.range * 2.5::DOUBLE AS ty0, least(x0 + i.range * 2.5::DOUBLE + 2.5::DOUBLE, x1) AS tx1, least(y0 + j.range * 2.5::DOUBLE + 2.5::DOUBLE, y1) AS ty1
FROM n JOIN range(8) i ON i.range < nx JOIN range(8) j ON j.range < ny""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return vector.tiles(features(spark, d), 2.5)


@query(f"WITH {FE} SELECT id, round(least(256, greatest(32, 2.5 * greatest(w * 8, h * 8, 2 * sqrt(w * h * 64 / pi())))), 6) AS scale FROM fe")
def feature_scale(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("id", F.round(vector.feature_scale(F.col("w") * 8, F.col("h") * 8, F.col("w") * F.col("h") * 64), 6).alias("scale"))


@query(f"WITH {FE} SELECT b.id, count(*) AS n, min(a.id) AS first FROM fe a JOIN fe b ON {TOUCH} AND a.p_size <= 10 GROUP BY b.id")
def bbox_intersects(spark: SparkSession, d: str) -> DataFrame:
    """Equal boxes are met once; each class of them counts its copies."""
    f = features(spark, d).select("id", *BOX, "p_size")
    known, whole = vector.box_classes(f.where("p_size <= 10").drop("p_size")), vector.box_classes(f.drop("p_size"))
    pairs = vector.overlapping(known, whole.drop("copies"), 8.0)
    found = pairs.groupBy(*(F.col(f"r_{c}").alias(c) for c in BOX)).agg(F.sum("l_copies").alias("n"), F.min("l_id").alias("first"))
    return f.join(found, BOX).groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@query("WITH " + tq.G + f", {FE} SELECT id, count(*) AS cells, round(avg(g.v), 6) AS mean, max(g.v)::DOUBLE AS top FROM fe JOIN g ON g.c >= x0 AND g.c < x1 AND g.r >= y0 AND g.r < y1 GROUP BY id")
def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    cells = features(spark, d).where("x0 < 32 AND y0 < 32")
    span = lambda a, b: F.explode(F.sequence(F.ceil(F.col(a)), F.ceil(F.col(b)) - 1))
    cells = cells.withColumn("c", span("x0", "x1")).withColumn("r", span("y0", "y1")).select("id", "r", "c")
    return cells.join(grid.surface(spark, d), ["r", "c"]).groupBy("id").agg(F.count("*").alias("cells"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("top"))


@query(f"WITH {FE}, {PT} SELECT id FROM pt WHERE NOT EXISTS (SELECT 1 FROM fe WHERE p_size <= 10 AND x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2)")
def point_in_forbidden_anti(spark: SparkSession, d: str) -> DataFrame:
    return vector.clear_of(points(spark, d), features(spark, d).where("p_size <= 10"), 8.0, pad=2.0)


ANGLE = "({0}.id * 37) % 180"
GAP = "sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2))"
DIFF = f"abs({ANGLE.format('a')} - {ANGLE.format('b')}) % 180"


@query(f"WITH {FE} SELECT id FROM fe a WHERE greatest(w, h) / least(w, h) < 5 OR NOT EXISTS (SELECT 1 FROM fe b WHERE b.p_size <= 3 AND b.id <> a.id AND {GAP} <= 3 AND least({DIFF}, 180 - {DIFF}) <= 18)")
def near_parallel_anti(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).select("id", "x0", "y0", "x1", "y1", "w", "h", "p_size", ((F.col("id") * 37) % 180).alias("angle"))
    long = f.where(F.greatest("w", "h") / F.least("w", "h") >= 5)
    pairs = vector.overlapping(long.select("id", "angle", "x0", "y0", "x1", "y1"), f.where("p_size <= 3").select("id", "angle", "x0", "y0", "x1", "y1"), 8.0, pad=3.0)
    dx = F.greatest(F.lit(0), F.col("l_x0") + 3 - F.col("r_x1"), F.col("r_x0") - F.col("l_x1") + 3)
    dy = F.greatest(F.lit(0), F.col("l_y0") + 3 - F.col("r_y1"), F.col("r_y0") - F.col("l_y1") + 3)
    hit = pairs.where((F.hypot(dx, dy) <= 3) & (F.col("l_id") != F.col("r_id")) & (vector.angle_between(F.col("l_angle"), F.col("r_angle")) <= 18))
    return f.select("id").join(hit.select(F.col("l_id").alias("id")), "id", "left_anti")


@query(
    f"""WITH {FE}, {PT}, n AS (SELECT pt.id, p_name AS name, fe.id AS key, 500 - sqrt((x - x0) ** 2 + (y - y0) ** 2) * 10 - CASE WHEN length(p_name) > 20 THEN 15 ELSE 0 END AS s FROM pt JOIN fe ON fe.p_size <= 10 AND sqrt((x - x0) ** 2 + (y - y0) ** 2) <= 6)
SELECT id, name, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, key) AS k FROM n) WHERE k = 1"""
)
def nearest_named(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).where("p_size <= 10").select(F.col("id").alias("key"), F.col("p_name").alias("name"), F.when(F.length("p_name") > 20, 15).otherwise(0).alias("long"), F.col("x0").alias("fx"), F.col("y0").alias("fy"))
    score = 500 - F.col("dist") * 10 - F.col("long")
    return vector.best_named(points(spark, d), f, 6.0, score).select("id", "name", F.round("score", 6).alias("score"))


AREA = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(
    f"""WITH {FE}, p AS (SELECT a.id AS known, b.id AS other, least(1, greatest({AREA} / (a.w * a.h), {AREA} / (b.w * b.h))) AS o FROM fe a JOIN fe b ON a.p_size <= 10 AND b.p_size > 10 AND {TOUCH}),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY known ORDER BY o DESC, other) AS k FROM p WHERE o > 0) WHERE k = 1)
SELECT fe.id, m.other AS best, round(coalesce(m.o, 0), 6) AS overlap, coalesce(m.o, 0) >= 0.18 AS detected FROM fe LEFT JOIN m ON m.known = fe.id WHERE fe.p_size <= 10"""
)
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Equal boxes are met once; of a class the smallest id is the best."""
    f = features(spark, d).select("id", *BOX, (F.col("w") * F.col("h")).alias("area"), "p_size")
    known = f.where("p_size <= 10").drop("p_size")
    pairs = vector.overlapping(vector.box_classes(known), vector.box_classes(f.where("p_size > 10").drop("p_size")), 8.0)
    o = F.least(F.lit(1.0), F.greatest(vector.overlap_area() / F.col("l_area"), vector.overlap_area() / F.col("r_area")))
    each = pairs.withColumn("o", o).where("o > 0").groupBy(*(F.col(f"l_{c}").alias(c) for c in BOX)).agg(F.max(F.struct("o", (-F.col("r_id")).alias("k"))).alias("b"))
    best = known.join(each, BOX).groupBy("id").agg(F.max("b").alias("b"))
    out = known.select("id").join(best, "id", "left").select("id", (-F.col("b.k")).alias("best"), F.coalesce(F.col("b.o"), F.lit(0.0)).alias("o"))
    return out.select("id", "best", F.round("o", 6).alias("overlap"), (F.col("o") >= 0.18).alias("detected"))


@query(f"WITH v AS (SELECT *, coalesce(o >= 0.18, false) AS hit, (id * 13) % 100 / 100.0::DOUBLE >= {max(0.25, 0.47 - 0.018 * 5)} AS evident FROM (WITH {FE}, p AS (SELECT a.id AS known, max(least(1, greatest({AREA} / (a.w * a.h), {AREA} / (b.w * b.h)))) AS o FROM fe a JOIN fe b ON a.p_size <= 10 AND b.p_size > 10 AND {TOUCH} GROUP BY 1) SELECT fe.id, p.o FROM fe LEFT JOIN p ON p.known = fe.id WHERE fe.p_size <= 10)) SELECT count(*) AS known, CAST(sum(hit::INT) AS BIGINT) AS hits, CAST(sum((hit AND evident)::INT) AS BIGINT) AS validated, round(100.0::DOUBLE * sum((hit AND evident)::INT) / count(*), 6) AS recall FROM v")
def validation_recall(spark: SparkSession, d: str) -> DataFrame:
    v = best_overlap(spark, d).withColumn("evident", (F.col("id") * 13) % 100 / 100 >= max(0.25, 0.47 - 0.018 * 5))
    ok = F.count_if(F.col("detected") & F.col("evident"))
    return v.agg(F.count("*").alias("known"), F.count_if("detected").alias("hits"), ok.alias("validated"), F.round(100.0 * ok / F.count("*"), 6).alias("recall"))


DIM = 27
NAMES = [f"x{i}" for i in range(DIM)]
VE = "ve AS (SELECT vec_id AS id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(DIM)) + " FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIM)))


MADS = ", ".join(f"greatest(1.4826 * quantile_cont(abs(x{i} - m{i}), 0.5), 0.25) AS s{i}" for i in range(DIM))
RMS = "0.88 * sqrt((" + " + ".join(f"pow((a.x{i} - b.x{i}) / s{i}, 2)" for i in range(DIM)) + f") / {DIM})"


@query(
    f"""WITH {VE}, bank AS (SELECT * FROM ve WHERE label < 2), m AS (SELECT {", ".join(f"quantile_cont(x{i}, 0.5) AS m{i}" for i in range(DIM))} FROM bank), s AS (SELECT {MADS} FROM bank, m),
d AS (SELECT a.id, b.id AS match, b.label, {RMS} AS dist FROM ve a, bank b, s) SELECT id, CAST(label AS VARCHAR) AS label, match, round(exp(-2 * dist), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, match) AS k FROM d) WHERE k = 1"""
)
def nn_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    bank = v.where("label < 2").withColumnRenamed("id", "uid").withColumn("label", F.col("label").cast("string"))
    return vector.similarity(v, bank, NAMES).select("id", "label", "match", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {VE}, bank AS (SELECT * FROM ve WHERE label < 2), pairs AS (SELECT a.id AS own, b.* FROM bank a JOIN bank b ON a.id <> b.id), m AS (SELECT own, {", ".join(f"quantile_cont(x{i}, 0.5) AS m{i}" for i in range(DIM))} FROM pairs GROUP BY own),
s AS (SELECT own, {MADS} FROM pairs JOIN m USING (own) GROUP BY own), d AS (SELECT a.id, b.id AS match, {RMS} AS dist FROM bank a JOIN bank b ON a.id <> b.id JOIN s ON s.own = a.id)
SELECT id, match, round(exp(-2 * dist), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, match) AS k FROM d) WHERE k = 1"""
)
def leave_one_out_similarity(spark: SparkSession, d: str) -> DataFrame:
    bank = vectors(spark, d).where("label < 2").withColumn("uid", F.col("id")).withColumn("label", F.col("label").cast("string"))
    return vector.similarity(bank, bank, NAMES, leave_out=True).select("id", "match", F.round("similarity", 6).alias("similarity"))


METRICS = "w * h AS area, 2 * (w + h) AS perimeter, least(greatest(w, h) / least(w, h), 100) AS elongation, 4 * pi() * w * h / pow(2 * (w + h), 2) AS circularity, 1.0::DOUBLE AS rectangularity, 1.0::DOUBLE AS convexity"


@query(f"WITH {FE} SELECT id, area, perimeter, round(elongation, 6) AS elongation, round(circularity, 6) AS circularity, rectangularity, convexity FROM (SELECT id, {METRICS} FROM fe)")
def polygon_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = vector.box_metrics(F.col("w"), F.col("h"))
    return features(spark, d).select("id", *(F.round(c, 6).alias(n) for n, c in m.items()))


MORPH = "greatest(0, least(1, 0.20 + 0.27 * CASE WHEN holes > 0 THEN 1 ELSE greatest(0, least(1, (circularity - 0.28) / 0.52)) END + 0.25 * (0.55 * circularity + 0.45 * rectangularity) + 0.28 * greatest(0, least(1, (elongation - 2.5) / 10)) * greatest(0, least(1, linear))))"


@query(f"WITH {FE}, m AS (SELECT id, {METRICS}, CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS holes, (id % 10) / 10.0::DOUBLE AS linear FROM fe) SELECT id, round({MORPH}, 6) AS morphology FROM m")
def morphology_score(spark: SparkSession, d: str) -> DataFrame:
    m = vector.box_metrics(F.col("w"), F.col("h"))
    value = vector.morphology(m["elongation"], m["circularity"], m["rectangularity"], F.when(F.col("id") % 9 == 0, 1).otherwise(0), F.col("id") % 10 / 10)
    return features(spark, d).select("id", F.round(value, 6).alias("morphology"))


@query(f"WITH {FE} SELECT id, round(ln(1 + elongation), 6) AS s0, round(circularity, 6) AS s1, rectangularity AS s2, convexity AS s3, least(id % 7, 4)::DOUBLE AS s4, round(ln(1 + perimeter / greatest(sqrt(area), 1)), 6) AS s5 FROM (SELECT id, {METRICS} FROM fe)")
def shape_signature(spark: SparkSession, d: str) -> DataFrame:
    m = vector.box_metrics(F.col("w"), F.col("h"))
    return features(spark, d).select("id", *(F.round(c, 6).alias(f"s{i}") for i, c in enumerate(vector.signature(m, F.col("id") % 7))))


@query("SELECT p_brand, p_size, arg_max(p_partkey, p_partkey) AS id FROM part GROUP BY 1, 2")
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keep_one(t(spark, d, "part"), ["p_brand", "p_size"], [F.col("p_partkey").desc()]).select("p_brand", "p_size", F.col("p_partkey").alias("id"))


@query("SELECT p_brand, p_size, min(p_partkey) AS id FROM part GROUP BY 1, 2")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keep_one(t(spark, d, "part"), ["p_brand", "p_size"], [F.col("p_partkey")]).select("p_brand", "p_size", F.col("p_partkey").alias("id"))


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = t(spark, d, "orders").where("o_custkey % 3 = 0").select((F.col("o_custkey") * 2).alias("k"), F.concat(F.lit("order "), "o_orderkey").alias("name"), F.col("o_orderkey").alias("seq"))
    return c.withColumn("seq", F.lit(0).cast("long")), b


BATCH = "c AS (SELECT c_custkey AS k, c_name AS name, 0::BIGINT AS seq FROM customer), b AS (SELECT o_custkey * 2 AS k, 'order ' || o_orderkey AS name, o_orderkey AS seq FROM orders WHERE o_custkey % 3 = 0)"


@query(f"WITH {BATCH}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS i FROM b) WHERE i = 1) SELECT k, name FROM n UNION ALL SELECT k, name FROM c WHERE k NOT IN (SELECT k FROM n)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    c, b = _batch(spark, d)
    return catalog.upsert(c, b, ["k"], [F.col("seq").desc()]).select("k", "name")


@query(f"WITH {BATCH} SELECT k, name FROM c UNION ALL SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM b WHERE k NOT IN (SELECT k FROM c)) WHERE i = 1")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    c, b = _batch(spark, d)
    return catalog.insert_ignore(c, b, ["k"], [F.col("seq")]).select("k", "name")


@query("SELECT o_orderkey AS id, f.first FROM orders LEFT JOIN (SELECT p_size AS k, min(p_partkey) AS first FROM part GROUP BY 1) f ON f.k = o_orderkey % 60")
def lookup_min_id(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 60).cast("int").alias("k"))
    return catalog.look_up(o, t(spark, d, "part").withColumnRenamed("p_size", "k"), "k", "p_partkey", "first").select("id", "first")


@query("SELECT p_brand, count(*) AS n, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS p_type, string_agg(DISTINCT CAST(p_size AS VARCHAR), '; ' ORDER BY CAST(p_size AS VARCHAR)) AS size FROM part GROUP BY 1")
def group_records(spark: SparkSession, d: str) -> DataFrame:
    return catalog.grouped(t(spark, d, "part").withColumn("size", F.col("p_size").cast("string")), "p_brand", ["p_type", "size"])


@query("SELECT p_brand AS layer, count(*) AS n FROM part GROUP BY 1")
def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.count("*").alias("n")).orderBy("layer")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def latest_models(spark: SparkSession, d: str) -> DataFrame:
    """A report of the latest five, as the catalogue's status shows them."""
    return t(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(5).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT 'customer' AS source, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def unions(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    s = t(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("WITH " + tq.G + ", a AS (SELECT r, c FROM g WHERE v % 3 = 0), b AS (SELECT r, c FROM g WHERE v % 5 < 2) SELECT 'both' AS op, r, c FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'first', r, c FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', r, c FROM (FROM a UNION FROM b)")
def mask_set_ops(spark: SparkSession, d: str) -> DataFrame:
    g = grid.surface(spark, d)
    a, b = g.where("v % 3 = 0").select("r", "c"), g.where("v % 5 < 2").select("r", "c")
    each = (("both", a.intersect(b)), ("first", a.subtract(b)), ("any", a.union(b).distinct()))
    first, *rest = (x.select(F.lit(n).alias("op"), "r", "c") for n, x in each)
    for x in rest:
        first = first.unionByName(x)
    return first


EM = "em AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"
PROTO = "me AS (SELECT y, p, avg(v) AS m FROM em GROUP BY 1, 2), ln AS (SELECT y, sqrt(sum(m * m)) AS l FROM me GROUP BY 1), pr AS (SELECT y, p, m / greatest(l, 1e-9) AS x FROM me JOIN ln USING (y))"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query(f"WITH {EM}, {PROTO} SELECT CAST(y AS BIGINT) AS y, CAST(p AS BIGINT) AS p, round(x, 5) + 0.0 AS x FROM pr")
def prototypes(spark: SparkSession, d: str) -> DataFrame:
    p = learning.prototypes(labelled(spark, d), "x", "y")
    return p.select(F.col("y").cast("long").alias("y"), F.posexplode("prototype").alias("p", "v")).select("y", F.col("p").cast("long").alias("p"), (F.round("v", 5) + 0.0).alias("x"))


PROB = "pp AS (SELECT em.id, sum(v * (a.x - b.x)) / greatest(sqrt(sum(v * v)), 1e-9) AS m FROM em JOIN pr a ON a.y = 1 AND a.p = em.p JOIN pr b ON b.y = 0 AND b.p = em.p GROUP BY em.id), pb AS (SELECT id, 1 / (1 + exp(-4 * least(2, greatest(-2, m)))) AS p FROM pp)"


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    p = learning.prototypes(rows, "x", "y")
    both = p.agg(F.max(F.when(F.col("y") == 1, F.col("prototype"))).alias("pos"), F.max(F.when(F.col("y") == 0, F.col("prototype"))).alias("neg"))
    return rows.crossJoin(F.broadcast(both)).select("id", "y", learning.prototype_probability(F.col("x"), F.col("pos"), F.col("neg")).alias("p"))


@query(f"WITH {EM}, {PROTO}, {PROB} SELECT id, round(p, 5) AS p FROM pb")
def prototype_probability(spark: SparkSession, d: str) -> DataFrame:
    return probabilities(spark, d).select("id", F.round("p", 5).alias("p"))


@query(f"WITH {EM}, {PROTO}, {PROB} SELECT id, round(0.68 * ((id * 37) % 101 / 101.0::DOUBLE) + 0.32 * p, 5) AS p FROM pb")
def blend_probability(spark: SparkSession, d: str) -> DataFrame:
    return probabilities(spark, d).select("id", F.round(learning.blend((F.col("id") * 37) % 101 / 101, F.col("p")), 5).alias("p"))


@query("""WITH h AS (SELECT DISTINCT o_custkey AS g, md5(CAST(o_custkey AS VARCHAR)) AS h FROM orders), o AS (SELECT g, row_number() OVER (ORDER BY h, g) AS k, count(*) OVER () AS n FROM h)
SELECT o_orderkey AS id, k <= n * 20 // 100 AS held_out FROM orders JOIN o ON o.g = o_custkey""")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return learning.holdout(t(spark, d, "orders"), "o_custkey").select(F.col("o_orderkey").alias("id"), "held_out")


SC = "sc AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, ((vec_id * 7919) % 997 + CASE WHEN label < 5 THEN 300 ELSE 0 END) / 1300.0::DOUBLE AS s FROM embeddings)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    y = F.when(F.col("label") < 5, 1).otherwise(0)
    return e.select(F.col("vec_id").alias("id"), y.alias("y"), (((F.col("vec_id") * 7919) % 997 + y * 300) / 1300).alias("s"))


@query(f"WITH {SC}, x AS (SELECT sum((s >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum((s >= 0.5 AND y = 0)::INT)::DOUBLE AS fp, sum((s < 0.5 AND y = 1)::INT)::DOUBLE AS fn, count(*)::DOUBLE AS n FROM sc) SELECT round((tp + (n - tp - fp - fn)) / n, 6) AS accuracy, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM x")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = learning.binary_metrics(scores(spark, d), "y", "s")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"WITH {SC} SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END), 6) AS auc FROM sc a JOIN sc b ON a.y = 1 AND b.y = 0")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return learning.roc_auc(scores(spark, d), "y", "s").select(F.round("auc", 6).alias("auc"))


FACTORS = "(VALUES (0.75::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) k(f)"


@query(f"""WITH {FE}, s AS (SELECT DISTINCT id, least(256, greatest(32, f * least(256, greatest(32, 2.5 * 2 * sqrt(w * h * 64 / pi()))))) AS scale FROM fe, {FACTORS}), p AS (SELECT id, scale, (id * 31 + CAST(floor(scale) AS BIGINT) * 17) % 100 / 100.0::DOUBLE AS p FROM s)
SELECT id, round(arg_max(scale, p * 1000 - scale / 1000), 6) AS scale, max(p) AS p FROM p GROUP BY id""")
def multi_scale_max(spark: SparkSession, d: str) -> DataFrame:
    base = stats.clip(2.5 * 2 * F.sqrt(F.col("w") * F.col("h") * 64 / math.pi), 32.0, 256.0)
    each = features(spark, d).select("id", F.explode(F.array_distinct(F.array(*(stats.clip(base * f, 32.0, 256.0) for f in (0.75, 1.0, 1.5))))).alias("scale"))
    p = each.withColumn("p", (F.col("id") * 31 + F.floor("scale") * 17) % 100 / 100)
    return p.groupBy("id").agg(F.round(F.max_by("scale", F.struct("p", -F.col("scale"))), 6).alias("scale"), F.max("p").alias("p"))


CAND_NAMES = ("discovery", "lidar", "persistence", "linear", "annular", "ridge", "novelty", "texture", "archaeology", "trained", "satellite", "similarity", "penalty", "relief")
CA = "ca AS (SELECT id, least(greatest(w, h) / least(w, h), 100) AS elongation, 4 * pi() * w * h / pow(2 * (w + h), 2) AS circularity, id % 5 AS holes, ((id * 29) % 97) / 97.0::DOUBLE AS morphology, " + ", ".join(f"((id * {17 + 2 * i} + {i}) % {83 + i}) / {83 + i}.0::DOUBLE AS {c}" for i, c in enumerate(CAND_NAMES)) + " FROM fe)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    m = vector.box_metrics(F.col("w"), F.col("h"))
    each = (((F.col("id") * (17 + 2 * i) + i) % (83 + i) / (83.0 + i)).alias(c) for i, c in enumerate(CAND_NAMES))
    return f.select("id", m["elongation"].alias("elongation"), m["circularity"].alias("circularity"), (F.col("id") % 5).alias("holes"), ((F.col("id") * 29) % 97 / 97.0).alias("morphology"), *each)


BONUS = "CASE WHEN linear >= 0.65 AND elongation >= 7 THEN 0.05 ELSE 0 END + CASE WHEN annular >= 0.65 AND circularity >= 0.42 THEN 0.07 ELSE 0 END + CASE WHEN novelty >= 0.70 THEN 0.05 ELSE 0 END"


def sql_score(kind: str) -> str:
    return f"100 * greatest(0, least(1, ({' + '.join(f'{c} * {w}' for c, w in vector.CANDIDATE[kind].items())} + {BONUS}) * (1 - 0.74 * penalty)))"


@query(f"WITH {FE}, {CA} SELECT id, round({sql_score('plain')}, 6) AS plain, round({sql_score('stored')}, 6) AS stored FROM ca")
def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("id", *(F.round(vector.candidate_score(k), 6).alias(k) for k in ("plain", "stored")))


RULES = (("coherent shape", "morphology >= 0.63"), ("closed ring", "holes > 0 OR (annular >= 0.62 AND circularity >= 0.35)"), ("visible at several scales", "persistence >= 0.34"), ("straight line", "linear >= 0.52"), ("very long", "elongation >= 8"), ("ridge or hollow", "ridge >= 0.60"), ("unusual terrain", "novelty >= 0.58"), ("unusual texture", "texture >= 0.58"), ("like mapped archaeology", "archaeology >= 0.62"), ("stored model agrees", "trained >= 0.55"), ("seen from above", "satellite >= 0.20"), ("like a known feature", "similarity >= 0.68"), ("near modern features", "penalty >= 0.65"))


@query(f"WITH {FE}, {CA} SELECT id, concat_ws('; ', " + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in RULES) + ") AS reasons FROM ca")
def reasons(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("id", F.array_join(vector.reasons(), "; ").alias("reasons"))


@query(
    f"""WITH {FE}, {CA}, s AS (SELECT *, round({sql_score('plain')}, 6) AS score FROM ca), k AS (SELECT * FROM s WHERE NOT (penalty >= 0.97 AND elongation < 6 AND morphology < 0.55) ORDER BY score DESC, novelty DESC, linear DESC, annular DESC, relief DESC, id LIMIT 385)
SELECT id, score, row_number() OVER (ORDER BY score DESC, novelty DESC, linear DESC, annular DESC, relief DESC, id) AS rank, CASE WHEN score >= 70 THEN 'high-priority' ELSE 'candidate' END AS class FROM k"""
)
def rank_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = candidates(spark, d).withColumn("score", F.round(vector.candidate_score("plain"), 6))
    return vector.ranked(scored, 385, 5).select("id", "score", F.col("rank").cast("long").alias("rank"), "class")


@query(
    f"""WITH {FE}, {CA}, s AS (SELECT id, trained, round({sql_score('plain')}, 6) AS first FROM ca ORDER BY first DESC, id LIMIT 385), n AS (SELECT id, trained, round(100 * greatest(0, least(1, 0.42 * first / 100 + 0.58 * trained)), 6) AS score FROM s)
SELECT row_number() OVER (ORDER BY score DESC, trained DESC, id) AS rank, id, score, CASE WHEN trained >= 0.8 THEN 'strong' WHEN trained >= 0.62 THEN 'supporting' END AS support FROM n"""
)
def rerank(spark: SparkSession, d: str) -> DataFrame:
    first = candidates(spark, d).withColumn("score", F.round(vector.candidate_score("plain"), 6)).orderBy(F.col("score").desc(), "id").limit(385)
    return vector.reranked(first).select(F.col("rank").cast("long").alias("rank"), "id", "score", "support")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders), s(k, pos, day) AS (SELECT k, 0::BIGINT, max(day) FROM d GROUP BY k
UNION ALL SELECT s.k, s.pos + 1, (SELECT max(d.day) FROM d WHERE d.k = s.k AND d.day <= s.day - 45) FROM s WHERE s.pos < 3 AND EXISTS (SELECT 1 FROM d WHERE d.k = s.k AND d.day <= s.day - 45)) SELECT k, pos, CAST(day AS VARCHAR) AS day FROM s""")
def scene_spacing(spark: SparkSession, d: str) -> DataFrame:
    out = vector.spaced(t(spark, d, "orders"), "o_custkey", "o_orderdate", 45, 4)
    return out.select(F.col("o_custkey").alias("k"), "pos", F.col("day").cast("string").alias("day"))


@query("WITH " + tq.G + ", p AS (SELECT v, CAST(floor(sqrt((r - 15.5) ** 2 + (c - 15.5) ** 2) / (15.5 * sqrt(2)) * 16 + 0) AS BIGINT) AS ring FROM g) SELECT ring, round(avg(v), 6) AS mean FROM p WHERE ring < 16 GROUP BY 1")
def radial_profile(spark: SparkSession, d: str) -> DataFrame:
    return learning.radial_profile(grid.surface(spark, d), 32).select(F.col("ring").cast("long").alias("ring"), F.round("mean", 6).alias("mean"))


@query("WITH " + tq.G + """, w AS (SELECT r, c, abs(v) + 1e-3 AS w FROM g), m AS (SELECT sum(w) AS t, sum(w * r) / sum(w) AS my, sum(w * c) / sum(w) AS mx FROM w),
s AS (SELECT sum(w * (c - mx) ** 2) / max(t) AS xx, sum(w * (c - mx) * (r - my)) / max(t) AS xy, sum(w * (r - my) ** 2) / max(t) AS yy, avg(((c - mx) ** 3 + (r - my) ** 3) * w) / max(t) AS skew, avg(((c - mx) ** 4 + (r - my) ** 4) * w) / max(t) AS kurtosis, avg(w) AS weight FROM w, m),
e AS (SELECT *, xx + yy AS trace, xx * yy - xy * xy AS det, sqrt(greatest(0, (xx + yy) ** 2 / 4 - (xx * yy - xy * xy))) AS root FROM s)
SELECT round(trace / 2 - root, 4) AS minor, round(trace / 2 + root, 4) AS major, round(trace, 4) AS trace, round(det, 3) AS det, round((trace / 2 + root) / greatest(trace / 2 - root, 1e-6), 5) AS ratio, round(skew, 5) AS skew, round(kurtosis, 3) AS kurtosis, round(weight, 5) AS weight FROM e""")
def moments(spark: SparkSession, d: str) -> DataFrame:
    digits = {"minor": 4, "major": 4, "trace": 4, "det": 3, "ratio": 5, "skew": 5, "kurtosis": 3, "weight": 5}
    return learning.moments(grid.surface(spark, d)).select(*(F.round(c, n).alias(c) for c, n in digits.items()))


@query(
    """WITH l AS (SELECT range AS level FROM range(1, 11)) SELECT level, round(CASE level WHEN 1 THEN 99.7 ELSE 100.28 - 0.58 * level END, 6)::DOUBLE AS threshold, round(36 - 2.6 * level, 6)::DOUBLE AS min_line, round(greatest(1.5, 24.5 - 2.5 * level), 6)::DOUBLE AS min_area,
CAST(10000 + 1800 * level AS DOUBLE) AS max_area, 35 + 70 * level AS max_candidates, 12000 + 2500 * level AS sample FROM l"""
)
def sensitivity_profile(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("level")
    p = spark.range(1, 11).withColumnRenamed("id", "level")
    return p.select("level", F.round(100.28 - 0.58 * x, 6).alias("threshold"), F.round(36 - 2.6 * x, 6).alias("min_line"), F.round(F.greatest(F.lit(1.5), 24.5 - 2.5 * x), 6).alias("min_area"), (10000 + 1800 * x).cast("double").alias("max_area"), (35 + 70 * x).alias("max_candidates"), (12000 + 2500 * x).alias("sample"))


@query()
def rf_likelihood(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("y", F.when(F.col("label") < 5, 1).otherwise(0))
    train = learning.balanced(rows, "y", ["id"], 12000, 12000)
    return learning.forest(train, rows, NAMES, "y", trees=40, depth=8).select("id", "likelihood")


@query()
def pca_embedding(spark: SparkSession, d: str) -> DataFrame:
    return learning.embedding(vectors(spark, d), NAMES, 8).select("id", F.posexplode("embedding").alias("p", "x"))


@query()
def isolation_novelty(spark: SparkSession, d: str) -> DataFrame:
    return learning.isolation(vectors(spark, d), ["id"], NAMES)


@query()
def patch_descriptor(spark: SparkSession, d: str) -> DataFrame:
    centres = spark.range(1, 5).select(F.col("id"), (F.col("id") * 6).alias("r"), (F.col("id") * 5).alias("c"))
    return learning.patch_descriptors(grid.surface(spark, d), centres, 8).select("id", F.posexplode("descriptor").alias("p", "x"))
