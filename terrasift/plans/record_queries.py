"""Registered queries over records of features and candidates, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, records, vector
from . import feature_queries as fq
from . import terrain_queries as tq
from .feature_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Properties of a part, as SQL and as a map.
PROPS = {
    "HE_UID": "CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_brand ELSE ' ' END", "UID": "CASE WHEN p_partkey % 7 = 1 THEN p_type END", "DHEUID_1": "CASE WHEN p_partkey % 7 = 2 THEN p_name END", "OBJECTID": "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS STRING) END",
    "MONUMENT_TYPE": "CASE WHEN p_partkey % 3 = 0 THEN 'Historic England AIM' WHEN p_partkey % 3 = 1 THEN p_type END", "TYPE": "CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE 'Raster ' || p_brand END", "LAYER": "CASE WHEN p_partkey % 6 = 0 THEN 'Bank' END",
    "SITE_NAME": "CASE WHEN p_partkey % 3 <> 1 THEN ' ' || p_name END", "PLACE": "CASE WHEN p_partkey % 2 = 1 THEN p_name ELSE '' END", "SITE_TYPE": "p_type",
}
P = "p AS (SELECT p_partkey AS id, " + ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in PROPS.items()) + " FROM part)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.expr(v).alias("value")) for k, v in PROPS.items())), lambda e: e["value"].isNotNull())
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.map_from_entries(entries).alias("props"))


def sql_first(keys: tuple[str, ...]) -> str:
    return ", ".join(f"nullif(trim({k}), '')" for k in keys if k in PROPS)


@query(f"WITH {P} SELECT id, coalesce(" + ", ".join(f"CASE WHEN lower(trim({k})) NOT IN {records.GENERIC_LABELS} THEN nullif(trim({k}), '') END" for k in records.LABEL_KEYS if k in PROPS) + f", '{records.UNKNOWN_LABEL}') AS label FROM p")
def feature_label(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", records.feature_label(F.col("props")).alias("label"))


@query(f"WITH {P} SELECT id, " + ", ".join(f"coalesce({sql_first(keys)}, '{prefix}' || id) AS {kind}" for kind, (keys, prefix) in records.UID_KEYS.items()) + " FROM p")
def uid_priorities(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", *(records.feature_uid(F.col("props"), F.col("id"), k).alias(k) for k in records.UID_KEYS))


@query(f"WITH {P} SELECT id, concat_ws('; ', nullif(trim(PLACE), ''), CASE WHEN trim(PLACE) = trim(SITE_NAME) THEN NULL ELSE nullif(trim(SITE_NAME), '') END) AS names FROM p")
def name_fields(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", F.array_join(records.name_values(F.col("props")), "; ").alias("names"))


@query(f"WITH {P} SELECT id, trim(TYPE) AS type FROM p WHERE contains(lower(trim(TYPE)), 'raster')")
def raster_projects(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("props")["TYPE"]
    return parts(spark, d).where(records.raster_only(kind)).select("id", F.trim(kind).alias("type"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE event_id / 1000.0::DOUBLE END AS x FROM events")
def diagnostic_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).when(k == 3, F.lit(None).cast("double")).otherwise(F.col("event_id") / 1000)
    return t(spark, d, "events").select("event_id", records.finite(x).alias("x"))


SQUARE = "list_extract(list_extract([" + ", ".join("[" + ", ".join(f"'{x}'" for x in row) + "]" for row in vector.SQUARES) + "], CAST(floor(({y}) / 100000) AS INT) + 1), CAST(floor(({x}) / 100000) AS INT) + 1)"
CORNERS = ", ".join(SQUARE.format(x=x, y=y) for x, y in (("x0", "y0"), ("x1 - 1e-6", "y0"), ("x0", "y1 - 1e-6"), ("x1 - 1e-6", "y1 - 1e-6")))


@query(f"WITH b AS (SELECT o_orderkey AS id, (o_orderkey % 6) * 100000.0::DOUBLE AS x0, (o_orderkey % 12) * 95000.0::DOUBLE AS y0, ((o_orderkey % 6) + 1) * 100000.0::DOUBLE AS x1, (o_orderkey % 12) * 95000.0::DOUBLE + 60000 AS y1 FROM orders) SELECT id, array_to_string(list_sort(list_distinct([{CORNERS}])), ' ') AS squares FROM b")
def bounds_squares(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("o_orderkey") % 6) * 100000.0, (F.col("o_orderkey") % 12) * 95000.0
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(records.squares_of_bounds(x, y, x + 100000.0, y + 60000.0, vector.grid_square), " ").alias("squares"))


@query(
    """WITH a AS (SELECT p_partkey AS id, 400 + p_partkey % 800 AS w, 300 + p_size * 10 AS h, (1 + p_partkey % 9) / 4.0::DOUBLE AS a FROM part),
v AS (SELECT *, CASE WHEN a >= w / h::DOUBLE THEN w ELSE greatest(1, round_even(h * a, 0)) END AS vw, CASE WHEN a >= w / h::DOUBLE THEN greatest(1, round_even(w / a, 0)) ELSE h END AS vh FROM a)
SELECT id, round((w - vw) / 2 / w * 100, 6) AS "left", round((h - vh) / 2 / h * 100, 6) AS top, round(vw / w * 100, 6) AS w_share, round(vh / h * 100, 6) AS h_share, CAST(vw AS BIGINT) AS w, CAST(vh AS BIGINT) AS h FROM v"""
)
def map_viewport(spark: SparkSession, d: str) -> DataFrame:
    w, h, a = 400 + F.col("p_partkey") % 800, 300 + F.col("p_size") * 10, (1 + F.col("p_partkey") % 9) / 4.0
    v = records.viewport(w, h, a)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), *((x if k in "wh" else F.round(x, 6)).alias(k) for k, x in v.items()))


@query(
    """WITH a AS (SELECT c_custkey AS id, (c_custkey * 37) % 200 - 100 AS lat, (c_custkey * 53) % 400 - 200 AS lon, (c_custkey * 97) % 12000 - 500 AS d FROM customer)
SELECT id, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude must be between -90 and 90' WHEN lon NOT BETWEEN -180 AND 180 THEN 'longitude must be between -180 and 180' WHEN d <= 0 THEN 'diameter must be greater than zero' WHEN d > 10000 THEN 'diameter must not exceed 10,000 m' END AS error FROM a"""
)
def study_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k.alias("id"), records.study_error(k * 37 % 200 - 100, k * 53 % 400 - 200, k * 97 % 12000 - 500).alias("error"))


@query("SELECT c_custkey AS id, round(degrees(c_acctbal * 1000 / 6378137.0::DOUBLE), 6) AS lon, round(degrees(2 * atan(exp(c_custkey * 500 / 6378137.0::DOUBLE)) - pi() / 2), 6) AS lat FROM customer")
def mercator_inverse(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = records.mercator_inverse(F.col("c_acctbal") * 1000, F.col("c_custkey") * 500)
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


SIG = "[ln(1 + least(greatest(w, h) / least(w, h), 100)), 4 * pi() * w * h / pow(2 * (w + h), 2), 1, 1, least(id % 7, 4), ln(1 + 2 * (w + h) / greatest(sqrt(w * h), 1))]"


@query(f"WITH {fq.FE}, s AS (SELECT id, {SIG} AS s FROM fe), one AS (SELECT s AS o FROM s ORDER BY id LIMIT 1) SELECT id, round(exp(-0.7 * sqrt({' + '.join(f'pow(s[{i}] - o[{i}], 2)' for i in range(1, 7))})), 6) AS similarity FROM s, one")
def shape_similarity(spark: SparkSession, d: str) -> DataFrame:
    f = fq.features(spark, d)
    s = f.select("id", F.array(*(x.cast("double") for x in vector.signature(vector.box_metrics(F.col("w"), F.col("h")), F.col("id") % 7))).alias("s"))
    one = s.orderBy("id").limit(1).select(F.col("s").alias("o"))
    return s.crossJoin(F.broadcast(one)).select("id", F.round(records.shape_similarity(F.col("s"), F.col("o")), 6).alias("similarity"))


@query("SELECT p_brand, p_size, min(p_partkey) AS place, arg_max(p_name, p_partkey) AS name FROM part GROUP BY 1, 2")
def dedupe_in_place(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select("p_brand", "p_size", F.col("p_partkey").alias("place"), F.col("p_name").alias("name"))
    return records.last_value_first_place(rows, ["p_brand", "p_size"], "place", "name")


@query(
    """WITH h AS (SELECT DISTINCT c_nationkey AS g, md5(CAST(c_nationkey AS VARCHAR)) AS h FROM customer), o AS (SELECT g, row_number() OVER (ORDER BY h, g) AS k, count(*) OVER () AS n FROM h)
SELECT c_custkey AS id, n > 1 AND k <= greatest(1, ceil(n * 0.2)) AS held_out FROM customer JOIN o ON o.g = c_nationkey"""
)
def holdout_groups(spark: SparkSession, d: str) -> DataFrame:
    return records.holdout_groups(t(spark, d, "customer"), "c_nationkey").select(F.col("c_custkey").alias("id"), "held_out")


@query("SELECT l.level, greatest(greatest(0.22, 0.42 - 0.02 * l.level), quantile_cont(s, greatest(56.0, 76.0 - 2.0 * l.level) / 100)) AS threshold FROM (SELECT unnest([1, 5, 10]) AS level) l, (SELECT (vec_id * 7919) % 997 / 996.0::DOUBLE AS s FROM embeddings) GROUP BY l.level".replace("quantile_cont(s, greatest(56.0, 76.0 - 2.0 * l.level) / 100)", "CASE l.level WHEN 1 THEN quantile_cont(s, 0.74) WHEN 5 THEN quantile_cont(s, 0.66) ELSE quantile_cont(s, 0.56) END"))
def learned_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "embeddings").select((F.col("vec_id") * 7919 % 997 / 996).alias("s"))
    found = s.agg(*(records.learned_threshold(k, "s")[2].alias(f"l{k}") for k in (1, 5, 10)))
    return found.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"l{k}").alias("threshold")) for k in (1, 5, 10)))).alias("x")).select("x.*")


@query(
    f"""WITH {fq.FE}, {fq.CA} SELECT count(*) AS kept_for_ranking, sum((penalty >= 0.65)::INT)::BIGINT AS modern_heavily_penalised, sum((similarity >= 0.68)::INT)::BIGINT AS known_like_ranked, sum((trained >= 0.55)::INT)::BIGINT AS trained_model_seeded,
sum((annular >= 0.62 AND circularity >= 0.35)::INT)::BIGINT AS ring_like, sum((linear >= 0.52)::INT)::BIGINT AS line_like FROM ca"""
)
def detection_counters(spark: SparkSession, d: str) -> DataFrame:
    return records.counters(fq.candidates(spark, d))


ELEVEN = (*tq.NINE, "trained")


@query(tq.recursive(tq.G, tq.CH, tq.MASK, tq.LABELS) + "SELECT label, " + ", ".join(f"round(quantile_cont(ch.{c}, 0.92), 6) AS {c}" for c in ELEVEN) + " FROM lab JOIN ch USING (r, c) GROUP BY label")
def evidence_q92(spark: SparkSession, d: str) -> DataFrame:
    cells = tq.masked(spark, d)
    j = masks.components(cells, "k", tq.SIDE).join(cells.select("r", "c", *ELEVEN), ["r", "c"])
    return j.groupBy("label").agg(*(F.round(F.percentile(c, F.lit(0.92)), 6).alias(c) for c in ELEVEN))
