"""Registered queries over rasters, each with the SQL of the same result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, stats
from ..operators import masks, terrain

SIDE = grid.SIDE
LEVEL = 5

# --- SQL building blocks -------------------------------------------------------------------------------------------

G = """g AS (SELECT a.i AS r, b.i AS c, coalesce(s.v, 0) AS v FROM (SELECT range AS i FROM range(32)) a CROSS JOIN (SELECT range AS i FROM range(32)) b
LEFT JOIN (SELECT l_orderkey % 32 AS r, l_partkey % 32 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) s ON s.r = a.i AND s.c = b.i)"""


def sql_kernel(src: str, col: str, kernel: list[tuple[int, float]], out: str) -> str:
    """CTEs: col of src under a separable kernel, edges repeated; the last is named out, with (r, c, v)."""
    k = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in kernel)
    return f"""{out}_k(o, w) AS (VALUES {k}),
{out}_x AS (SELECT a.r, a.c, sum(b.{col} * k.w) AS v FROM {src} a CROSS JOIN {out}_k k JOIN {src} b ON b.r = a.r AND b.c = greatest(0, least(31, a.c + k.o)) GROUP BY 1, 2),
{out} AS (SELECT a.r, a.c, sum(b.v * k.w) AS v FROM {out}_x a CROSS JOIN {out}_k k JOIN {out}_x b ON b.c = a.c AND b.r = greatest(0, least(31, a.r + k.o)) GROUP BY 1, 2)"""


def sql_gauss(src: str, col: str, sigma: float, out: str) -> str:
    return sql_kernel(src, col, grid.gauss_kernel(sigma), out)


def sql_gradient(src: str, col: str, out: str) -> str:
    """A CTE with r, c, gx, gy."""

    def d(part: str, order: str) -> str:
        w = f"OVER (PARTITION BY {part} ORDER BY {order})"
        return f"CASE WHEN lag({col}) {w} IS NULL THEN lead({col}) {w} - {col} WHEN lead({col}) {w} IS NULL THEN {col} - lag({col}) {w} ELSE (lead({col}) {w} - lag({col}) {w}) / 2 END"

    return f"{out} AS (SELECT r, c, {d('r', 'c')} AS gx, {d('c', 'r')} AS gy FROM {src})"


def sql_mad_z(src: str, col: str, out: str) -> str:
    """CTEs; out has r, c, z."""
    return f"""{out}_m AS (SELECT quantile_cont({col}, 0.5) AS m FROM {src}), {out}_d AS (SELECT quantile_cont(abs({col} - m), 0.5) AS d FROM {src}, {out}_m),
{out} AS (SELECT r, c, abs({col} - m) / greatest(1e-6, 1.4826 * d) AS z FROM {src}, {out}_m, {out}_d)"""


def sql_unit(src: str, col: str, out: str, q: float = 0.995) -> str:
    """CTEs; out has r, c, u."""
    return f"""{sql_mad_z(src, col, out + "_z")}, {out}_h AS (SELECT greatest(1, quantile_cont(z, {q})) AS h FROM {out}_z),
{out} AS (SELECT r, c, least(1, z / h) AS u FROM {out}_z, {out}_h)"""


def sql_box(src: str, col: str, h: int, how: str, out: str) -> str:
    return f"{out} AS (SELECT a.r, a.c, {how}(b.{col}) AS v FROM {src} a JOIN {src} b ON b.r BETWEEN a.r - {h} AND a.r + {h} AND b.c BETWEEN a.c - {h} AND a.c + {h} GROUP BY 1, 2)"


def sql_greatest(parts: list[tuple[str, str]], out: str, name: str) -> str:
    """A CTE: the greatest of columns of frames with (r, c)."""
    first = parts[0][0]
    joins = " ".join(f"JOIN {t} USING (r, c)" for t, _ in parts[1:])
    return f"{out} AS (SELECT r, c, greatest({', '.join(f'{t}.{c}' for t, c in parts)}) AS {name} FROM {first} {joins})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """r, c and columns rounded; negative zeros become zeros."""
    return df.select("r", "c", *((F.round(F.col(c), digits) + 0.0).alias(c) for c in cols))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function (spark, sf_dir) under its name, with SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RELIEFS = [s for i, x in enumerate(terrain.SCALES) for s in (sql_gauss("g", "v", grid.relief_sigma(x), f"m{i}"), f"rel{i} AS (SELECT g.r, g.c, g.v - m{i}.v AS v FROM g JOIN m{i} USING (r, c))")]
RELIEF_Z = [*RELIEFS, *(sql_mad_z(f"rel{i}", "v", f"z{i}") for i in range(len(terrain.SCALES)))]
N_SCALES = len(terrain.SCALES)
Z_JOIN = "z0 " + " ".join(f"JOIN z{i} USING (r, c)" for i in range(1, N_SCALES))
CUTOFF = terrain.persistence_cutoff(LEVEL)
MAX_RELIEF = [*RELIEF_Z, *(sql_unit(f"z{i}", "z", f"u{i}", 0.997) for i in range(N_SCALES)), sql_greatest([(f"u{i}", "u") for i in range(N_SCALES)], "mr", "max_relief")]
PERSISTENCE = f"pe AS (SELECT r, c, ({' + '.join(f'CAST(z{i}.z >= {CUTOFF} AS INT)' for i in range(N_SCALES))}) / {N_SCALES}.0::DOUBLE AS persistence FROM {Z_JOIN})"


@query(with_(G) + "SELECT r, c, CAST(v AS DOUBLE) AS v FROM g")
def surface_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.surface(spark, d)


HOLES = "holed AS (SELECT r, c, CASE WHEN (7 * r + 13 * c) % 17 = 0 THEN NULL ELSE v END AS v FROM g)"


@query(with_(G, HOLES, "near AS (SELECT a.r, a.c, b.v, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) ** 2 + (a.c - b.c) ** 2, b.r, b.c) AS k FROM holed a JOIN holed b ON b.v IS NOT NULL)") + "SELECT r, c, v FROM near WHERE k = 1")
def fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.surface(spark, d).withColumn("v", F.when((7 * F.col("r") + 13 * F.col("c")) % 17 != 0, F.col("v")))
    return terrain.fill_nearest(cells)


@query(with_(G, sql_gradient("g", "v", "s")) + "SELECT r, c, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt(gx * gx + gy * gy), 6) AS slope FROM s")
def gradient_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.slope(grid.surface(spark, d)), "gx", "gy", "slope")


def sql_shade(azimuth: float, altitude: float) -> str:
    az, alt = math.radians(azimuth), math.radians(altitude)
    s = f"({math.sin(alt)!r} * sin(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) + {math.cos(alt)!r} * cos(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) * cos({az!r} - atan2(-gx, gy)))"
    return f"greatest(0, least(255, ({s} + 1) * 127.5))"


SHADED = [G, sql_gauss("g", "v", 0.6, "sm"), sql_gradient("sm", "v", "s")]
MULTI = " + ".join(f"floor({sql_shade(az, 35.0)})" for az in range(0, 360, 45))
MULTI38 = " + ".join(f"floor({sql_shade(az, 38.0)})" for az in range(0, 360, 45))


@query(with_(*SHADED) + f"SELECT r, c, CAST(floor({sql_shade(315.0, 45.0)}) AS BIGINT) AS shade FROM s")
def hillshade(spark: SparkSession, d: str) -> DataFrame:
    return terrain.hillshade(grid.surface(spark, d)).select("r", "c", F.col("shade").cast("long").alias("shade"))


@query(with_(*SHADED) + f"SELECT r, c, CAST(floor(({MULTI}) / 8) AS BIGINT) AS shade FROM s")
def hillshade_multi(spark: SparkSession, d: str) -> DataFrame:
    return terrain.hillshade_multi(grid.surface(spark, d)).select("r", "c", F.col("shade").cast("long").alias("shade"))


@query(
    with_(*SHADED, f"m AS (SELECT r, c, 0.7 * floor(({MULTI38}) / 8) + 0.3 * floor({sql_shade(315.0, 42.0)}) AS m FROM s)", "q AS (SELECT quantile_cont(m, 0.02) AS lo, quantile_cont(m, 0.98) AS hi FROM m)")
    + "SELECT r, c, CAST(round_even(255 * pow(greatest(0, least(1, (m - lo) / greatest(hi - lo, 1e-6))), 0.9), 0) AS BIGINT) AS shade FROM m, q"
)
def hillshade_arch(spark: SparkSession, d: str) -> DataFrame:
    return terrain.hillshade_arch(grid.surface(spark, d)).select("r", "c", F.col("shade").cast("long").alias("shade"))


@query(with_(G, sql_gauss("g", "v", 1.2, "s")) + "SELECT r, c, round(v, 6) AS smooth FROM s")
def gauss_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grid.gauss(grid.surface(spark, d), "v", 1.2, "smooth"), "smooth")


@query(with_(G, *RELIEFS) + " UNION ALL ".join(f"SELECT r, c, {s}::DOUBLE AS scale, round(v, 6) + 0.0 AS relief FROM rel{i}" for i, s in enumerate(terrain.SCALES)))
def local_relief_scales(spark: SparkSession, d: str) -> DataFrame:
    df = terrain.reliefs(grid.surface(spark, d))
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), (F.round(f"rel_{i}", 6) + 0.0).alias("relief")) for i, s in enumerate(terrain.SCALES))))
    return df.select("r", "c", pairs.alias("x")).select("r", "c", "x.scale", "x.relief")


@query(with_(G, sql_mad_z("g", "v", "z")) + "SELECT r, c, round(z, 6) AS z FROM z")
def mad_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mad_z(grid.surface(spark, d), "v", "z"), "z")


@query(with_(G, sql_unit("g", "v", "u")) + "SELECT r, c, round(u, 6) AS u FROM u")
def robust_unit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.robust_unit(grid.surface(spark, d), "v", "u"), "u")


@query(with_(G, "m AS (SELECT quantile_cont(v, 0.5) AS m FROM g)", "q AS (SELECT quantile_cont(abs(v - m), 0.5) AS q FROM g, m)") + "SELECT r, c, round(least(6, greatest(-6, (v - m) / greatest(0.05, 1.4826 * q))), 6) + 0.0 AS x FROM g, m, q")
def train_normalise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.normalised(grid.surface(spark, d), "v", "x"), "x")


@query(with_(G, *MAX_RELIEF, PERSISTENCE) + "SELECT r, c, round(max_relief, 6) AS max_relief, round(persistence, 6) AS persistence FROM mr JOIN pe USING (r, c)")
def max_relief_persistence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.relief_channels(grid.surface(spark, d), LEVEL), "max_relief", "persistence")


@query(
    with_(G, *RELIEF_Z, "l AS (" + " UNION ALL ".join(f"SELECT r, c, z, {s}::DOUBLE AS scale, rel{i}.v AS relief FROM z{i} JOIN rel{i} USING (r, c)" for i, s in enumerate(terrain.SCALES)) + ")")
    + "SELECT r, c, scale, round(relief, 6) + 0.0 AS relief FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY z DESC, scale) AS k FROM l) WHERE k = 1"
)
def strongest_scale(spark: SparkSession, d: str) -> DataFrame:
    return terrain.strongest(terrain.relief_z(grid.surface(spark, d))).select("r", "c", "scale", (F.round("relief", 6) + 0.0).alias("relief"))


def sql_coherence(src: str, sigma: float, out: str) -> str:
    """CTEs from (r, c, gx, gy); out has r, c, coherence."""
    return f"""{out}_p AS (SELECT r, c, gx * gx AS xx, gx * gy AS xy, gy * gy AS yy FROM {src}), {sql_gauss(out + "_p", "xx", sigma, out + "_a")}, {sql_gauss(out + "_p", "xy", sigma, out + "_b")}, {sql_gauss(out + "_p", "yy", sigma, out + "_c")},
{out} AS (SELECT r, c, CASE WHEN a.v + d.v > 1e-9 THEN sqrt((a.v - d.v) ** 2 + 4 * b.v * b.v) / (a.v + d.v + 1e-9) ELSE 0 END AS coherence FROM {out}_a a JOIN {out}_b b USING (r, c) JOIN {out}_c d USING (r, c))"""


@query(with_(G, sql_gradient("g", "v", "s"), sql_coherence("s", 1.4, "co")) + "SELECT r, c, round(coherence, 6) AS coherence FROM co")
def structure_tensor_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.coherence(terrain.slope(grid.surface(spark, d)), "gx", "gy", 1.4), "coherence")


def sql_slopes(src: str, out: str) -> str:
    """From a smoothed (r, c, v): out_g (gx, gy), out_s (slope), out_k (curvature)."""
    return f"""{sql_gradient(src, "v", out + "_g")}, {out}_s AS (SELECT r, c, sqrt(gx * gx + gy * gy) AS v FROM {out}_g),
{sql_gradient(out + "_g", "gx", out + "_gx")}, {sql_gradient(out + "_g", "gy", out + "_gy")}, {out}_k AS (SELECT r, c, abs({out}_gx.gx + {out}_gy.gy) AS v FROM {out}_gx JOIN {out}_gy USING (r, c))"""


def sql_linear(i: int, scale: float) -> list[str]:
    """CTEs; li{i} has r, c, linear at one scale."""
    n = f"l{i}"
    return [
        sql_gauss("g", "v", grid.relief_sigma(scale), f"{n}m"), sql_slopes(f"{n}m", n), f"{n}_r AS (SELECT r, c, abs(g.v - {n}m.v) AS v FROM g JOIN {n}m USING (r, c))", sql_coherence(f"{n}_g", 1.4, f"{n}_c"),
        sql_unit(f"{n}_k", "v", f"{n}uk", 0.997), sql_unit(f"{n}_r", "v", f"{n}ur", 0.997), sql_unit(f"{n}_s", "v", f"{n}us", 0.997),
        f"li{i} AS (SELECT r, c, {n}ur.u * {n}us.u * (0.30 + 0.50 * greatest(0, least(1, coherence)) + 0.20 * {n}uk.u) AS linear FROM {n}ur JOIN {n}us USING (r, c) JOIN {n}uk USING (r, c) JOIN {n}_c USING (r, c))",
    ]


LINEAR = [x for i, s in enumerate(terrain.LINES) for x in sql_linear(i, s)]
LINEAR.append("ll AS (" + " UNION ALL ".join(f"SELECT r, c, linear, {s}::DOUBLE AS scale FROM li{i}" for i, s in enumerate(terrain.LINES)) + ")")


@query(with_(G, *LINEAR) + "SELECT r, c, round(greatest(0, least(1, linear)), 6) AS linear, CASE WHEN linear > 0 THEN scale ELSE 0 END AS linear_scale FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY linear DESC, scale) AS k FROM ll) WHERE k = 1")
def linear_response(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.linear(grid.surface(spark, d)), "linear", "linear_scale")


ANNULAR = [x for i, s in enumerate(terrain.PATTERN) for x in (
    sql_kernel("g", "v", grid.box_kernel(grid.odd_pixels(2.4 * s, 5)), f"ao{i}"), sql_kernel("g", "v", grid.box_kernel(grid.odd_pixels(0.75 * s, 3)), f"ai{i}"),
    f"ad{i} AS (SELECT r, c, abs(ao{i}.v - ai{i}.v) AS v FROM ao{i} JOIN ai{i} USING (r, c))", sql_unit(f"ad{i}", "v", f"au{i}", 0.997))]
ANNULAR.append(sql_greatest([(f"au{i}", "u") for i in range(len(terrain.PATTERN))], "an", "annular"))


@query(with_(G, *ANNULAR) + "SELECT r, c, round(annular, 6) AS annular FROM an")
def annular_response(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.annular(grid.surface(spark, d)), "annular")


RIDGE = [x for i, s in enumerate(terrain.PATTERN) for x in (
    sql_box("g", "v", grid.odd_pixels(s, 3) // 2, "max", f"hi{i}"), sql_box("g", "v", grid.odd_pixels(s, 3) // 2, "min", f"lo{i}"),
    f"up{i} AS (SELECT r, c, g.v - lo{i}.v AS v FROM g JOIN lo{i} USING (r, c))", f"dn{i} AS (SELECT r, c, hi{i}.v - g.v AS v FROM g JOIN hi{i} USING (r, c))",
    sql_unit(f"up{i}", "v", f"uu{i}", 0.997), sql_unit(f"dn{i}", "v", f"ud{i}", 0.997))]
RIDGE.append(sql_greatest([(f"{k}{i}", "u") for i in range(len(terrain.PATTERN)) for k in ("uu", "ud")], "rv", "ridge_valley"))


@query(with_(G, *RIDGE) + "SELECT r, c, round(ridge_valley, 6) AS ridge_valley FROM rv")
def ridge_valley(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.ridge_valley(grid.surface(spark, d)), "ridge_valley")


TEXTURE = [*RELIEFS, *(x for i in range(N_SCALES) for x in (sql_gauss(f"rel{i}", "v", 1.2, f"tg{i}"), f"tt{i} AS (SELECT r, c, abs(rel{i}.v - tg{i}.v) AS v FROM rel{i} JOIN tg{i} USING (r, c))")),
           sql_greatest([(f"tt{i}", "v") for i in range(N_SCALES)], "tx", "v"), sql_gauss("g", "v", grid.relief_sigma(6.0), "ts"), sql_slopes("ts", "t"), sql_coherence("t_g", 1.6, "t_c"),
           sql_unit("tx", "v", "xt", 0.997), sql_unit("t_k", "v", "xk", 0.997), sql_unit("t_s", "v", "xs", 0.997),
           "te AS (SELECT r, c, greatest(xt.u, 0.55 * xk.u + 0.45 * xs.u * greatest(0, least(1, coherence))) AS texture, greatest(0, least(1, coherence)) AS coherence FROM xt JOIN xk USING (r, c) JOIN xs USING (r, c) JOIN t_c USING (r, c))"]


@query(with_(G, *TEXTURE) + "SELECT r, c, round(texture, 6) AS texture, round(coherence, 6) AS coherence FROM te")
def texture_curvature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.texture(grid.surface(spark, d)), "texture", "coherence")


# Channels for the discovery score, cheap stand-ins with the right names: shares of the surface by different columns.
CHANNELS = ("max_relief", "persistence", "linear", "annular", "ridge_valley", "texture", "terrain_novelty", "coherence", "archaeology", "trained")


def channels(spark: SparkSession, d: str) -> DataFrame:
    """The surface with channels in 0..1, from arithmetic that SQL repeats."""
    cells = grid.surface(spark, d)
    return cells.select("r", "c", "v", *(((F.col("v") * (i + 3) + F.col("r") * (i + 1) + F.col("c") * 7) % (89 + i) / (89.0 + i)).alias(c) for i, c in enumerate(CHANNELS)))


CH = "ch AS (SELECT r, c, v, " + ", ".join(f"((v * {i + 3} + r * {i + 1} + c * 7) % {89 + i}) / {89 + i}.0::DOUBLE AS {c}" for i, c in enumerate(CHANNELS)) + " FROM g)"


@query(with_(G, CH) + "SELECT r, c, " + ", ".join(f"round({' + '.join(f'{c} * {w}' for c, w in t.items())}, 6) AS {k}" for k, t in terrain.DISCOVERY.items()) + " FROM ch")
def discovery_score(spark: SparkSession, d: str) -> DataFrame:
    return channels(spark, d).select("r", "c", *(F.round(terrain.discovery(k), 6).alias(k) for k in terrain.DISCOVERY))


CUTS = {"max_relief": 97.38, "linear": 96.77, "annular": 96.67, "terrain_novelty": 96.58}


@query(with_(G, CH) + "SELECT " + ", ".join(f"round(quantile_cont({c}, {p / 100!r}), 6) AS {c}" for c, p in CUTS.items()) + " FROM ch")
def percentile_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return masks.thresholds(channels(spark, d), CUTS).select(*(F.round(c, 6).alias(c) for c in CUTS))


LIMITS = "t AS (SELECT " + ", ".join(f"quantile_cont({c}, {p / 100!r}) AS t_{c}" for c, p in CUTS.items()) + " FROM ch)"
HITS = " + ".join(f"CAST({c} >= t_{c} - 1e-12 AS BIGINT)" for c in CUTS)


@query(with_(G, CH, LIMITS) + f"SELECT r, c, {HITS} AS hits, ({HITS}) >= 2 AS strict, ({HITS}) >= 1 AS loose FROM ch, t")
def vote_mask(spark: SparkSession, d: str) -> DataFrame:
    df = masks.vote(channels(spark, d), CUTS, 4)
    return df.select("r", "c", F.col("hits").cast("long").alias("hits"), F.col("mask").alias("strict"), (F.col("hits") >= 1).alias("loose"))


@query(with_(G, CH) + f"SELECT r, c, (linear >= 0.9 AND (ridge_valley >= {masks.ridge_floor(LEVEL)} OR coherence >= 0.6)) OR annular >= 0.95 AS seed FROM ch")
def seed_mask(spark: SparkSession, d: str) -> DataFrame:
    straight = (F.col("linear") >= 0.9) & ((F.col("ridge_valley") >= masks.ridge_floor(LEVEL)) | (F.col("coherence") >= 0.6))
    return channels(spark, d).select("r", "c", (straight | (F.col("annular") >= 0.95)).alias("seed"))


B = "b AS (SELECT r, c, CASE WHEN linear >= 0.9 THEN 1 ELSE 0 END AS m FROM ch)"


def binary(spark: SparkSession, d: str) -> DataFrame:
    return channels(spark, d).select("r", "c", F.when(F.col("linear") >= 0.9, 1).otherwise(0).alias("m"))


@query(
    with_(G, CH, B, sql_box("b", "m", 1, "max", "sq"), "cr AS (SELECT a.r, a.c, max(b.m) AS v FROM b a JOIN b ON abs(a.r - b.r) + abs(a.c - b.c) <= 2 GROUP BY 1, 2)")
    + "SELECT r, c, CAST(sq.v AS BIGINT) AS square, CAST(cr.v AS BIGINT) AS diamond FROM sq JOIN cr USING (r, c)"
)
def dilate(spark: SparkSession, d: str) -> DataFrame:
    df = masks.dilate_cross(masks.dilate(binary(spark, d), "m", 3, "square"), "m", 2, "diamond")
    return df.select("r", "c", F.col("square").cast("long").alias("square"), F.col("diamond").cast("long").alias("diamond"))


@query(
    with_(G, CH, B, sql_box("b", "m", 1, "max", "di"), "er AS (SELECT a.r, a.c, min(d.v) AS v, count(*) AS n FROM di a JOIN di d ON d.r BETWEEN a.r - 1 AND a.r + 1 AND d.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2)")
    + "SELECT r, c, CAST(CASE WHEN n = 9 THEN v ELSE 0 END AS BIGINT) AS closed FROM er"
)
def close(spark: SparkSession, d: str) -> DataFrame:
    return masks.close(binary(spark, d), "m", 1, "closed").select("r", "c", F.col("closed").cast("long").alias("closed"))


@query(with_(G, sql_box("g", "v", 3, "max", "mx"), "q AS (SELECT quantile_cont(v, 0.76) AS q FROM g)") + "SELECT r, c, g.v >= mx.v AND g.v >= q AS peak FROM g JOIN mx USING (r, c), q")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    cells = stats.with_facts(grid.surface(spark, d), stats.quantile("v", 0.76).alias("q"))
    return masks.local_maxima(cells, "v", 7, F.col("v") >= F.col("q"), "peak").select("r", "c", "peak")


MASK = "k AS (SELECT r, c, v, r * 32 + c AS id FROM ch WHERE linear >= 0.8)"
LABELS = """e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1), reach(id, other) AS (SELECT id, id FROM k UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
lab AS (SELECT k.r, k.c, k.v, l.label FROM k JOIN (SELECT id, min(other) AS label FROM reach GROUP BY 1) l USING (id))"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def masked(spark: SparkSession, d: str) -> DataFrame:
    return channels(spark, d).withColumn("k", F.col("linear") >= 0.8).persist()


@query(recursive(G, CH, MASK, LABELS) + "SELECT r, c, label FROM lab")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return masks.components(masked(spark, d), "k", SIDE)


@query(
    recursive(G, CH, MASK, LABELS)
    + """SELECT label, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, round(avg(v), 6) AS mean, arg_max(v, abs(v) * 1e6 - r * 32 - c) AS peak,
round(quantile_cont(v, 0.82), 6) AS q82, round(quantile_cont(v, 0.85), 6) AS q85 FROM lab GROUP BY label"""
)
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    cells = masked(spark, d)
    out = masks.component_stats(masks.components(cells, "k", SIDE), cells.select("r", "c", "v"), "v")
    return out.select("label", "n", "r0", "r1", "c0", "c1", F.round("mean", 6).alias("mean"), "peak", F.round("q82", 6).alias("q82"), F.round("q85", 6).alias("q85"))


CORE = """k2 AS (SELECT r, c, r * 32 + c AS id FROM ch WHERE linear >= 0.93), e2 AS (SELECT a.id AS a, b.id AS b FROM k2 a JOIN k2 b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach2(id, other) AS (SELECT id, id FROM k2 UNION SELECT reach2.id, e2.b FROM reach2 JOIN e2 ON e2.a = reach2.other), lab2 AS (SELECT k2.r, k2.c, l.label FROM k2 JOIN (SELECT id, min(other) AS label FROM reach2 GROUP BY 1) l USING (id)),
big AS (SELECT coalesce(max(n), 0) > 6 AS yes FROM (SELECT count(*) AS n FROM lab GROUP BY label))"""


@query(recursive(G, CH, MASK, LABELS, CORE) + "SELECT r, c, label FROM lab2 WHERE (SELECT yes FROM big) UNION ALL SELECT r, c, label FROM lab WHERE NOT (SELECT yes FROM big)")
def resegment_oversized(spark: SparkSession, d: str) -> DataFrame:
    cells = masked(spark, d).withColumn("core", F.col("linear") >= 0.93)
    return masks.resegment(cells, "k", "core", 6, SIDE)


@query(with_(G, "q AS (SELECT r % 8 AS zone, quantile_cont(v, 0.72) AS q FROM g GROUP BY 1)") + "SELECT zone, round(avg(v), 6) AS tail FROM g JOIN q ON q.zone = g.r % 8 WHERE v >= q - 1e-9 GROUP BY 1")
def tail_mean(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.surface(spark, d).withColumn("zone", F.col("r") % 8)
    return stats.tail_mean(cells, ["zone"], "v", 0.72, "tail").select("zone", F.round("tail", 6).alias("tail"))


NINE = ("max_relief", "persistence", "linear", "annular", "ridge_valley", "texture", "coherence", "terrain_novelty", "archaeology")


@query(recursive(G, CH, MASK, LABELS) + "SELECT label, " + ", ".join(f"round(quantile_cont(ch.{c}, {q}), 6) AS {c}_{int(q * 100)}" for c in NINE for q in (0.5, 0.8, 0.92)) + " FROM lab JOIN ch USING (r, c) GROUP BY label")
def descriptor27(spark: SparkSession, d: str) -> DataFrame:
    cells = masked(spark, d)
    out = masks.descriptor(masks.components(cells, "k", SIDE), cells.select("r", "c", *NINE), list(NINE))
    return out.select("label", *(F.round(c, 6).alias(c) for c in out.columns if c != "label"))


KINDS = "CASE (s_nationkey % 6) WHEN 0 THEN 'building' WHEN 1 THEN 'road' WHEN 2 THEN 'track' WHEN 3 THEN 'path' WHEN 4 THEN 'boundary' ELSE 'water' END"
MODERN_SQL = "w(kind, w, k) AS (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE, {x}::DOUBLE)" for k, (w, x) in masks.MODERN.items()) + ")"


@query(
    with_(G, MODERN_SQL, f"mk AS (SELECT DISTINCT s_suppkey % 32 AS r, (s_suppkey * 7) % 31 AS c, {KINDS} AS kind FROM supplier)")
    + "SELECT g.r, g.c, round(coalesce(max(w * exp(-sqrt((g.r - mk.r) ** 2 + (g.c - mk.c) ** 2) / k)), 0), 6) AS penalty FROM g LEFT JOIN mk ON true LEFT JOIN w USING (kind) GROUP BY 1, 2"
)
def modern_penalty(spark: SparkSession, d: str) -> DataFrame:
    marks = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") % SIDE).alias("r"), (F.col("s_suppkey") * 7 % 31).alias("c"), F.expr(KINDS).alias("kind"))
    return rounded(masks.modern_penalty(grid.surface(spark, d).select("r", "c"), marks), "penalty")


BANDS = """bands AS (SELECT l_orderkey % 32 AS r, l_partkey % 32 AS c, CAST(extract(year FROM l_shipdate) AS BIGINT) AS scene, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS nir, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS red FROM lineitem GROUP BY 1, 2, 3),
nd AS (SELECT r, c, scene, CASE WHEN abs(nir + red) > 1e-6 THEN (nir - red) / (nir + red) END AS ndvi FROM bands)"""


def ndvi_frame(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    part = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    bands = items.groupBy((F.col("l_orderkey") % SIDE).alias("r"), (F.col("l_partkey") % SIDE).alias("c"), F.year("l_shipdate").cast("long").alias("scene"))
    bands = bands.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("nir"), F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(0.0)).alias("red"))
    whole = F.col("nir") + F.col("red")
    return bands.select("r", "c", "scene", F.when(F.abs(whole) > 1e-6, (F.col("nir") - F.col("red")) / whole).alias("ndvi"))


@query(with_(BANDS) + "SELECT r, c, scene, round(ndvi, 6) + 0.0 AS ndvi FROM nd")
def ndvi(spark: SparkSession, d: str) -> DataFrame:
    return ndvi_frame(spark, d).select("r", "c", "scene", (F.round("ndvi", 6) + 0.0).alias("ndvi"))


@query(with_(BANDS) + "SELECT r, c, round(quantile_cont(ndvi, 0.5), 6) + 0.0 AS ndvi FROM nd GROUP BY 1, 2")
def scene_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ndvi_frame(spark, d).groupBy("r", "c").agg(F.percentile("ndvi", F.lit(0.5)).alias("ndvi")), "ndvi")


@query(with_(G, sql_gauss("g", "v", 3.0, "bg"), "o AS (SELECT r, c, abs(g.v - bg.v) AS o FROM g JOIN bg USING (r, c))", "m AS (SELECT quantile_cont(o, 0.5) AS m FROM o)") + "SELECT r, c, round(greatest(0, least(1, o / greatest(6 * m, 1e-6))), 6) AS anomaly FROM o, m")
def spectral_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.spectral_anomaly(grid.surface(spark, d), "v"), "anomaly")


@query(with_(G) + "SELECT r, c, CAST(v AS DOUBLE) AS v FROM g WHERE r % 4 = 0 AND c % 4 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return terrain.stride(grid.surface(spark, d), 4)


@query(
    with_(G, "q AS (SELECT r // 4 AS r, c // 4 AS c, v FROM g WHERE r % 4 = 0 AND c % 4 = 0)", "p AS (SELECT r, c, r * 7 / 31.0::DOUBLE AS y, c * 7 / 31.0::DOUBLE AS x FROM g)")
    + """SELECT p.r, p.c, round(sum(q.v * (1 - abs(y - q.r)) * (1 - abs(x - q.c))), 6) AS v FROM p JOIN q ON abs(y - q.r) < 1 AND abs(x - q.c) < 1 GROUP BY 1, 2"""
)
def zoom_bilinear(spark: SparkSession, d: str) -> DataFrame:
    coarse = terrain.stride(grid.surface(spark, d), 4).select((F.col("r") / 4).cast("long").alias("r"), (F.col("c") / 4).cast("long").alias("c"), "v")
    return rounded(terrain.zoom(coarse, 4, SIDE), "v")


@query()
def hough_lines(spark: SparkSession, d: str) -> DataFrame:
    return masks.hough(masked(spark, d), "k", 6)
