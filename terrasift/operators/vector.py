"""Vector features: classes, names, boxes, joins by range, similarity and scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import stats
from ..functions.durable import durable
from ..functions.ship import ship
from ..functions.stats import clip

# Words that tell a feature's class, in the order in which they are tried.
OS_CLASSES = (
    ("building", ("building",)),
    ("path", ("footpath", "bridleway", "cycleway", "pedestrian", "path")),
    ("track", ("track",)),
    ("road", ("road", "motorway", "trunk", "street", "carriageway")),
    ("boundary", ("fence", "hedge", "wall", "boundary")),
)
PATHS = ("footway", "path", "pedestrian", "bridleway", "cycleway", "steps")
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street", "road")
BARRIERS = ("fence", "wall", "hedge")
#: Colours by mapped layer, its aliases, and words that stand for a layer where none is given.
COLOURS = {"Bank": "#A50026", "Ditch": "#313695", "Extent of Feature": "#FDAE61", "Ridge and Furrow Alignment": "#74ADD1", "Ridge and Furrow Area": "#74ADD1", "Slope": "#4575B4", "Structure": "#F46D43"}
DEFAULT_COLOUR = "#5B6470"
ALIASES = {"bank": "Bank", "banks": "Bank", "ditch": "Ditch", "ditches": "Ditch", "extent of feature": "Extent of Feature", "ridge and furrow alignment": "Ridge and Furrow Alignment", "ridge and furrow area": "Ridge and Furrow Area", "slope": "Slope", "scarp slope edge": "Slope", "scarp slope/edge": "Slope", "structure": "Structure", "structures": "Structure"}
SEMANTIC = (("Ditch", ("ditch", "pit", "hollow", "pond", "cut")), ("Bank", ("bank", "mound", "barrow", "embankment", "platform", "earthwork")), ("Slope", ("slope", "scarp")), ("Structure", ("structure", "building", "hut", "mast", "camp")))
#: Letters of the 100 km squares of the British grid, from the south-west, a row for each 100 km north.
SQUARES = (
    ("SV", "SW", "SX", "SY", "SZ", "TV", "TW"),
    ("SQ", "SR", "SS", "ST", "SU", "TQ", "TR"),
    ("SL", "SM", "SN", "SO", "SP", "TL", "TM"),
    ("SF", "SG", "SH", "SJ", "SK", "TF", "TG"),
    ("SA", "SB", "SC", "SD", "SE", "TA", "TB"),
    ("NV", "NW", "NX", "NY", "NZ", "OV", "OW"),
    ("NQ", "NR", "NS", "NT", "NU", "OQ", "OR"),
    ("NL", "NM", "NN", "NO", "NP", "OL", "OM"),
    ("NF", "NG", "NH", "NJ", "NK", "OF", "OG"),
    ("NA", "NB", "NC", "ND", "NE", "OA", "OB"),
    ("HV", "HW", "HX", "HY", "HZ", "JV", "JW"),
    ("HQ", "HR", "HS", "HT", "HU", "JQ", "JR"),
    ("HL", "HM", "HN", "HO", "HP", "JL", "JM"),
)


def normalise(text: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_-", "  "), r"\s+", " "))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def first_match(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(rules):
        out = F.when(_any(text, words), F.lit(name)).otherwise(out)
    return out


def os_class(layer: Column, properties: Column) -> Column:
    return first_match(normalise(F.concat_ws(" ", layer, properties)), OS_CLASSES)


def osm_class(building: Column, barrier: Column, natural: Column, highway: Column) -> Column:
    way = F.lower(F.coalesce(highway, F.lit("")))
    return (
        F.when(building.isNotNull(), "building")
        .when(barrier.isin(*BARRIERS) | (natural == "hedge"), "boundary")
        .when(way.isin(*PATHS), "path")
        .when(way == "track", "track")
        .when(way.isin(*ROADS), "road")
    )


def style(layer: Column, kind: Column) -> Column:
    """Colour by layer, else by what the type says."""
    known = F.create_map(*(F.lit(x) for a, b in ALIASES.items() for x in (a, COLOURS[b])))
    said = normalise(kind)
    ridge = F.when(F.contains(said, F.lit("ridge")) & F.contains(said, F.lit("furrow")), F.lit("Ridge and Furrow Area"))
    name = F.coalesce(first_match(said, SEMANTIC[:2]), ridge, first_match(said, SEMANTIC[2:]))
    colours = F.create_map(*(F.lit(x) for k in COLOURS.items() for x in k))
    return F.coalesce(known[normalise(layer)], colours[name], F.lit(DEFAULT_COLOUR))


def first_non_empty(*cols: Column) -> Column:
    """The first value that is neither null nor '' nor '-'."""
    return F.coalesce(*(F.when(~F.trim(c).isin("", "-"), F.trim(c)) for c in cols))


def grid_square(easting: Column, northing: Column) -> Column:
    """Letters of the 100 km square; null outside the grid."""
    rows = F.array(*(F.array(*(F.lit(x) for x in row)) for row in SQUARES))
    n, e = F.floor(northing / 100_000).cast("int"), F.floor(easting / 100_000).cast("int")
    return F.when((n >= 0) & (e >= 0), F.get(F.get(rows, n), e))


def tile_x(lon: Column, zoom: int) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 360 * 2**zoom), F.lit(0)), F.lit(2**zoom - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    rad = F.radians(lat)
    return F.least(F.greatest(F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * 2**zoom), F.lit(0)), F.lit(2**zoom - 1)).cast("long")


def tiles(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) cut into tiles, column by column; the last of a row or column is clipped."""
    if size <= 0:
        raise ValueError("tiles need a positive size")

    def steps(a: str, b: str) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a) - 1e-9) / size).cast("int")) - 1)

    each = boxes.withColumn("i", F.explode(steps("x0", "x1"))).withColumn("j", F.explode(steps("y0", "y1")))
    x, y = F.col("x0") + F.col("i") * size, F.col("y0") + F.col("j") * size
    return each.select("id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), x.alias("tx0"), y.alias("ty0"), F.least(x + size, "x1").alias("tx1"), F.least(y + size, "y1").alias("ty1"))


def feature_scale(w: Column, h: Column, area: Column) -> Column:
    """Patch size for a feature: two and a half times its extent, 32 to 256."""
    return clip(2.5 * F.greatest(w, h, 2 * F.sqrt(area / math.pi)), 32.0, 256.0)


def _binned(boxes: DataFrame, size: float) -> DataFrame:
    def steps(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))

    return boxes.withColumn("_bx", F.explode(steps("x0", "x1"))).withColumn("_by", F.explode(steps("y0", "y1")))


def overlapping(left: DataFrame, right: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """Pairs (left id, right id) whose boxes, the left ones widened by pad, touch.

    Boxes are dealt to square bins and met by an equi-join; a pair counts only in the bin that holds the lower corner of
    its overlap, so no pair has to be made distinct.
    """
    wide = left.select(*(c for c in left.columns if c not in ("x0", "y0", "x1", "y1")), *((F.col(c) - pad).alias(c) for c in ("x0", "y0")), *((F.col(c) + pad).alias(c) for c in ("x1", "y1")))
    a = _binned(wide, size)
    b = _binned(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumnsRenamed({f"r_{c}": c for c in ("x0", "y0", "x1", "y1")}), size)
    a = a.withColumnsRenamed({c: f"l_{c}" for c in a.columns if c not in ("_bx", "_by")})
    b = b.withColumnsRenamed({c: f"r_{c}" for c in ("x0", "y0", "x1", "y1")})
    j = a.join(b, ["_bx", "_by"])
    x, y = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    touch = (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
    return j.where(touch & (F.floor(x / size) == F.col("_bx")) & (F.floor(y / size) == F.col("_by"))).drop("_bx", "_by")


def overlap_area() -> Column:
    """Of a row of overlapping()."""
    w = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    h = F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0")
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def box_classes(boxes: DataFrame) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1, ...) as one row for those that are equal in all but id: the smallest id, and how many there are."""
    return boxes.groupBy(*(c for c in boxes.columns if c != "id")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def clear_of(points: DataFrame, boxes: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """The ids of the points (id, x, y) that lie in none of the boxes (x0, y0, x1, y1) widened by pad.

    A place has one bin, so that the join stops at its first box; a point without a place lies in no box.
    """
    wide = boxes.select(*((F.col(c) - pad).alias(c) for c in ("x0", "y0")), *((F.col(c) + pad).alias(c) for c in ("x1", "y1"))).distinct()
    places = points.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    places = places.withColumn("_bx", F.floor(F.col("x") / size)).withColumn("_by", F.floor(F.col("y") / size))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    b = _binned(wide, size).withColumnsRenamed({"_bx": "_cx", "_by": "_cy"})
    hit = places.join(b, (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy")) & inside, "left_semi")
    return points.select("id", "x", "y").join(hit.select("x", "y"), ["x", "y"], "left_anti").select("id")


def box_metrics(w: Column, h: Column) -> dict[str, Column]:
    """Shape of a rectangle: area, perimeter, elongation, circularity, rectangularity, convexity."""
    area, perimeter = F.greatest(w * h, F.lit(1e-6)), F.greatest(2 * (w + h), F.lit(1e-6))
    return {
        "area": area, "perimeter": perimeter, "elongation": F.least(F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-6)), F.lit(100.0)),
        "circularity": 4 * math.pi * area / (perimeter * perimeter), "rectangularity": area / F.greatest(w * h, area), "convexity": F.lit(1.0),
    }


def morphology(elongation: Column, circularity: Column, rectangularity: Column, holes: Column, linear: Column) -> Column:
    """0.20 + 0.27 ring + 0.25 compact + 0.28 line, clipped."""
    ring = F.when(holes > 0, 1.0).otherwise(clip((circularity - 0.28) / 0.52))
    line = clip((elongation - 2.5) / 10) * clip(linear)
    return clip(0.20 + 0.27 * ring + 0.25 * (0.55 * circularity + 0.45 * rectangularity) + 0.28 * line)


def signature(m: dict[str, Column], holes: Column) -> list[Column]:
    """Six terms of a shape."""
    return [F.log1p(m["elongation"]), m["circularity"], m["rectangularity"], m["convexity"], F.least(holes.cast("double"), F.lit(4.0)), F.log1p(m["perimeter"] / F.greatest(F.sqrt(m["area"]), F.lit(1.0)))]


def angle_between(a: Column, b: Column) -> Column:
    """Of undirected lines, 0..90 degrees."""
    d = F.abs(a - b) % 180
    return F.least(d, 180 - d)


#: References that go to the executors at a time.
BANK = 20_000
#: Scales of the six terms of a shape's signature.
SHAPE_SCALES = (4.615, 1.0, 1.0, 1.0, 1.0, 2.0)


def _scale(off: np.ndarray) -> np.ndarray:
    return np.maximum(1.4826 * off, 0.25)


def _median_without(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """For each x, one of the ordered values: the median of the others."""
    k0, k1 = (len(ordered) - 2) // 2, (len(ordered) - 1) // 2
    low, high = (np.where(x > ordered[k], ordered[k], ordered[k + 1]) for k in (k0, k1))
    return (low + high) / 2


def scales_without(uids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of the values x the scale of the values of other uids: 1.4826 MAD, 0.25 at least; 1 where there are fewer than two.

    Without one value the median is one of three at most, so each is taken once; only uids that repeat are taken one by one.
    """
    n = len(x)
    kinds, at, copies = np.unique(uids, return_inverse=True, return_counts=True)
    out = np.ones(n)
    if n > 2:
        middle = _median_without(x, np.sort(x))
        for m in np.unique(middle[copies[at] == 1]):
            off, rows = np.abs(x - m), middle == m
            out[rows] = _scale(_median_without(off[rows], np.sort(off)))
    for k in np.flatnonzero(copies > 1):
        rest = x[at != k]
        out[at == k] = _scale(np.median(np.abs(rest - np.median(rest)))) if len(rest) > 1 else 1.0
    return out


def _own_scales(bank: DataFrame, names: list[str]) -> DataFrame:
    """(_uid, scales by name) for each uid of the bank. A task holds one column of the bank."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"_uid": part["uid"], "name": part["name"], "scale": scales_without(part["uid"].to_numpy(), part["x"].to_numpy(float))})
        return out.drop_duplicates("_uid")

    schema = StructType([StructField("_uid", bank.schema["uid"].dataType), StructField("name", LongType()), StructField("scale", DoubleType())])
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("name"), F.col(c).cast("double").alias("x")) for i, c in enumerate(names)))).alias("e")
    long = bank.select("uid", each).select("uid", "e.*").groupBy("name").applyInPandas(one, schema)
    return long.groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct("name", "scale"))).alias("_s")).select("_uid", F.transform("_s", lambda e: e["scale"]).alias("_scales"))  # as many values as names


def similarity(rows: DataFrame, bank: DataFrame, names: list[str], leave_out: bool = False, shape: list[str] | None = None, block: int = BANK) -> DataFrame:
    """Nearest reference of each row: label, uid and exp(-2 * distance), where the distance is 0.88 of the RMS difference in
    robust units and, with `shape` (columns of rows and bank), 0.12 of the signatures' in SHAPE_SCALES.

    rows: id, the descriptor's columns (and uid with leave_out: references of that uid don't count, neither as nearest
    nor in the scale). References go to the executors `block` at a time, so any number of them is compared; ties take
    the smallest uid. Without any reference no row comes out.
    """
    ship(rows.sparkSession)
    shape = shape or []
    n = bank.count()
    whole = np.ones(len(names))
    if n > 1:
        middle = stats.quantiles(bank, {c: (c, 0.5) for c in names})
        off = stats.quantiles(bank, {c: (F.abs(F.col(c) - middle[c]), 0.5) for c in names})
        whole = np.array([max(1.4826 * off[c], 0.25) for c in names])
    columns = ["id", *(["uid"] if leave_out else []), *names, *shape]
    if leave_out:
        own = _own_scales(bank, names)
        rows = durable(rows.select(*columns).join(own, F.col("uid") == F.col("_uid"), "left").drop("_uid"))
        columns.append("_scales")
    kinds = {f.name: f.dataType for f in bank.schema}
    schema = StructType([rows.schema["id"], StructField("dist", DoubleType()), StructField("match", kinds["uid"]), StructField("label", kinds["label"])])

    def against(part: pd.DataFrame) -> DataFrame:
        part = part.sort_values("uid", ignore_index=True)
        refs, forms = part[names].to_numpy(float), part[shape].to_numpy(float) / np.array(SHAPE_SCALES[: len(shape)])
        uids, labels = part["uid"].to_numpy(), part["label"].to_numpy()
        centre = refs.mean(axis=0) if len(refs) else whole
        moved = refs - centre

        def close(x: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows by references: the squares of distances, up to rounding, and what rounding may add or take."""
            w, y = scales**-2.0, x - centre
            parts = (moved**2) @ w.T, moved @ (y * w).T, (y**2 * w).sum(axis=1)
            return (parts[0] - 2 * parts[1] + parts[2]).T, 1e-9 * (parts[0].max(axis=0) + parts[2])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in (b.iloc[k : k + 200] for b in batches for k in range(0, len(b), 200)):
                x, f = b[names].to_numpy(float), b[shape].to_numpy(float) / np.array(SHAPE_SCALES[: len(shape)])
                scales = np.array([whole if s is None else s for s in b["_scales"]]) if leave_out else np.tile(whole, (len(b), 1))
                square, slack = close(x, scales) if len(refs) and not shape else (None, None)
                out = []
                for i, key in enumerate(b["id"]):
                    use = np.flatnonzero(uids != b["uid"].iloc[i]) if leave_out else np.arange(len(refs))
                    if len(use) and not shape and np.isfinite(square[i]).all():  # the exact distances decide among the closest
                        use = use[square[i][use] <= square[i][use].min() + slack[i]]
                    if not len(use):
                        continue
                    d = 0.88 * np.sqrt((((refs[use] - x[i]) / scales[i]) ** 2).mean(axis=1))
                    if shape:
                        d = d + 0.12 * np.sqrt(((forms[use] - f[i]) ** 2).mean(axis=1))
                    k = int(np.argmin(d))
                    out.append((key, float(d[k]), uids[use][k], labels[use][k]))
                yield pd.DataFrame(out, columns=["id", "dist", "match", "label"])

        return rows.select(*columns).mapInPandas(run, schema)

    blocks = -(-n // block)
    part = F.pmod(F.xxhash64("uid"), F.lit(max(1, 2 * blocks if blocks > 1 else 1)))
    found = [against(bank.where(part == i).select("uid", "label", *names, *shape).toPandas()) for i in range(max(1, 2 * blocks if blocks > 1 else 1))]
    best = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        best = best.groupBy("id").agg(F.min(F.struct("dist", "match", "label")).alias("b")).select("id", "b.*")
    return best.select("id", "label", "match", F.exp(-2 * F.col("dist")).alias("similarity"))


def best_named(points: DataFrame, features: DataFrame, reach: float, score: Column) -> DataFrame:
    """For each point (id, x, y) the name of the feature (key, name, fx, fy, ...) within reach that scores highest; ties take the smallest key.

    The score may use dist and any column of the features but key and name. Points at one place and features that differ in
    key and name alone are met once, so pairs grow with the places and not with the rows.
    """
    bins = F.sequence(F.lit(-1), F.lit(1))
    places = points.select("x", "y").distinct()
    p = places.withColumn("_bx", F.explode(F.transform(bins, lambda k: F.floor(F.col("x") / reach) + k))).withColumn("_by", F.explode(F.transform(bins, lambda k: F.floor(F.col("y") / reach) + k)))
    kinds = features.groupBy(*(c for c in features.columns if c not in ("key", "name"))).agg(F.min_by("name", "key").alias("name"), F.min("key").alias("key"))
    f = kinds.withColumn("_bx", F.floor(F.col("fx") / reach)).withColumn("_by", F.floor(F.col("fy") / reach))
    dx, dy = F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    near = p.join(f, ["_bx", "_by"]).withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= reach)
    rank = F.struct(score.alias("s"), (-F.col("key")).alias("k"))
    best = near.groupBy("x", "y").agg(F.max_by("name", rank).alias("_n"), F.max(rank).alias("_b"))
    return points.select("id", "x", "y").join(best, ["x", "y"]).groupBy("id").agg(F.max_by("_n", "_b").alias("name"), F.max("_b.s").alias("score"))


#: Weights of a candidate's score without and with a stored model.
CANDIDATE = {
    "plain": {"discovery": 0.28, "lidar": 0.15, "persistence": 0.12, "morphology": 0.10, "linear": 0.10, "annular": 0.10, "ridge": 0.07, "novelty": 0.06, "texture": 0.04, "archaeology": 0.18, "satellite": 0.02, "similarity": 0.08},
    "stored": {"discovery": 0.12, "lidar": 0.08, "persistence": 0.08, "morphology": 0.08, "linear": 0.08, "annular": 0.08, "ridge": 0.06, "novelty": 0.04, "texture": 0.03, "archaeology": 0.13, "trained": 0.24, "satellite": 0.02, "similarity": 0.08},
}


def candidate_score(kind: str) -> Column:
    """0..100: weighted evidence and bonuses, less a share for modern surroundings."""
    terms = [F.col(c) * w for c, w in CANDIDATE[kind].items()]
    bonus = (
        F.when((F.col("linear") >= 0.65) & (F.col("elongation") >= 7), 0.05).otherwise(0.0)
        + F.when((F.col("annular") >= 0.65) & (F.col("circularity") >= 0.42), 0.07).otherwise(0.0)
        + F.when(F.col("novelty") >= 0.70, 0.05).otherwise(0.0)
    )
    return 100 * clip((sum(terms[1:], terms[0]) + bonus) * (1 - 0.74 * F.col("penalty")))


def reasons() -> Column:
    """Why a candidate stands out: the rules that hold, in a fixed order."""
    c = F.col
    rules = (
        ("coherent shape", c("morphology") >= 0.63),
        ("closed ring", (c("holes") > 0) | ((c("annular") >= 0.62) & (c("circularity") >= 0.35))),
        ("visible at several scales", c("persistence") >= 0.34),
        ("straight line", c("linear") >= 0.52),
        ("very long", c("elongation") >= 8),
        ("ridge or hollow", c("ridge") >= 0.60),
        ("unusual terrain", c("novelty") >= 0.58),
        ("unusual texture", c("texture") >= 0.58),
        ("like mapped archaeology", c("archaeology") >= 0.62),
        ("stored model agrees", c("trained") >= 0.55),
        ("seen from above", c("satellite") >= 0.20),
        ("like a known feature", c("similarity") >= 0.68),
        ("near modern features", c("penalty") >= 0.65),
    )
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules)))


def ranked(candidates: DataFrame, most: int, level: int) -> DataFrame:
    """The best candidates that aren't rejected, numbered and classified. The limit bounds the numbering's one partition."""
    modern = (F.col("penalty") >= 0.97) & (F.col("elongation") < 6) & (F.col("morphology") < 0.55)
    order = [F.col(x).desc() for x in ("score", "novelty", "linear", "annular", "relief")]
    top = candidates.where(~modern).orderBy(*order, "id").limit(most)
    number = F.row_number().over(W.orderBy(*order, "id"))
    return top.withColumn("rank", number).withColumn("class", F.when(F.col("score") >= 74 - 0.8 * level, "high-priority").otherwise("candidate"))


def reranked(candidates: DataFrame) -> DataFrame:
    """Retained candidates (score, trained) with the stored model's probability blended in, in their new order and numbered anew.

    The numbering's one partition has the candidates that were retained, whose number is bounded."""
    score = F.round(100 * clip(0.42 * F.col("score") / 100 + 0.58 * F.col("trained")), 6)
    out = candidates.withColumn("score", score).withColumn("support", F.when(F.col("trained") >= 0.8, "strong").when(F.col("trained") >= 0.62, "supporting"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), F.col("trained").desc(), "id")))


def spaced(frames: DataFrame, key: str, day: str, gap: int, most: int) -> DataFrame:
    """Per key: greedily from the latest day, days at least `gap` apart from all chosen, `most` of them."""
    days = F.sort_array(F.collect_set(F.unix_date(F.to_date(day))), asc=False)
    chosen = F.aggregate(days, F.array().cast("array<int>"), lambda a, d: F.when((F.size(a) < most) & ((F.size(a) == 0) | (F.element_at(a, -1) - d >= gap)), F.concat(a, F.array(d))).otherwise(a))
    return frames.groupBy(key).agg(chosen.alias("_d")).select(key, F.posexplode("_d").alias("pos", "d")).select(key, F.col("pos").cast("long").alias("pos"), F.date_from_unix_date("d").alias("day"))
