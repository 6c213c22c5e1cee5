"""Records of features, candidates and runs: labels, keys, filters, counters and what goes to sinks."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip

# Property names in the order in which they are tried (without names that one program stamps on its own copies), generic values, words of names.
LABEL_KEYS = ("MONUMENT_TYPE", "MONUMENT_TYPE_ID", "TYPE", "LAYER", "EVIDENCE_1", "source")
GENERIC_LABELS = ("aerial archaeology mapping", "historic england aim")
UNKNOWN_LABEL = "Unknown Historic England feature"
UID_KEYS = {
    "catalogue": (("HE_UID", "DHEUID_1", "HER_NO", "HERNO_1", "OBJECTID", "FID", "id"), "feature-"),
    "detector": (("HE_UID", "UID", "MONUMENT_UID", "OBJECTID", "FID"), "HE-"),
    "record": (("HE_UID", "DHEUID_1", "HER_NO", "HERNO_1", "OBJECTID"), "feature-"),
}
NAME_WORDS = ("name", "site", "place", "location", "monument")
NOT_NAME_WORDS = ("uid", "guid", "id", "type", "period", "evidence", "source")


def feature_label(properties: Column) -> Column:
    """The first property of LABEL_KEYS that says something: neither blank nor a generic value."""
    said = [F.trim(properties[k]) for k in LABEL_KEYS]
    return F.coalesce(*(F.when((v != "") & ~F.lower(v).isin(*GENERIC_LABELS), v) for v in said), F.lit(UNKNOWN_LABEL))


def feature_uid(properties: Column, index: Column, kind: str) -> Column:
    """The first property that isn't blank, by the kind's priority; else its prefix and the index."""
    keys, prefix = UID_KEYS[kind]
    return F.coalesce(*(F.when(F.trim(properties[k]) != "", F.trim(properties[k])) for k in keys), F.concat(F.lit(prefix), index.cast("string")))


def name_values(properties: Column) -> Column:
    """Trimmed values of the properties whose names speak of a name and not of an identifier or a class, in order of the names, each once."""

    def speaks(key: Column) -> Column:
        low = F.lower(key)
        return low.rlike("|".join(NAME_WORDS)) & ~low.rlike("|".join(NOT_NAME_WORDS))

    kept = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: speaks(k) & (F.trim(F.coalesce(v, F.lit(""))) != ""))))
    return F.array_distinct(F.transform(kept, lambda e: F.trim(e["value"])))


def raster_only(kind: Column) -> Column:
    return F.contains(F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lit("raster"))


def finite(x: Column) -> Column:
    """What a diagnostic raster stores: 0 for NaN, null and minus infinity, 1 for infinity."""
    return F.when(x.isNull() | F.isnan(x) | (x == float("-inf")), 0.0).when(x == float("inf"), 1.0).otherwise(x)


def squares_of_bounds(x0: Column, y0: Column, x1: Column, y1: Column, square) -> Column:  # noqa: ANN001
    """Sorted squares under a box's corners; an edge that lies on a border belongs to the square below it."""
    eps = 1e-6
    return F.array_sort(F.array_distinct(F.array(square(x0, y0), square(x1 - eps, y0), square(x0, y1 - eps), square(x1 - eps, y1 - eps))))


def viewport(width: Column, height: Column, aspect: Column) -> dict[str, Column]:
    """Where a map of that aspect lies in an image, in percent of its sides, and its pixels."""
    wide = aspect >= width / height
    w = F.when(wide, width.cast("double")).otherwise(F.greatest(F.lit(1.0), F.rint(height * aspect)))
    h = F.when(wide, F.greatest(F.lit(1.0), F.rint(width / aspect))).otherwise(height.cast("double"))
    return {"left": (width - w) / 2 / width * 100, "top": (height - h) / 2 / height * 100, "w_share": w / width * 100, "h_share": h / height * 100, "w": w.cast("long"), "h": h.cast("long")}


def study_error(lat: Column, lon: Column, diameter: Column) -> Column:
    """Why a study area is refused; null if it isn't."""
    return (
        F.when(~lat.between(-90, 90), "latitude must be between -90 and 90")
        .when(~lon.between(-180, 180), "longitude must be between -180 and 180")
        .when(diameter <= 0, "diameter must be greater than zero")
        .when(diameter > 10_000, "diameter must not exceed 10,000 m")
    )


def mercator_inverse(x: Column, y: Column, radius: float = 6_378_137.0) -> tuple[Column, Column]:
    """Longitude and latitude of web Mercator metres."""
    return F.degrees(x / radius), F.degrees(2 * F.atan(F.exp(y / radius)) - math.pi / 2)


def shape_similarity(signature: Column, reference: Column) -> Column:
    """exp(-0.7 d) of two signatures' Euclidean distance."""
    squares = F.zip_with(signature, reference, lambda a, b: (a - b) * (a - b))
    return F.exp(-0.7 * F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)))


def last_value_first_place(rows: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Per key the last row's value at the first row's place."""
    return rows.groupBy(*keys).agg(F.min(place).alias(place), F.max_by(value, place).alias(value))


def holdout_groups(rows: DataFrame, group: str, share: int = 20) -> DataFrame:
    """rows with held_out: the groups of the smallest hashes, share percent of them and one at least; a single group is never held out (then there are no honest metrics)."""
    groups = rows.select(F.col(group).alias("_g")).distinct().withColumn("_h", F.md5(F.col("_g").cast("string")))
    n = groups.count()
    held = groups.orderBy("_h", "_g").limit(max(1, -(-n * share // 100)) if n > 1 else 0).select("_g").withColumn("held_out", F.lit(True))
    return rows.join(held, F.col(group) == F.col("_g"), "left").drop("_g").na.fill(False, ["held_out"])


def learned_threshold(level: int, likelihood: str) -> tuple[float, float, Column]:
    """Floor, percentile and the seed threshold, an aggregate, of a learnt likelihood."""
    floor, cut = max(0.22, 0.42 - 0.02 * level), max(56.0, 76.0 - 2.0 * level)
    return floor, cut, F.greatest(F.lit(floor), F.percentile(likelihood, F.lit(cut / 100)))


def counters(candidates: DataFrame) -> DataFrame:
    """One row: candidates that are kept, and how many stand out by what."""

    def n(hit: Column) -> Column:
        return F.count(F.when(hit, 1))

    return candidates.agg(
        F.count("*").alias("kept_for_ranking"), n(F.col("penalty") >= 0.65).alias("modern_heavily_penalised"), n(F.col("similarity") >= 0.68).alias("known_like_ranked"),
        n(F.col("trained") >= 0.55).alias("trained_model_seeded"), n((F.col("annular") >= 0.62) & (F.col("circularity") >= 0.35)).alias("ring_like"), n(F.col("linear") >= 0.52).alias("line_like"),
    )


def candidate_features(candidates: DataFrame) -> DataFrame:
    """feature: a GeoJSON feature a candidate with its eighteen properties; the geometry is its box."""
    c = F.col
    x0, y0, x1, y1 = c("c0").cast("double"), c("r0").cast("double"), c("c1") + 1.0, c("r1") + 1.0
    ring = F.array(*(F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
    hundred = {"lidar_score": "lidar", "persistence_score": "persistence", "morphology_score": "morphology", "modern_penalty": "penalty", "satellite_support": "satellite", "he_similarity": "similarity"}
    shape = F.struct(*("area", "perimeter", "elongation", "circularity", "rectangularity", "convexity", "holes"))
    properties = F.struct(
        c("rank").alias("candidate_id"), c("class").alias("classification"), "score", c("area").alias("area_m2"), c("relief").alias("relief_m"), "polarity", c("scale").alias("strongest_scale_m"),
        *(F.round(100 * clip(c(v)), 6).alias(k) for k, v in hundred.items()), F.lit(0.0).alias("trained_model_score"), F.coalesce(c("label"), F.lit("")).alias("he_match_type"), F.coalesce(c("match"), F.lit("")).alias("he_match_uid"),
        "reasons", shape.alias("morphology"),
    )
    return candidates.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), properties.alias("properties"))).alias("feature"))


def run_id(taken: DataFrame, base: str) -> str:
    """base, or base with the first free suffix -01, -02 ...; taken: run_id."""
    used = {r["run_id"] for r in taken.where(F.col("run_id").startswith(base)).collect()}  # the runs of one second
    return next(x for x in (base, *(f"{base}-{i:02d}" for i in range(1, len(used) + 2))) if x not in used)


def merged_metadata(before: str, **changes) -> str:  # noqa: ANN003
    """A run's metadata (JSON) after an update: dictionaries are merged, errors appended, other values replaced."""
    out = json.loads(before)
    for key, value in changes.items():
        if isinstance(value, dict):
            out.setdefault(key, {}).update(value)
        elif isinstance(value, list):
            out.setdefault(key, []).extend(value)
        elif value is not None:
            out[key] = value
    return json.dumps(out, sort_keys=True)
