"""Feature sources and sinks: GeoJSON, paged services, verified caches, checksums and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FEATURE = "struct<type string, geometry struct<type string, coordinates string>, properties map<string, string>>"
#: Object types whose own name says little, and the parts of an address by how well they name a place.
WEAK = ("pub", "bar", "restaurant", "cafe", "fast_food", "shop", "supermarket", "building", "road", "parking", "fuel", "bus_stop", "toilets")
ADDRESS = ("historic", "natural", "archaeological_site", "peak", "hill", "mountain", "park", "attraction", "island", "archipelago", "locality", "hamlet", "village", "town", "city", "amenity")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections -> a row a feature: geom_type, coordinates (JSON), props; features without geometry are dropped."""
    docs = spark.read.text(path, wholetext=True)
    rows = docs.select(F.explode(F.from_json("value", f"struct<features array<{FEATURE}>>").getField("features")).alias("f"))
    return rows.where("f.geometry IS NOT NULL").select(F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("props"))


def to_geojson(rows: DataFrame, geom_type: str, coordinates: Column, *props: str) -> DataFrame:
    """A line of GeoJSON a row."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geom_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties"))).alias("value"))


def write_geojson(rows: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON, one file a partition."""
    rows.write.text(path)


def scanned_pages(pages: DataFrame, size: int, most: int) -> DataFrame:
    """Pages (layer, page, n, more) that a paged scan reads: up to the first that is empty, or short without `more` to come."""
    last = (F.col("n") == 0) | ((F.col("n") < size) & ~F.col("more"))
    before = F.coalesce(F.max(last.cast("int")).over(W.partitionBy("layer").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("_stopped", before).where((F.col("_stopped") == 0) & (F.col("page") < most)).drop("_stopped")


def resolve_layers(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """wanted (layer, old_id) and listed (id, name) -> layer, id: by normalised name, else by the id of old."""
    from ..operators.vector import normalise

    names = listed.select(normalise(F.col("name")).alias("_n"), F.col("id").alias("_by_name")).groupBy("_n").agg(F.min("_by_name").alias("_by_name"))
    ids = listed.select(F.col("id").alias("_by_id")).distinct()
    out = wanted.withColumn("_n", normalise(F.col("layer"))).join(names, "_n", "left").join(ids, F.col("old_id") == F.col("_by_id"), "left")
    return out.select("layer", F.coalesce("_by_name", "_by_id").alias("id"))


def cache_key(url: Column, params: Column) -> Column:
    return F.sha2(F.concat_ws("\n", url, params), 256)


def to_fetch(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests (key, ...) without a sound entry of their key in the cache (key, content, sha256, size): digests and sizes are checked each time."""
    sound = cache.where((F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size")))
    return requests.join(sound.select(key), key, "left_anti")


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size and sha256 of a folder's files, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def best_name(kind: Column, names: Column, address: Column, display: Column) -> Column:
    """A place's name: its own unless its kind is weak, then the best part of its address, its own, the whole line."""

    def some(x: Column) -> Column:
        return F.when(F.trim(x) != "", F.trim(x))

    own = F.coalesce(some(names["name:en"]), some(names["name"]))
    strong = F.when(~F.lower(F.coalesce(kind, F.lit(""))).isin(*WEAK), own)
    return F.coalesce(strong, *(some(address[k]) for k in ADDRESS), own, some(display))


def urls(props: Column) -> Column:
    """Distinct http(s) addresses among the properties that hold links, in order of key."""
    keyed = F.filter(F.array_sort(F.map_entries(props)), lambda e: F.lower(e["key"]).startswith("he_url") | F.lower(e["key"]).startswith("her_link"))
    parts = F.flatten(F.transform(keyed, lambda e: F.split(e["value"], r"[\s;]+")))
    return F.array_distinct(F.filter(parts, lambda u: u.startswith("http://") | u.startswith("https://")))


def svg_path(xs: Column, ys: Column) -> Column:
    """'M x y L x y ... Z' of a ring."""
    return F.concat(F.lit("M "), F.array_join(F.zip_with(xs, ys, lambda x, y: F.format_string("%.2f %.2f", x, y)), " L "), F.lit(" Z"))


def circle(x: Column, y: Column, radius: Column, edges: int = 128) -> Column:
    """The closed ring of a circle: array of (x, y)."""
    step = 2 * 3.141592653589793 / edges
    return F.transform(F.sequence(F.lit(0), F.lit(edges)), lambda i: F.struct((x + radius * F.cos(i * step)).alias("x"), (y - radius * F.sin(i * step)).alias("y")))


def way_kind(points: Column, building: Column) -> Column:
    """polygon, line or null for a way: only a building, whose ring is closed first, is a polygon; a closed hedge stays a line."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    corners = F.size(points) + (first != last).cast("int")
    return F.when(F.size(points) < 2, None).when(building & (corners >= 4), "polygon").otherwise("line")
