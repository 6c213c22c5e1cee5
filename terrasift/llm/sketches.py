"""Operator 10 [native]: bottom-k sketches of shingle hashes.

A text's sketch is the SIZE smallest distinct hashes of its five-word shingles (words in lower case), ascending. From
sketches alone: resemblance (the share of the union's SIZE smallest hashes that both have), containment and the number
of distinct shingles. The sketch of a union is the SIZE smallest of the parts' hashes, so sketches merge exactly.

Only DataFrame functions are used. A text of fewer than five words is one shingle of all its words; a text without
words has an empty sketch.

Defined results: null text is the empty text; two empty sketches resemble fully, an empty and another not at all; rows
without doc_id come last, by text; rows that repeat doc_id and text are one document in that order, and each gets the
same results; the last document's next is the first, a lone document's is itself; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HEAVY_KEYS, HEAVY_ROWS, WORD, ranked, read

SIZE, SHINGLE = 128, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, size: int = SIZE, shingle: int = SHINGLE) -> Column:
    """array<long>: the smallest distinct shingle hashes, ascending."""

    def of_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(shingle))))
        few = F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(w)))
        return F.when(F.size(w) < shingle, few).otherwise(F.slice(F.array_distinct(F.sort_array(grams)), 1, size))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)), of_words)


def union(a: Column, b: Column, size: int = SIZE) -> Column:
    return F.slice(F.array_distinct(F.sort_array(F.concat(a, b))), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of shared shingles among all of both; exact if neither sketch is full."""
    shared = let(union(a, b, size), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared.cast("double"))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact if the sketch isn't full."""
    part = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / part)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    r, na, nb = resemblance(a, b, size), distinct_shingles(a, size), distinct_shingles(b, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def merge(parts: DataFrame, keys: list[str], col: str, size: int = SIZE) -> DataFrame:
    """The sketches of the unions of parts, by keys; the smallest hashes are chosen before the shuffle already."""
    hashes = parts.select(*keys, F.explode(col).alias("_x")).distinct()
    least = hashes.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_x"))).where(F.col("_r") <= size)
    found = least.groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias(col))
    return parts.select(*keys).distinct().join(found, keys, "left").withColumn(col, F.coalesce(col, F.array().cast("array<long>")))


def as_text(a: Column) -> Column:
    """A sketch as a string: its hashes, base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text and the next document's first quarter as long as text's last, and the next document's sketch.

    Texts are shuffled once, by document; what a document needs of the next one comes to it in a second, smaller shuffle.
    The rows of a document that is repeated more than max(HEAVY_ROWS, rows / HEAVY_KEYS) times (rows without an id and
    with an empty text, say) are dealt by salts, and what they need is sent to each salt.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").isNull().alias("_z"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("text"))
    key = ["_z", "_d", "_h"]
    thin = keyed.select(*key, F.floor(F.char_length("text") / 4).cast("int").alias("_q")).groupBy(*key).agg(F.max("_q").alias("_q"), F.count("*").alias("_n"))
    order = ranked(spark, thin, [F.col(c) for c in key], "_rank", "order")
    n, total = order.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    least = max(HEAVY_ROWS, total // HEAVY_KEYS)
    salts = F.ceil(F.col("_n") / least)
    # More than total / HEAVY_KEYS rows each, so there are fewer than HEAVY_KEYS of them. A salt's share is some `least`
    # rows, so none of a heavy key's salts stays without rows (a chance of exp(-least)).
    heavy = F.broadcast(order.where(F.col("_n") > least).select(*key, salts.alias("_m")))
    salted = keyed.withColumn("_i", F.monotonically_increasing_id()).join(heavy, key, "left")
    salted = salted.select(*key, F.when(F.col("_m").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_i"), F.col("_m"))).cast("long").alias("_s"), "text")
    after = order.select(*(F.col(c).alias(f"_o{c}") for c in key), F.when(F.col("_n") > least, salts).otherwise(F.lit(1)).alias("_m"), F.col("_q"), ((F.col("_rank") + 1) % max(1, n)).alias("_next"))
    # Salt 0, but not as a literal: its filter would be pushed below one of the two uses of the texts' shuffle, which then wouldn't be shared.
    pairs = order.select(*key, F.pmod(F.col("_rank"), F.lit(1)).cast("long").alias("_s"), "_rank").join(after.hint("shuffle_hash"), F.col("_rank") == F.col("_next")).drop("_rank", "_next")
    split = [*key, "_s"]
    # The first row of a key. (A filter on row_number would be turned into a limit below the shuffle, which then couldn't be shared with the last join.)
    one = salted.withColumn("_r", F.lag(F.lit(1)).over(W.partitionBy(*split).orderBy(F.lit(0)))).where("_r IS NULL").drop("_r")
    sent = one.join(pairs.hint("merge"), split).select(*(F.col(f"_o{c}").alias(c) for c in key), F.col("_m"), F.expr("substring(text, 1, _q)").alias("_head"), sketch(F.col("text")).alias("next_sketch"))
    sent = sent.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).drop("_m")
    rows = salted.join(sent.hint("merge"), split)
    return rows.select(F.when(~F.col("_z"), F.col("_d")).alias("doc_id"), "text", "_head", "next_sketch")


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(spark, read(spark, sf_dir, "documents"))
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.col("_head"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), sketch(F.col("text")).alias("_a"), sketch(edited).alias("_b"), "next_sketch")
    a, b, c = F.col("_a"), F.col("_b"), F.col("next_sketch")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"), resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"))
