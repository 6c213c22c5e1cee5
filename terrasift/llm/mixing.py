"""Operator 1: mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1 (piecewise linear). Its integral is the source's weight; the
weights share the total demand, capped per source (water filling). A source's documents, in a hashed order, form its
token stream; the cumulative demand of the source, target * W(t) / W(1), is inverted at the middle of each document's
span, which gives the time at which training meets the document. Documents range-sorted by that time are the mix.

Defined results: null text has size 0; a document without words is never in the mix; a null source is a source like any
other, last in the order of sources; rows that repeat are rows of their own; an empty table gives an empty result; only
the columns named are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, ranked, read, table

Schedule = tuple[tuple[float, float], ...]
#: (time, weight) knots; the integrals are 3, 1 and 2.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (0.5, 2.5), (1.0, 1.0)))
#: Up to so many sources go to all executors (about 100 bytes each); more meet the documents in a salted shuffle.
BROADCAST_SOURCES, SALTS = 100_000, 64


def integral(s: Schedule) -> float:
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(s, s[1:], strict=False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _inverse(share: Column, s: Schedule) -> Column:
    """The time at which the schedule's integral has reached `share` (0..1) of its whole."""
    whole, done, out = integral(s), 0.0, F.lit(s[-1][0])
    pieces = []
    for (t0, a), (t1, b) in zip(s, s[1:], strict=False):
        area = (t1 - t0) * (a + b) / 2
        y = F.greatest(share * whole - done, F.lit(0.0)) / (t1 - t0)
        root = a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * y))
        x = F.when(root > 0, 2 * y / root).otherwise(0.0)
        done += area
        pieces.append((done / whole, t0 + F.least(x, F.lit(1.0)) * (t1 - t0)))
    for upto, t in reversed(pieces):
        out = F.when(share <= upto, t).otherwise(out)
    return out


def targets(spark: SparkSession, sources: DataFrame, schedules: tuple[Schedule, ...], share: float, cap: float) -> tuple[DataFrame, int]:
    """(source, source_size, n) -> with rank, class and target, and the number of sources.

    A target is min(cap * size, level * weight); the level rises as capped sources hand on their excess. A round is one
    aggregate over the table of sources; only sums come to the driver.
    """
    known = ranked(spark, sources, [F.col("source").asc_nulls_last()], "rank", "sources")
    weight = F.element_at(F.array(*(F.lit(integral(s)) for s in schedules)), (F.col("rank") % len(schedules) + 1).cast("int"))
    known = known.withColumn("class", (F.col("rank") % len(schedules)).cast("int")).withColumn("weight", weight)
    most = F.col("source_size") * cap
    first = known.agg(F.count("*").alias("k"), F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total = share * (first["s"] or 0)
    level, capped = total / first["w"] if first["w"] else 0.0, -1
    while True:
        full = F.col("weight") * level >= most
        x = known.agg(F.sum(full.cast("int")).alias("n"), F.sum(F.when(full, most)).alias("at_cap"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not x["w"] or x["n"] == capped:
            break
        level, capped = (total - (x["at_cap"] or 0.0)) / x["w"], x["n"]
    return known.withColumn("target", F.least(most.cast("double"), F.col("weight") * level)), first["k"]


@dataclass(frozen=True)
class Mix:
    """rows: one row a document of the input; see mix()."""

    rows: DataFrame
    columns: tuple[str, ...]

    def epochs(self) -> DataFrame:
        """The mix itself: a row for each time a document is taken, range-sorted by its position in training."""
        each = self.rows.select("*", F.posexplode("positions").alias("epoch", "position"))
        return each.drop("positions").repartitionByRange(F.col("position"), F.col("_h")).sortWithinPartitions("position", "_h").drop("_h")


def mix(spark: SparkSession, docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), *, schedules: tuple[Schedule, ...] = SCHEDULES, share: float = 1.5, cap: float = 2.0, seed: int = 42) -> Mix:
    """Sizes, targets, words taken and positions of all documents (doc_id, text, source); `carry` names columns to keep.

    Per source the whole epochs that fit its target are taken, then documents in hashed order while they fit what is
    left, then the one other document that brings the sum nearest to the target. No document is taken more than
    ceil(cap) times.
    """
    own = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_h")]
    light = set(carry) <= {"doc_id", "source"}  # then texts are read once; else once more, for the columns to carry
    sized = table(spark, docs.select(*(carry if light else ()), *own), "sizes")
    known, k = targets(spark, sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("n")), schedules, share, cap)
    known = table(spark, known, "targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("int")
    known = known.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    facts = known.select(F.col("source").alias("_ks"), F.col("rank").alias("_rank"), "class", "source_size", "n", "target", "whole", "rest")

    def streamed(rows: DataFrame) -> DataFrame:
        """Each document's first word's place in its source's stream, `_at`: hashed buckets of about sqrt(n) documents, sums of buckets, then sums inside."""
        if k <= BROADCAST_SOURCES:
            rows = rows.join(F.broadcast(facts), F.col("_source").eqNullSafe(F.col("_ks")))
        else:
            salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("_s", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int")).join(salted, F.col("_source").eqNullSafe(F.col("_ks")) & (F.col("_s") == F.col("_salt"))).drop("_s", "_salt")
        # Texts without words take no place in a stream, so those of equal hash may lie in any bucket.
        spread = F.when(F.col("_size") > 0, F.col("_h")).otherwise(F.monotonically_increasing_id())
        return rows.drop("_ks", "_source").withColumn("_bucket", F.pmod(spread, F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")))

    thin = streamed(sized.select("_id", "_source", "_size", "_h"))
    before = thin.groupBy("_rank", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = table(spark, before.select("_rank", "_bucket", (F.sum("_sum").over(W.partitionBy("_rank").orderBy("_bucket")) - F.col("_sum")).alias("_before")), "buckets")
    inside = W.partitionBy("_rank", "_bucket").orderBy("_h", "_id").rowsBetween(W.unboundedPreceding, W.currentRow)

    def placed(rows: DataFrame) -> DataFrame:
        run = rows.join(before.hint("merge"), ["_rank", "_bucket"])
        return run.withColumn("_at", F.col("_before") + F.sum("_size").over(inside) - F.col("_size"))

    stored = table(spark, placed(thin).select("_rank", "_size", "_at", "rest", "_id"), "streams")
    end = F.col("_at") + F.col("_size")
    fits = stored.groupBy(F.col("_rank").alias("_fr")).agg(F.coalesce(F.max(F.when(end <= F.col("rest"), end)), F.lit(0)).alias("_fit"))
    fits = table(spark, fits, "fits")
    few = F.broadcast if k <= BROADCAST_SOURCES else (lambda d: d)
    left = F.col("rest") - F.col("_fit")
    other = stored.join(few(fits), F.col("_rank") == F.col("_fr")).where((end > F.col("rest")) & (F.abs(left - F.col("_size")) < left))
    other = other.groupBy(F.col("_rank").alias("_or")).agg(F.min(F.struct(F.abs(left - F.col("_size")).alias("d"), F.col("_at").alias("at"), F.col("_size").alias("size"))).alias("_o"))
    last = fits.join(other, F.col("_fr") == F.col("_or"), "left").select("_fr", "_fit", F.col("_o.at").alias("_oat"), F.coalesce(F.col("_o.size"), F.lit(0)).alias("_osize"))
    last = table(spark, last, "last")

    rows = placed(streamed(sized if light else docs.select(*carry, *own))).join(few(last), F.col("_rank") == F.col("_fr"))
    chosen = F.coalesce(F.col("_at") == F.col("_oat"), F.lit(False)) & (F.col("_size") > 0)
    fit = (end <= F.col("rest")) & (F.col("_size") > 0)
    times = F.when(F.col("_size") > 0, F.col("whole") + (fit | chosen).cast("int")).otherwise(0)
    all_taken = F.col("whole") * F.col("source_size") + F.col("_fit") + F.col("_osize")

    def place(epoch: Column) -> Column:
        tail = F.when(chosen & (epoch == F.col("whole")), F.col("_fit")).otherwise(F.col("_at"))
        middle = epoch * F.col("source_size") + tail + F.col("_size") / 2
        part = F.least(F.lit(1.0), middle / F.greatest(all_taken, F.lit(1)))
        out = _inverse(part, schedules[-1])
        for c in range(len(schedules) - 1):
            out = F.when(F.col("class") == c, _inverse(part, schedules[c])).otherwise(out)
        return out

    most = int(-(-cap // 1))
    positions = F.array_compact(F.array(*(F.when(times > e, place(F.lit(e))) for e in range(most))))
    out = rows.select(*carry, F.col("_size").alias("size"), "source_size", "target", (times * F.col("_size")).cast("long").alias("taken"), positions.alias("positions"), "_h")
    return Mix(out, carry)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in the order in which training first meets them; those not taken follow in hashed order."""
    rows = mix(spark, read(spark, sf_dir, "documents").select("doc_id", "text", "source")).rows
    first = F.get(F.col("positions"), 0)
    key = F.coalesce(first, 1 + F.pmod(F.col("_h"), F.lit(1 << 30)) / float(1 << 30))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), F.get(F.col("positions"), 1).alias("second_position"), key.alias("_key"))
    return rows.orderBy("_key", "doc_id").drop("_key")
