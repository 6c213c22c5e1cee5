"""What the operators of this subpackage share: words, scratch tables, ranks and joins that stand hot keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ship import ship

#: A word: a run of anything but ASCII white space. The same pattern in Java and in Python.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: ASCII lower case only, so that Java and Python agree on every text.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)

#: Keys with more rows than max(HEAVY_ROWS, rows / HEAVY_KEYS) are heavy; hence HEAVY_KEYS bounds their number.
HEAVY_ROWS, HEAVY_KEYS = 1000, 10_000


def ascii_lower(text: str) -> str:
    """A-Z in lower case and nothing else (lower() of bytes knows ASCII only; translate() takes twenty times as long)."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def lower_column(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD_RE.findall(text) if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that go to Python at a time: texts can be long, and a worker holds several copies of a batch.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session's Python functions, and puts this package on the executors."""
    ship(spark)
    if not _held:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """So many rows go to Python at a time in what is run inside; the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    _held.append(rows)
    try:
        yield
    finally:
        _held.pop()
        spark.conf.set(key, before)


_held: list[int] = []


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that no DataFrame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives a Python worker's free memory back; workers live on between tasks, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """mapInPandas in small batches, with this package on the executors."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInPandas(task, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session, which has one machine, may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terrasift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_scratch: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/terrasift/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _scratch.discard(path)


def table(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage and outlives any executor."""
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_scratch):
        try:
            if spark is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is the cluster's scratch space
            return


def ranked(spark: SparkSession, df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """df with dense ranks from 0 in the given order, made without a task that sees all rows.

    A range sort numbers the rows inside each partition; the partitions' sizes (as many as there are shuffle
    partitions, not as many as rows) give each partition's first rank.
    """
    sorted_ = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    stored = table(spark, sorted_, name)
    part = F.shiftright(F.col("_m"), 33)
    sizes = sorted((r["p"], r["n"]) for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((int(p), at))
        at += n
    first = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_p long, _first long"))
    return stored.join(first, part == F.col("_p")).withColumn(rank, F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_first")


def attach(rows: DataFrame, facts: DataFrame, key: str, n_rows: int, count: str, spread: Column) -> DataFrame:
    """rows left-joined with facts (one row a key; `count` says how many rows have the key), whatever the keys' sizes.

    Heavy keys, at most HEAVY_KEYS by their definition, are broadcast; the others meet in a shuffle, to which the heavy
    keys' rows go under keys of their own (`spread`), so no task gets more rows of one key than the definition allows.
    """
    least = max(HEAVY_ROWS, n_rows // HEAVY_KEYS)
    names = [c for c in facts.columns if c != key]
    heavy = F.broadcast(facts.where(F.col(count) > least).select(F.col(key).alias("_hk"), F.struct(*names).alias("_hf")))
    light = facts.where(F.col(count) <= least).select(F.struct(F.lit(0).alias("s"), F.col(key).cast("string").alias("k")).alias("_lk"), F.struct(*names).alias("_lf"))
    own = F.struct(F.lit(0).alias("s"), F.col(key).cast("string").alias("k"))
    away = F.struct(F.lit(1).alias("s"), F.concat(F.lit("#"), spread.cast("string")).alias("k"))
    met = rows.join(heavy, F.col(key) == F.col("_hk"), "left").withColumn("_own", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), away).otherwise(own))
    met = met.join(light, F.col("_own") == F.col("_lk"), "left")
    return met.select(*rows.columns, *(F.coalesce(F.col(f"_hf.{c}"), F.col(f"_lf.{c}")).alias(c) for c in names))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
