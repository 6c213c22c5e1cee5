"""The catalogue on Parquet: upserts, insert-ignore, look-ups, groups and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the row that comes first in the order."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table after the batch: new keys are inserted, known ones take the batch's columns; `order` ranks a key's rows inside the batch."""
    new = keep_one(batch, keys, order)
    return new.unionByName(table.join(new.select(*keys), keys, "left_anti"))


def insert_ignore(table: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table after the batch: of each new key the first row, known keys unchanged."""
    fresh = batch.join(table.select(*keys).distinct(), keys, "left_anti")
    return table.unionByName(keep_one(fresh, keys, order))


def look_up(rows: DataFrame, features: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows with the smallest value of the feature of the same key; null without one."""
    return rows.join(features.groupBy(key).agg(F.min(value).alias(out)), key, "left")


def grouped(rows: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """Per key: the count, and each column's distinct values, sorted and joined."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(c) for c in sets))
