"""Features that arrive over time, merged into the catalogue: an upsert for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import upsert


def merge_stream(spark: SparkSession, arrivals: DataFrame, folder: str, keys: list[str], order: str) -> StreamingQuery:
    """Starts the merge of a stream into a Parquet catalogue in `folder`.

    Each batch writes a new version (version=N, N the batch) from the one before, so a batch that is repeated after a
    failure writes the same version again and readers never see half of one.
    """

    def merge(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        if n:
            before = spark.read.schema(batch.schema).parquet(f"{folder}/version={n - 1}")
            out = upsert(before, batch, keys, [F.col(order).desc()])
        else:
            out = upsert(batch.limit(0), batch, keys, [F.col(order).desc()])
        out.write.mode("overwrite").parquet(f"{folder}/version={n}")
        batch.unpersist()

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, query: StreamingQuery) -> DataFrame:
    """The catalogue after the batches that a finished query ran."""
    return spark.read.parquet(f"{folder}/version={query.lastProgress['batchId']}")
