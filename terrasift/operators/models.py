"""The life of a stored model: fit on examples, saved with a sidecar and a pointer, loaded through a version gate, applied to a raster."""

from __future__ import annotations

import json
from functools import reduce

import pyspark
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import durable
from . import learning, records, terrain

#: Version of the descriptor that models are fitted to; a model of another one is refused.
FEATURES = "patch-1"


def fit(examples: DataFrame, trees: int = 160, depth: int = 14, leaf: int = 8, seed: int = 42) -> tuple[PipelineModel, dict]:
    """A model of examples (descriptor, label 0/1, grp), and its metadata with metrics on the groups held out (none for a single group)."""
    rows = examples.withColumn("_v", array_to_vector("descriptor"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        raise ValueError("training needs both archaeology and background")
    split = durable(records.holdout_groups(rows, "grp"))
    known = split.where(~F.col("held_out"))
    weight = F.when(F.col("label") == 1, n[0] / n[1]).otherwise(1.0)
    forest = RandomForestClassifier(featuresCol="_v", labelCol="label", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)
    model = Pipeline(stages=[forest]).fit(known.withColumn("_w", weight))
    meta = {"engine_version": pyspark.__version__, "feature_version": FEATURES, "examples": {str(k): v for k, v in n.items()}, "metrics": {}}
    held = split.where("held_out")
    if not held.isEmpty():
        scored = probability(model, held.drop("_v")).select("label", F.col("probability").alias("score"))
        meta["metrics"] = learning.binary_metrics(scored, "label", "score").first().asDict() | {"auc": learning.roc_auc(scored, "label", "score").first()["auc"]}
    return model, meta


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows (descriptor) with probability."""
    out = model.transform(rows.withColumn("_v", array_to_vector("descriptor")).withColumn("_w", F.lit(1.0)))
    return out.withColumn("_p", vector_to_array("probability")[1]).drop("_v", "_w", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", "probability")


def save(spark: SparkSession, model: PipelineModel, meta: dict, folder: str, name: str) -> None:
    """folder/name/model, its sidecar beside it, and the pointer folder/current, written last: a reader sees a whole model or the one before."""
    model.write().overwrite().save(f"{folder}/{name}/model")
    for path, text in ((f"{folder}/{name}/meta", json.dumps(meta | {"name": name}, sort_keys=True)), (f"{folder}/current", name)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, folder: str, name: str | None = None) -> tuple[PipelineModel, dict]:
    """The named model, or the one that the pointer names. A model of another engine or descriptor version is refused."""
    name = name or spark.read.text(f"{folder}/current").first()["value"]
    meta = json.loads(spark.read.text(f"{folder}/{name}/meta").first()["value"])
    for key, here in (("engine_version", pyspark.__version__), ("feature_version", FEATURES)):
        if meta.get(key) != here:
            raise RuntimeError(f"the model's {key} is {meta.get(key) or 'unknown'}, this engine's is {here}: train it anew")
    return PipelineModel.load(f"{folder}/{name}/model"), meta


def raster_likelihood(model: PipelineModel, cells: DataFrame, side: int, step: int, halves: tuple[int, ...]) -> DataFrame:
    """r, c, likelihood of a square raster: patches of each half width around the cells of a stride grid are scored, the highest of the
    scales counts, and the grid is stretched bilinearly. A patch is a group's work; the raster is never in one place."""
    centres = terrain.stride(cells, step).select((F.col("r") * side + F.col("c")).alias("id"), "r", "c")
    found = [probability(model, learning.patch_descriptors(cells, centres, h)).select("id", "probability") for h in halves]
    best = durable(reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("probability").alias("v")))
    coarse = best.select((F.floor(F.col("id") / side) / step).cast("long").alias("r"), (F.col("id") % side / step).cast("long").alias("c"), "v")
    return terrain.zoom(coarse, step, side).withColumnRenamed("v", "likelihood")
