"""Stored models, candidates as GeoJSON, and run ids."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import models, records


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 2, f"g{i % 5}", [float(x) for x in rng.standard_normal(3072) * 0.1 + (i % 2)]) for i in range(48)]
    return spark.createDataFrame(rows, "label int, grp string, descriptor array<double>")


@pytest.fixture(scope="module")
def fitted(examples):
    return models.fit(examples, trees=8, depth=4, leaf=1)


def test_model_round_trip_and_gate(spark, examples, fitted, tmp_path):
    model, meta = fitted
    assert meta["metrics"]["auc"] > 0.9 and meta["examples"] == {"0": 24, "1": 24}
    folder = f"file://{tmp_path}/models"
    models.save(spark, model, meta, folder, "a")
    models.save(spark, model, meta | {"feature_version": "older"}, folder, "b")
    with pytest.raises(RuntimeError, match="feature_version is older"):
        models.load(spark, folder)
    again, told = models.load(spark, folder, "a")
    assert told["name"] == "a"
    want = [r["probability"] for r in models.probability(model, examples).collect()]
    assert [r["probability"] for r in models.probability(again, examples).collect()] == want
    models.save(spark, model, {k: v for k, v in meta.items() if k != "engine_version"}, folder, "c")
    with pytest.raises(RuntimeError, match="unknown"):
        models.load(spark, folder)


def test_one_group_and_one_class(examples):
    _, meta = models.fit(examples.withColumn("grp", F.lit("x")), trees=2, depth=2, leaf=1)
    assert meta["metrics"] == {}
    with pytest.raises(ValueError, match="both"):
        models.fit(examples.where("label = 1"))


def test_raster_likelihood_covers_the_raster(spark, fitted):
    y, x = np.mgrid[:12, :12]
    cells = spark.createDataFrame([(int(a), int(b), float(np.sin(a) + b)) for a, b in zip(y.ravel(), x.ravel(), strict=True)], "r long, c long, v double")
    got = models.raster_likelihood(fitted[0], cells, 12, 4, (3, 5)).toPandas()
    assert len(got) == 144 and got["likelihood"].between(0, 1).all()


def test_candidates_as_geojson(spark):
    row = dict(rank=1, score=50.0, area=6.0, relief=0.4, polarity="positive", scale=2.5, lidar=0.5, persistence=0.25, morphology=0.7, penalty=1.2, satellite=0.0, similarity=0.9, label="Bank", match=None, reasons=["a", "b"], perimeter=10.0, elongation=1.5, circularity=0.7, rectangularity=1.0, convexity=1.0, holes=0.0, r0=2, r1=3, c0=4, c1=6)
    row["class"] = "candidate"
    df = spark.createDataFrame([row], ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string' if v is None or isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in row.items()))
    f = json.loads(records.candidate_features(df).first()["feature"])
    assert f["geometry"] == {"type": "Polygon", "coordinates": [[[4.0, 2.0], [7.0, 2.0], [7.0, 4.0], [4.0, 4.0], [4.0, 2.0]]]}
    p = f["properties"]
    assert len(p) == 18 and p["modern_penalty"] == 100.0 and p["he_match_uid"] == "" and p["reasons"] == ["a", "b"] and p["morphology"]["holes"] == 0.0


def test_runs(spark):
    taken = spark.createDataFrame([("20260101T000000Z",), ("20260101T000000Z-01",)], "run_id string")
    assert records.run_id(taken, "20260101T000000Z") == "20260101T000000Z-02" and records.run_id(taken, "20260102T000000Z") == "20260102T000000Z"
    got = json.loads(records.merged_metadata('{"status": "running", "sources": {"a": 1}}', status="done", sources={"b": 2}, errors=["x"], analysis=None))
    assert got == {"status": "done", "sources": {"a": 1, "b": 2}, "errors": ["x"]}
