"""Sources, coordinates and the streaming merge."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from terrasift.functions import crs
from terrasift.sources import features as src
from terrasift.streaming.ingest import latest, merge_stream


def test_british_grid_of_a_known_place(spark):
    e, n = crs.british_grid(F.lit(-0.2405), F.lit(50.8657))
    x = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert x["e"] == pytest.approx(523915.55, abs=10) and x["n"] == pytest.approx(108829.39, abs=10)


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": "x", "n": 3}}, {"type": "Feature", "geometry": None, "properties": {}}]}))
    rows = src.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert len(rows) == 1 and rows[0]["geom_type"] == "Point" and rows[0]["props"]["n"] == "3" and json.loads(rows[0]["coordinates"]) == [1, 2]


def test_checksums(spark, tmp_path):
    (tmp_path / "hello.txt").write_bytes(b"hello")
    x = src.checksums(spark, str(tmp_path), "*.txt").first()
    assert x["size"] == 5 and x["sha256"].startswith("2cf24dba") and x["sha256"].endswith("9824")


def test_stream_merges_into_the_catalogue(spark, tmp_path):
    schema = "k long, name string, seq long"
    for i, rows in enumerate(([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 5), (3, "e", 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = merge_stream(spark, arrivals, str(tmp_path / "out"), ["k"], "seq")
        q.awaitTermination()
        assert q.exception() is None, i
    got = {r["k"]: r["name"] for r in latest(spark, str(tmp_path / "out"), q).collect()}
    assert got == {1: "b", 2: "d", 3: "e"}


def test_cache_scan_judges_each_page(spark, tmp_path):
    from terrasift.plans import source_queries

    rows = [(i, f"http://a/{i % 3}", None if i % 11 == 1 else f"page {i}") for i in range(60)] + [(7, None, "x"), (8, None, None), (21, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [r["key"] for r in source_queries.cache_scan(spark, str(tmp_path)).collect()]
    want = duckdb.sql(f"WITH pages AS (FROM '{tmp_path}/pages.parquet/*.parquet') " + source_queries.SQL["cache_scan"]).fetchall()
    assert sorted(str(k) for k in got) == sorted(str(k) for (k,) in want)
