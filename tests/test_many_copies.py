"""Queries over features on tables of few places: joins make rows by the places, not by the pairs of rows, and results are those of the SQL."""

import duckdb
import pytest

from terrasift.plans import feature_queries

PARTS = "SELECT id AS p_partkey, concat('part ', id % 7, repeat('x', CAST(id % 2 * 20 AS INT))) AS p_name, 'SMALL' AS p_type, CAST(id div 100 % 40 % 23 AS INT) AS p_size FROM range(0, 140000, 100)"
ORDERS = "SELECT id AS o_orderkey, id % 7 AS o_custkey FROM range(0, 120000, 40)"


def joined(df) -> int:
    """The most rows that a join of the executed plan put out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            metric = node.metrics().get("numOutputRows")
            if "Join" in name and metric.isDefined():
                most = max(most, metric.get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("crowded")
    odd = "UNION ALL SELECT * FROM VALUES (CAST(300 AS BIGINT), 'part 6', 'SMALL', 3), (CAST(NULL AS BIGINT), 'none', 'SMALL', 4), (CAST(17 AS BIGINT), NULL, 'SMALL', NULL), (CAST(28 AS BIGINT), NULL, 'SMALL', 6)"
    for name, sql in (("part", f"{PARTS} {odd}"), ("orders", ORDERS + " UNION ALL SELECT * FROM VALUES (CAST(40 AS BIGINT), CAST(3 AS BIGINT)), (CAST(7 AS BIGINT), CAST(NULL AS BIGINT))")):
        spark.sql(sql).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["nearest_named", "bbox_intersects", "point_in_forbidden_anti", "best_overlap", "validation_recall"])
def test_copies_are_met_once(spark, crowded, name):
    df = feature_queries.QUERIES[name](spark, crowded)
    assert joined(df) <= 12_000
    con = duckdb.connect()
    for v in ("part", "orders"):
        con.sql(f"CREATE VIEW {v} AS FROM '{crowded}/{v}.parquet/*.parquet'")
    want = con.sql(feature_queries.SQL[name])
    columns = want.columns
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
