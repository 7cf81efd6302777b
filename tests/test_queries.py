"""Every registered query against its SQL twin, and its plan against the scale rules."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import compare
from thresher.plans.catalogue import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    return compare.database(FOLDER)


# Plans that would emit all pairs, or call Python row by row.
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    query = QUERIES[name]
    result = query.run(spark, FOLDER)
    if query.sql is None:
        assert result.count() > 0
    else:
        assert compare.same(result, database.sql(query.sql)) is None
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in BANNED if node in plan]


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.count() > 0
    assert "selection" in result.columns


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_survey_is_covered():
    ids = {i.strip() for q in QUERIES.values() for i in q.survey.split(",")}
    wanted = {f"A{i}" for i in range(1, 12)} | {f"B{i}" for i in range(1, 29)} | {f"C{i}" for i in range(1, 11)}
    wanted |= {f"D{i}" for i in range(1, 24)} | {f"E{i}" for i in range(1, 12)} | {f"G{i}" for i in range(1, 13)}
    wanted |= {f"H{i}" for i in range(1, 6)} | {f"J{i}" for i in range(1, 5)} | {f"K{i}" for i in range(1, 12)} | {"K1b"}
    wanted |= {f"S{i}" for i in range(1, 5)}
    assert wanted <= ids


def test_pair_plan_beyond_five_digits(spark, tmp_path):
    rows = spark.range(100_300).selectExpr(
        "id AS doc_id", "concat('t', id) AS text", "element_at(array('en', 'fr', 'de', 'es'), cast(id % 4 + 1 AS int)) AS lang",
        "'web' AS source", "length(text) AS n_chars").withColumn("n_chars", F.col("n_chars").cast("long"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    query = QUERIES["pair_plan"]
    assert compare.same(query.run(spark, str(tmp_path)), connection.sql(query.sql)) is None
