"""Staged scoring: results, and how many rows the second model really saw."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from thresher.operators import staging


def counting(folder, factor):
    """A model that notes the size of every batch it is given."""

    def make():
        import os
        import uuid

        def predict(batch):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as note:
                note.write(str(len(batch)))
            return batch[:, 0].astype("float64") * factor

        return predict

    return make, 2


def seen(folder):
    return sum(int(open(os.path.join(folder, name)).read()) for name in os.listdir(folder))


@pytest.fixture
def folders(tmp_path):
    made = [str(tmp_path / n) for n in ("first", "second")]
    for folder in made:
        os.mkdir(folder)
    return made


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1000).select("id", F.array((F.col("id") / 1000).cast("float"), F.lit(0).cast("float")).alias("vector"))


def test_second_model_sees_uncertain_rows_only(spark, table, folders):
    routed = staging.score_routed(table, "vector", counting(folders[0], 1.0), counting(folders[1], 0.5), 0.3, 0.4, 0.175, digits=6)
    found = rows(routed, "id", "router", "large", "predicted", "uncertain")
    assert seen(folders[1]) == 100 and seen(folders[0]) == 1000
    assert "vector" not in routed.columns
    for i, router, large, predicted, uncertain in found:
        assert router == i / 1000
        asked = 300 <= i < 400
        assert large == (pytest.approx(i / 2000) if asked else None) and uncertain == int(asked)
        assert predicted == (1 if i >= 400 else int(i >= 350) if asked else 0)


def test_cascade_and_report(spark, table, folders):
    scored = staging.score_cascaded(table, "vector", counting(folders[0], 1.0), counting(folders[1], 1.0), 0.9, 0.95, digits=6, keep_features=True)
    found = {r["id"]: r for r in scored.collect()}
    assert seen(folders[1]) == 100 and all(len(r["vector"]) == 2 for r in found.values())
    assert sum(r["predicted"] for r in found.values()) == 50
    assert {r["ranking"] for i, r in found.items() if i < 900} == {-1.0}
    assert tuple(staging.stage_report(scored, ("gate", "verifier")).first()) == (1000, 100, 0.1)


def test_nobody_is_asked_and_empty_table(spark, table, folders):
    models = counting(folders[0], 1.0), counting(folders[1], 1.0)
    assert staging.score_staged(table, "vector", *models, lambda s: s > 2).filter("second is not null").count() == 0
    assert seen(folders[1]) == 0
    assert staging.score_routed(table.limit(0), "vector", *models, 0.1, 0.2, 0.5).count() == 0


def test_only_the_asked_part_is_scanned_for_the_second_model(spark, table, folders):
    scored = staging.score_staged(table, "vector", counting(folders[0], 1.0), counting(folders[1], 1.0), lambda s: s > 0.5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_asked") == 2
