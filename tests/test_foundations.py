"""Inputs and plans that the small tables lack: heavy scores, hot groups, odd keys, leaks, line breaks."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from thresher.functions import labels as L
from thresher.functions.hashing import seeded
from thresher.operators import calibration as K, lineage as G, metrics as D, ordering as O, sampling as P
from thresher.sources.manifests import read_manifest, write_manifest
from thresher.streaming.ingest import QuotasShort, batches_done, stream_ingest, stream_quota_sink, stream_split


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_heavy_score_does_not_swallow_the_ranges(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 100 != 0, 0.0).otherwise(F.col("id") / 200_000).alias("score"))
    points = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    cuts = O.cut_values(points, "score", 8)
    sizes = [r["count"] for r in O.bucketed(points, "score", cuts).groupBy("_range").count().collect()]
    assert len(sizes) >= 7 and max(sizes) <= 2 * points.count() / 8
    got = O.score_points(df, "score", {"_n": F.count(F.lit(1))})
    assert got.filter("_n_upto = _n_total").count() == 1 and got.count() == points.count()


def test_points_are_made_in_one_scan(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).cast("double").alias("score")).write.parquet(str(tmp_path / "t"))
    text = plan(O.score_points(spark.read.parquet(str(tmp_path / "t")), "score", {"_n": F.count(F.lit(1))}))
    assert str(tmp_path / "t") not in text  # what follows reads the written points


def test_a_task_sends_few_rows_of_a_hot_group(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("g"), F.col("id"), F.hash("id").alias("score"))
    top = O.top_per_group(df, 50, ["-score", "id"], ["g"])
    assert "spark_partition_id" in plan(top).lower() and re.search(r"WindowGroupLimit.*Partial", plan(top))
    part = df.withColumn("_salt", F.spark_partition_id() % 4)
    assert part.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("_salt").alias("n")).filter("n > 1").count() == 0
    wanted = sorted(df.collect(), key=lambda r: (-r.score, r.id))[:50]
    assert sorted(r.id for r in top.collect()) == sorted(r.id for r in wanted)


def test_large_k_is_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(O, "MERGE_LIMIT", 100)
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    assert O.top_per_group(df, 60, ["-id"], ["g"]).count() == 180


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_odd_keys_meet_whatever_the_size(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        df = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, None), (4, float("nan")), (5, float("nan")), (6, 1.0)], "id int, k double")
        sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        assert rows(O.join_small(df, sizes, ["k"], "n"), "id", "first") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_leaks_are_an_error_after_forcing(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "test")], "g string, split string")
    assert P.assert_no_leaks(df, "g").count() == 3
    with pytest.raises(Exception, match="more than one split"):
        P.assert_no_leaks(df.union(spark.createDataFrame([("b", "train")], df.schema)), "g").select("split").count()


def test_unreachable_targets_are_errors(spark):
    grid = spark.createDataFrame([(0.1, 0.9, 0.5, 0.1, 0.2, 0.5)], "low double, high double, recall double, fpr double, route_rate double, precision double")
    assert K.accuracy_first(grid, 0.5).count() == 1
    with pytest.raises(Exception, match="no route"):
        K.accuracy_first(grid, 0.9).count()
    scored = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 0, 0.3), ("b", 1, 0.2)], "k string, y int, s double")
    assert K.threshold_from_curve(scored, "y", "s", (0.5, 1.0), ["k"], required=True).count() == 4
    with pytest.raises(Exception, match="unreachable"):
        K.threshold_from_curve(scored, "y", "s", (0.5, 1.5), ["k"], required=True).count()


def test_fingerprint_does_not_collide_across_columns(spark):
    mark = lambda *row: D.fingerprint(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first().fingerprint
    assert len({mark("a|=b", "c"), mark("a", "b|=c"), mark(None, "-"), mark("-", None), mark("", "x"), mark("x", "")}) == 6


def test_csv_keeps_values(spark, tmp_path):
    fields = ("name", "note")
    df = spark.createDataFrame([("  pad  ", "two\nlines"), ('quo"te', "a,b"), ("tab\t", None)], "name string, note string")
    write_manifest(df, str(tmp_path / "m"), fields)
    back = read_manifest(spark, str(tmp_path / "m"), fields, multi_line=True)
    assert rows(back) == rows(df)


def test_null_parts_keep_their_place(spark):
    df = spark.createDataFrame([("s", "o", None, "3")], "a string, b string, c string, d string")
    assert df.select(L.lineage_key("a", "b", "c", "d")).first()[0] == "s:o::3"
    assert df.select(seeded(1, "c", "d")).first()[0] == "1::3"


def test_taxonomy_strips_all_white_space(spark):
    df = spark.createDataFrame([("\t memo\n",), ("memo",)], "x string")
    assert len({r[0] for r in df.select(L.taxonomy("x")).collect()}) == 1


def test_maps_of_null_keys_and_their_bound(spark, monkeypatch):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "b"), ("a", None)], "x string, y string")
    assert D.counts_map(df, ["x", "y"]).first().counts == {"a/b": 1, "a/null": 2, "null/a": 1}
    monkeypatch.setattr(D, "MAP_ENTRIES", 2)
    with pytest.raises(Exception, match="too many keys"):
        D.counts_map(df, ["x", "y"]).collect()


def test_fixes_take_reviews_first(spark):
    manifest = spark.createDataFrame([("a", "s", "invoice"), ("b", "s", " Memo"), ("c", "s", "invoice "), ("d", "t", "memo"), ("e", "s", None)],
                                     "filepath string, source string, predicted_class string")
    reviewed = spark.createDataFrame([("a", "form"), ("d", "form")], "filepath string, label string")
    assert [r[0] for r in rows(G.derive_fixes(manifest, reviewed, "s", "invoice"))] == ["a", "b", "e"]


def test_full_quotas_leave_shards_for_later(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "episode string, digest string, at int"
    for start in (0, 10, 20, 30):
        spark.createDataFrame([("e", str(i), i) for i in range(start, start + 10)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: stream_split(stream_ingest(spark, source, schema, max_files=1), "episode")
    split = stream_split(spark.createDataFrame([("e",)], "episode string"), "episode").first().split
    stream_quota_sink(stream(), {split: 10}, out, progress, "digest", "at")
    first = {r.digest for r in batches_done(spark, out).collect()}
    stream_quota_sink(stream(), {split: 25}, out, progress, "digest", "at", on_short="error")
    after = {r.digest for r in batches_done(spark, out).collect()}
    assert len(first) == 10 and first < after and len(after) == 25
    with pytest.raises(QuotasShort):
        stream_quota_sink(stream(), {split: 100}, out, progress, "digest", "at", on_short="error")


def test_release_drops_only_what_the_session_wrote(spark, tmp_path):
    from pathlib import Path

    from thresher.session import pinned, release, shared_folder

    other = Path(shared_folder(spark)) / "other"
    other.mkdir(exist_ok=True)
    assert pinned(spark.range(3)).count() == 3
    release(spark)
    assert other.exists() and not (Path(shared_folder(spark)) / spark.sparkContext.applicationId).exists()
    assert pinned(spark.range(3)).count() == 3
