"""Incremental ingest over several shards and runs."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from thresher.sources.history import read_state
from thresher.streaming.ingest import (
    QuotasShort, batches_done, rows_of_state, run_to_table, stream_dedup, stream_ingest, stream_quota_sink, stream_split,
)

SCHEMA = "episode string, digest string, at int"


def shard(spark, path, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_dedup_remembers_earlier_runs(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for data in ([("e1", "a", 1), ("e1", "b", 2)], [("e2", "b", 3), ("e2", "c", 4)], [("e3", "a", 5)]):
        shard(spark, source, data)
        run_to_table(stream_dedup(stream_ingest(spark, source, SCHEMA), "digest"), out, progress)
    found = spark.read.parquet(out)
    assert rows(found, "digest") == [("a",), ("b",), ("c",)]
    assert rows(found, "at") == [(1,), (2,), (4,)]


def test_split_matches_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    shard(spark, source, [(f"e{i}", str(i), i) for i in range(100)])
    run_to_table(stream_split(stream_ingest(spark, source, SCHEMA), "episode"), out, progress)
    batch = stream_split(spark.read.parquet(source), "episode")
    assert rows(spark.read.parquet(out)) == rows(batch)


def test_quotas_hold_over_batches_and_replays(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for start in (0, 100, 200):
        shard(spark, source, [("e", str(i % 150), i) for i in range(start, start + 100)])
    targets = {"train": 120, "val": 5, "test": 5}
    stream = stream_split(stream_ingest(spark, source, SCHEMA, max_files=1), "episode")
    stream_quota_sink(stream, targets, out, progress, "digest", "at")
    found = batches_done(spark, out)
    only = found.select("split").distinct().first()[0]
    assert found.count() == targets[only] == found.select("digest").distinct().count()
    # A batch that is run again replaces what it wrote before.
    stream_quota_sink(stream, targets, out, str(tmp_path / "fresh"), "digest", "at")
    assert batches_done(spark, out).groupBy("digest").count().filter(F.col("count") > 1).count() == 0
    assert batches_done(spark, out).count() == targets[only]


def test_quota_batches_do_not_read_earlier_rows(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for start in range(0, 400, 100):
        shard(spark, source, [(f"e{i % 9}", str(i % 350), i) for i in range(start, start + 100)])
    stream = lambda: stream_split(stream_ingest(spark, source, SCHEMA, max_files=1), "episode")
    stream_quota_sink(stream(), {"train": 1000, "val": 1000, "test": 1000}, out, progress, "digest", "at")
    assert batches_done(spark, out).select("digest").distinct().count() == batches_done(spark, out).count() == 350
    assert sum(read_state(spark, out)[1]["totals"].values()) == 350
    # A write that failed before its commit leaves rows that do not count, and is written again.
    number = read_state(spark, out)[0]
    spark.createDataFrame([("e", "ghost", 1, "train")], SCHEMA + ", split string").write.parquet(rows_of_state(out, number + 1))
    assert batches_done(spark, out).count() == 350
    shard(spark, source, [("e1", "new", 1000), ("e1", "7", 1001)])
    stream_quota_sink(stream(), {"train": 1000, "val": 1000, "test": 1000}, out, progress, "digest", "at")
    assert batches_done(spark, out).count() == 351 and batches_done(spark, out).filter("digest = 'ghost'").count() == 0


def test_short_targets_are_reported(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    shard(spark, source, [("e1", "a", 1)])
    with pytest.raises(QuotasShort):
        stream_quota_sink(stream_split(stream_ingest(spark, source, SCHEMA), "episode"), {"train": 5}, out, progress, "digest", "at", on_short="error")
