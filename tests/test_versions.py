"""Manifests replaced under readers, histories of keys, points by delivery, records of large JSON files."""

import gzip
import json
import resource
import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F

from thresher.operators import fingerprints, metrics, points, sampling
from thresher.operators.calibration import threshold_for_recall
from thresher.operators.manifests import transform_preserving
from thresher.sources import history, json_arrays, versions
from thresher.sources.annotations import read_annotations

FIELDS = "id bigint, label string"


def numbered(spark, n, label):
    return spark.range(n).withColumn("label", F.lit(label))


# --- versions -----------------------------------------------------------------------


def test_an_open_reader_goes_on_reading(spark, tmp_path):
    root = str(tmp_path / "m")
    with pytest.raises(versions.NoVersion):
        versions.open_version(spark, root, FIELDS)
    assert versions.publish(numbered(spark, 5, "old"), root) == 1
    reader = versions.open_version(spark, root, FIELDS)
    assert versions.publish(numbered(spark, 7, "new"), root, "csv", header=True) == 2
    assert {r.label for r in reader.collect()} == {"old"} and reader.count() == 5
    newest = versions.open_version(spark, root, FIELDS, header=True)
    assert {r.label for r in newest.collect()} == {"new"} and newest.count() == 7
    assert versions.open_version(spark, root, FIELDS, number=1).count() == 5


def test_a_failed_write_is_never_seen(spark, tmp_path):
    root = str(tmp_path / "m")
    versions.publish(numbered(spark, 5, "good"), root)
    broken = numbered(spark, 100, "bad").repartition(10).withColumn("label", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="broken"):
        versions.publish(broken, root)
    assert versions.versions(spark, root) == [1]
    assert {r.label for r in versions.open_version(spark, root, FIELDS).collect()} == {"good"}
    versions.expire(spark, root)  # clears what the failed write left
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.name.startswith("data-")) == [
        next(p.read_text().split(" ")[1] for p in (tmp_path / "m" / "_commits").iterdir() if p.name.isdigit())]


def test_a_late_writer_undoes_nothing(spark, tmp_path):
    root = str(tmp_path / "m")
    versions.publish(numbered(spark, 1, "a"), root)
    versions.publish(numbered(spark, 2, "b"), root)
    with pytest.raises(ValueError, match="has come after"):
        versions.publish(numbered(spark, 3, "c"), root, expected=1)
    assert versions.versions(spark, root) == [1, 2]
    assert versions.replace(spark, root, FIELDS, lambda df: df.withColumn("label", F.lit("d"))) == 3
    assert rows(versions.open_version(spark, root, FIELDS)) == [(0, "d"), (1, "d")]


def test_writers_at_the_same_time_get_different_numbers(spark, tmp_path):
    root, got = str(tmp_path / "m"), []
    writers = [threading.Thread(target=lambda i=i: got.append(versions.publish(numbered(spark, i + 1, str(i)), root))) for i in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(got) == versions.versions(spark, root) == [1, 2, 3, 4]


# --- histories ------------------------------------------------------------------------


def test_history_tells_known_keys(spark, tmp_path):
    root = str(tmp_path / "h")
    keys = lambda low, high: spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    assert history.unseen(keys(0, 50), root, "digest").count() == 50
    history.remember(keys(0, 4000), root, "digest")
    history.remember(keys(3000, 9000), root, "digest")
    batch = keys(8900, 9100).unionByName(keys(8900, 9100)).unionByName(spark.createDataFrame([(None, -1)], "digest string, id bigint"))
    assert rows(history.unseen(batch, root, "digest"), "id") == sorted([(-1,)] + [(i,) for i in range(9000, 9100)] * 2, key=str)


def test_only_hit_buckets_are_read(spark, tmp_path):
    root = str(tmp_path / "h")
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    history.remember(keys, root, "key")
    asked = spark.createDataFrame([("k17",), ("k4711",), ("never",)], "key string").withColumn("bucket", history.bucket_of(F.col("key")))
    folders = history.read_state(spark, root)[1]["folders"]
    assert rows(history.known_keys(asked, root, folders)) == [("k17",), ("k4711",)]
    maybe = history.maybe_known(asked, root, folders)
    assert {r.key for r in maybe.collect()} >= {"k17", "k4711"}
    plan = history.known_keys(asked, root, folders)._jdf.queryExecution().executedPlan().toString()
    wanted = {r.bucket for r in maybe.collect()}
    assert len(wanted) <= 3 and "PartitionFilters: [isnotnull(folder" in plan and "In(bucket, [" in plan
    # A page holds about 3,000 keys in 32,768 bits: few unknown keys pass.
    strange = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key")).withColumn("bucket", history.bucket_of(F.col("key")))
    assert history.maybe_known(strange, root, folders).count() < 400


def test_many_deliveries_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "MOST_FOLDERS", 2)
    root = str(tmp_path / "h")
    for i in range(4):
        history.remember(spark.createDataFrame([(f"k{i}",)], "key string"), root, "key")
    assert len(history.read_state(spark, root)[1]["folders"]) <= 2
    batch = spark.createDataFrame([(f"k{i}",) for i in range(6)], "key string")
    assert rows(history.unseen(batch, root, "key")) == [("k4",), ("k5",)]


def test_an_uncommitted_delivery_does_not_count(spark, tmp_path):
    root = str(tmp_path / "h")
    one = spark.createDataFrame([("a",)], "key string")
    history.write_keys(one, root)  # a run that failed before its commit
    assert history.unseen(one, root, "key").count() == 1
    history.commit_state(spark, root, 0, {"folders": [], "totals": {}, "batches": {}})
    with pytest.raises(history.Late):
        history.commit_state(spark, root, 0, {"folders": [], "totals": {}, "batches": {}})


# --- points by delivery -----------------------------------------------------------------


def test_deliveries_add_up(spark, tmp_path):
    root = str(tmp_path / "p")
    scored = spark.range(3000).select(((F.col("id") * 7919) % 101 / 101).alias("score"), ((F.col("id") * 31) % 5 == 0).cast("int").alias("y"), "id")
    schema = "score double, p bigint, n bigint"
    for shard in range(3):
        points.add_delivery(scored.filter(F.col("id") % 3 == shard), root, f"shard/{shard}", "y", "score")
        so_far = scored.filter(F.col("id") % 3 <= shard)
        stored = points.stored_points(spark, root, schema)
        assert points.area(stored, "score").first()[0] == metrics.roc_auc(so_far, "y", "score").first()[0]
        assert tuple(points.threshold(stored, "score", 0.9).first()) == tuple(threshold_for_recall(so_far, "y", "score", 0.9).first())
        assert tuple(points.report(stored, "score", 0.5).first()) == tuple(metrics.classification(so_far, "y", "score", 0.5).first())
    points.add_delivery(scored.filter("id % 3 = 1"), root, "shard/1", "y", "score")  # comes again
    assert points.area(points.stored_points(spark, root, schema), "score").first()[0] == metrics.roc_auc(scored, "y", "score").first()[0]
    points.merge_deliveries(spark, root, schema, "score", (), str(tmp_path / "merged"))
    assert points.area(points.stored_points(spark, str(tmp_path / "merged"), schema), "score").first()[0] == metrics.roc_auc(scored, "y", "score").first()[0]


# --- fingerprints by range --------------------------------------------------------------


def test_one_changed_row_is_found_in_one_range(spark, tmp_path):
    table = spark.range(5000).withColumn("v", F.col("id") % 7)
    other = table.withColumn("v", F.when(F.col("id") == 1234, 99).otherwise(F.col("v")))
    ranges = [fingerprints.range_fingerprints(t, "id", ["id", "v"]) for t in (table, other)]
    assert tuple(fingerprints.table_of_ranges(ranges[0]).first()) == tuple(metrics.fingerprint(table, ["id", "v"]).first())
    differing = fingerprints.differing_ranges(*ranges)
    assert differing.count() == 1
    read = []
    for name, t in (("a", table), ("b", other)):
        fingerprints.write_by_range(t, str(tmp_path / name), "id")
        read.append(spark.read.schema("id bigint, v bigint, range string").parquet(str(tmp_path / name)))
    found = fingerprints.differing_rows(*read, differing, "id", ["id", "v"])
    assert rows(found) == [(1234, "changed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(range), EqualTo(range," in plan
    same = fingerprints.differing_ranges(ranges[0], ranges[0])
    assert fingerprints.differing_rows(*read, same, "id", ["id", "v"]).count() == 0


# --- one pass -----------------------------------------------------------------------------


def test_rows_are_counted_in_one_pass(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    assert transform_preserving(table, lambda d: d.withColumn("x", F.col("id") * 2)).count() == 1000
    assert len(jobs.getJobIdsForGroup(None)) - before <= 5  # the write and counts by footers
    with pytest.raises(ValueError, match="lost or added"):
        transform_preserving(table, lambda d: d.filter("id <> 3"))
    with pytest.raises(ValueError, match="lost or added"):
        transform_preserving(table, lambda d: d.union(d.limit(1)))
    assert transform_preserving(table.limit(0), lambda d: d).count() == 0


# --- balanced group split -----------------------------------------------------------------


def shares(df, label, groups):
    out = {}
    for r in df.groupBy(label, "split").count().collect():
        out[r[label], r["split"]] = r["count"]
    return out


def test_a_group_of_a_third_of_the_rows(spark):
    """The large group may fill a split beyond its share; the others make up for it, label by label."""
    rows_in = [("huge", "a")] * 2000 + [("huge", "b")] * 1000
    rows_in += [(f"g{i}", "a" if i % 3 else "b") for i in range(1400) for _ in range(5)]
    table = spark.createDataFrame(rows_in, "grp string, label string")
    split = sampling.balanced_group_split(table, "grp", "label", 5)
    assert split.count() == len(rows_in)
    assert metrics.leaks(split, "grp", "split").count() == 0
    found = shares(split, "label", "grp")
    for label in "ab":
        total = sum(n for (k, _), n in found.items() if k == label)
        for name, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
            assert abs(found[label, name] / total - share) < 0.01


def test_large_groups_equal_the_greedy_rule(spark):
    sizes = [(f"g{i}", {"a": (i * 37) % 50, "b": (i * 53) % 40 + 1, None: i % 4}) for i in range(30)]
    table = spark.createDataFrame([(g, k) for g, c in sizes for k, n in c.items() for _ in range(n)], "grp string, label string")
    found = {r.grp: r.split for r in sampling.balanced_group_split(table, "grp", "label", 3).select("grp", "split").distinct().collect()}
    total = {k: sum(c[k] for _, c in sizes) for k in ("a", "b", None)}
    share = {"train": 0.8, "val": 0.1, "test": 0.1}
    have = {s: dict.fromkeys(total, 0) for s in share}
    digest = {r.grp: r.d for r in table.select("grp", F.sha2(F.concat(F.lit("3:"), "grp"), 256).alias("d")).distinct().collect()}
    for g, c in sorted(sizes, key=lambda x: (-sum(x[1].values()), digest[x[0]], x[0])):
        cost = lambda s: sum(((have[t][k] + c[k] * (t == s) - share[t] * total[k]) / total[k]) ** 2 for t in share for k in total)
        best = min(share, key=lambda s: round(cost(s), 12))
        assert found[g] == best or cost(found[g]) == pytest.approx(cost(best), abs=1e-12)
        for k in total:
            have[found[g]][k] += c[k]


# --- large JSON files ---------------------------------------------------------------------


def walk(text, key="annotations", single="image_id", size=7):
    return list(json_arrays.records(json_arrays.Walker(text[i:i + size] for i in range(0, len(text), size)), key, single))


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_records_of_any_block_size(size):
    made = [{"image_id": f"i{n}", "paragraphs": [{"lines": [{"text": 'a"]}\\ é\n' * n, "n": -1.5e3 * n}]}]} for n in range(20)]
    for indent in (None, 2):
        whole = json.dumps({"info": {"annotations": [{"image_id": "no"}], "x": [1, 2]}, "n": 12, "annotations": made, "z": None}, indent=indent)
        assert walk(whole, size=size) == made
        assert walk(json.dumps(made[3], indent=indent), size=size) == [made[3]]
    for other in ("", "  ", "[]", "[1, 2]", "{}", '{"a": 1}', '{"annotations": []}', "3", '{"annotations": [1, "x", null]}'):
        assert walk(other, size=size) == []


def test_broken_texts_are_errors():
    for broken in ('{"annotations": [{"a": 1}', '{"annotations": [{"a": 1} {"a": 2}]}', '{"annotations" [', '{"annotations": [{"a": tru'):
        with pytest.raises(ValueError):
            walk(broken)


def test_files_equal_the_plain_scan(spark, tmp_path):
    schema = "image_id string, paragraphs array<struct<lines:array<struct<text:string,words:array<struct<text:string>>>>>>"
    made = [{"image_id": f"i{n}", "paragraphs": [{"lines": [{"text": None if n % 2 else f"t {n}", "words": [{"text": "w"}]}], "extra": n}], "other": 1} for n in range(50)]
    with gzip.open(tmp_path / "a.json.gz", "wt") as out:
        json.dump({"annotations": made[:40], "version": 1}, out, indent=1)
    for n in range(40, 50):
        (tmp_path / f"b{n}.json").write_text(json.dumps(made[n]))
    (tmp_path / "c.json").write_text('{"something": "else"}')
    (tmp_path / "d.json").write_text("")
    found = json_arrays.read_array_records(spark, str(tmp_path), "annotations", schema, single="image_id")
    assert rows(found) == rows(read_annotations(spark, str(tmp_path)))


def test_a_large_file_takes_no_memory(tmp_path):
    name = tmp_path / "large.json.gz"
    record = json.dumps({"image_id": "i", "paragraphs": [{"lines": [{"text": "word " * 200}]}]})
    with gzip.open(name, "wt", compresslevel=1) as out:
        out.write('{"annotations": [' + record)
        for _ in range(200_000):  # some 200 MB
            out.write(",\n" + record)
        out.write("]}")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    count = sum(1 for _ in json_arrays.records(json_arrays.Walker(json_arrays.blocks_of(str(name))), "annotations"))
    assert count == 200_001
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000  # KB
