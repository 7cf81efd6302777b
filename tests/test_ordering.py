"""The building blocks against brute force, on tied, skewed, empty and null inputs."""

import random
from hashlib import sha256

import pytest
from conftest import rows
from pyspark.sql import functions as F

from thresher.operators import ordering as O


def skewed(n=3000, seed=1):
    """A third of all rows share one key and one score."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        out.append((i, key, 0.5 if i % 3 == 0 else rng.randrange(200) / 200))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(skewed(), "id bigint, key string, score double").cache()


def expected_top(data, k, keys=True):
    groups = {}
    for i, key, score in data:
        groups.setdefault(key if keys else None, []).append((-score, i))
    return sorted(i for g in groups.values() for _, i in sorted(g)[:k])


@pytest.mark.parametrize("k", [1, 2, 7, 40, 5000])
@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("heap", [1000, 0])
def test_top_per_group(table, k, keys, heap, monkeypatch):
    monkeypatch.setattr(O, "HEAP_LIMIT", heap)
    found = O.top_per_group(table, k, ["-score", "id"], keys)
    assert sorted(r.id for r in found.collect()) == expected_top(skewed(), k, bool(keys))


def test_top_per_group_beyond_the_merge_limit(table, monkeypatch):
    monkeypatch.setattr(O, "MERGE_LIMIT", 10)
    found = O.top_per_group(table, 300, ["-score", "id"], ["key"])
    assert sorted(r.id for r in found.collect()) == expected_top(skewed(), 300)


def test_top_of_nothing(table):
    assert O.top_per_group(table, 0, ["id"]).count() == 0
    assert O.top_per_group(table.filter("id < 0"), 3, ["id"], ["key"]).count() == 0


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_rank_rows(table, keys):
    found = {r.id: r.rank for r in O.rank_rows(table, ["score", "-id"], keys).collect()}
    groups = {}
    for i, key, score in skewed():
        groups.setdefault(key if keys else None, []).append((score, -i))
    for members in groups.values():
        for place, (_, negative) in enumerate(sorted(members), start=1):
            assert found[-negative] == place


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums(table, descending):
    points = O.score_points(table, "score", {"_n": F.count(F.lit(1))}, ["key"], descending).collect()
    data = skewed()
    for p in points[:60]:
        same = [s for _, k, s in data if k == p.key]
        before = [s for s in same if (s >= p.score if descending else s <= p.score)]
        assert (p._n_upto, p._n_total) == (len(before), len(same))


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0), ("a", None)], "key string, score double")
    points = O.score_points(df, "score", {"_n": F.count(F.lit(1))}, ["key"])
    assert rows(points, "key", "score", "_n_upto", "_n_total") == [("a", 1.0, 1, 1), (None, 1.0, 1, 2), (None, 2.0, 2, 2)]


def digest_order(ids, seed):
    return sorted(ids, key=lambda i: (sha256(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("m", [0, 1, 10, 2999, 3000, 9000])
@pytest.mark.parametrize("limit", [100_000, 5])
def test_take_by_hash(table, m, limit, monkeypatch):
    monkeypatch.setattr(O, "MERGE_LIMIT", limit)
    found = sorted(r.id for r in O.take_by_hash(table, m, "id", 9).collect())
    assert found == sorted(digest_order(range(3000), 9)[:m])


@pytest.mark.parametrize("limit", [1000, 2])
def test_take_share_of_each_key(table, limit, monkeypatch):
    monkeypatch.setattr(O, "HOT_SHARE", limit)
    found = O.take_by_hash(table, lambda n: F.greatest(F.lit(1), F.bround(n * 0.5, 0)), "id", 9, ["key"])
    assert found.columns == table.columns
    groups = {}
    for i, key, _ in skewed():
        groups.setdefault(key, []).append(i)
    wanted = [i for ids in groups.values() for i in digest_order(ids, 9)[:max(1, round(len(ids) * 0.5))]]
    assert sorted(r.id for r in found.collect()) == sorted(wanted)


def test_dense_index(table):
    found = [r.id for r in O.dense_index(table.select("id"), "id", 4).orderBy("index").collect()]
    assert found == digest_order(range(3000), 4)


@pytest.mark.parametrize("share", [1000, 2])
def test_attach_to_hot_keys(spark, table, share, monkeypatch):
    monkeypatch.setattr(O, "HOT_SHARE", share)
    groups = table.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("last"))
    found = O.attach(table, groups, "key", "size", ["last"])
    last = {}
    for i, key, _ in skewed():
        last[key] = i
    assert found.count() == 3000
    assert all(r["last"] == last[r.key] for r in found.collect())


def test_attach_reference_keeps_unmatched_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, key string")
    reference = spark.createDataFrame([("a", 10)], "name string, value int")
    assert rows(O.attach_reference(df, reference, "key", ["value"], "name"), "id", "value") == [(1, 10), (2, None), (3, None)]


def quantile(values, p):
    values = sorted(values)
    spot = (len(values) - 1) * p
    low, high = values[int(spot)], values[min(int(spot) + 1, len(values) - 1)]
    return low + (high - low) * (spot - int(spot))


def test_quantile_rows(table):
    probabilities = [0, 0.05, 0.5, 0.9, 0.99, 1]
    points = O.score_points(table, "score", {"_n": F.count(F.lit(1))}, ["key"])
    data = skewed()
    for r in O.quantile_rows(points, "score", probabilities, ["key"]).collect():
        assert r.quantile == pytest.approx(quantile([s for _, k, s in data if k == r.key], r.probability), abs=1e-12)


def test_guard_fails_only_when_violated(spark, table):
    zero, one = (spark.createDataFrame([(n,)], "n int") for n in (0, 1))
    assert O.guard(table, zero, "no").count() == 3000
    for use in (lambda t: t.collect(), lambda t: t.count(), lambda t: t.select("score").collect()):
        with pytest.raises(Exception, match="broken"):
            use(O.guard(table, one, "broken"))
