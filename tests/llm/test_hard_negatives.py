"""Hard negatives against every pair, with nulls, ties, repeated rows, odd lengths and several blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = ["id", "block", "spot", "place", "score", "chunk", "rows", "tops", "rank", "anchor", "self", "part"]


def slow(rows, every=100, k=5):
    """All result rows, sorted."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows
            if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, c) in enumerate(good):
        if i % every:
            continue
        ranked = sorted((-dot(v, w), j, d) for m, (j, w, d) in enumerate(good) if m != n)
        for p, q, _ in [r for r in ranked if r[2] == c][:k]:
            fit = [(s, j) for s, j, d in ranked if d != c and -80 * p <= -100 * s <= -100 * p][:k]
            out += [(i, q, place + 1, j, -p, -s) for place, (s, j) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **settings):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in CLASHING})
    result = hard_negatives.mined(table, F.col("id") % 100 == 0, **settings)
    return sorted(tuple(r) for r in result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def odd():
    r = random.Random(5)
    rows = [(i, [r.choice((-1.5, -0.25, 0.0, 0.5, 3.0)) for _ in range(r.choice((0, 3, 9, 16)))], r.randrange(3)) for i in range(0, 800, 4)]
    rows += rows[:40] + rows[:20]  # repeated rows, anchors too
    rows += [(100, [9.0, 1.0], 1), (100, [2.0], 2)]  # an id with several rows
    rows += [(None, [1.0], 1), (8, None, 1), (12, [1.0, None], 1), (16, [float("nan")], 0), (20, [float("inf"), 1.0], 0), (24, [1.0], None), (700, [], 0)]
    return rows


def test_odd_rows(spark, odd):
    assert found(spark, odd) == slow(odd)


def test_many_blocks_chunks_and_merges(spark, odd, monkeypatch):
    for name, value in (("BLOCK_VALUES", 64), ("CHUNK_VALUES", 160), ("CHUNKS_PER_PART", 1), ("GATHERED", 50), ("TABLED_VALUES", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert found(spark, odd) == slow(odd)


def test_ties_go_to_the_least_id(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(0, 60)] + [(100, [0.5, 0.5], 0)]
    result = found(spark, rows)
    assert result == slow(rows)
    assert [r[3] for r in result if r[:2] == (100, 0)] == [1, 3, 5, 7, 9]


def test_nothing_to_mine(spark, odd):
    assert found(spark, [(101, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []
    assert found(spark, [(100, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 0)]) == []  # a range below zero is empty
    assert hard_negatives.mined(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).count() == 0


def test_exact_for_large_numbers():
    r = np.random.default_rng(3)
    for largest, width in ((1, 8), (200, 64), (1 << 20, 16)):
        a, b = (r.integers(-largest, largest + 1, (n, width)) for n in (5, 70))
        kind = hard_negatives.number_kind(a, hard_negatives.bit_planes(b))
        assert (hard_negatives.looked_up(hard_negatives.bit_planes(b), hard_negatives.subset_sums(a.astype(kind))) == b @ a.T).all()
