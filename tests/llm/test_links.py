"""Links between sets: hot keys in blocks, counted occurrences, small sets."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from thresher.llm import links, overlap_join  # noqa: E402


@pytest.mark.parametrize("rows_of_block", [7, 50, 4096])
def test_one_hot_key_in_blocks(spark, monkeypatch, rows_of_block):
    """All sets stand under one key, most of them unlike; every link is found."""
    monkeypatch.setattr(links, "BLOCK_ROWS", rows_of_block)
    r, sets = random.Random(3), {}
    for i in range(200):
        base = r.sample(range(10_000), r.randint(20, 60))
        sets[i] = frozenset(base)
    for i in range(0, 60, 3):  # copies with an element more or less, far apart in number
        sets[200 + i] = sets[i] | {20_000 + i} if i % 2 else frozenset(sorted(sets[i])[1:])
    hashes = {i: np.sort(np.array([hash((x, 7)) & ((1 << 63) - 1) for x in s], np.uint64)) for i, s in sets.items()}
    placed = spark.createDataFrame([(1, len(sets), len(s), i, i, bytearray(links.sketch(hashes[i], 256))) for i, s in sets.items()],
                                   "key long, rows long, size long, item long, component long, sketch binary")
    found = {tuple(sorted(x)) for x in links.apart(placed, 80, links.once).collect()}
    wanted = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert wanted and wanted <= found
    assert len(found) < 400  # sketches rule out nearly all others


def test_occurrences_are_counted(spark):
    rows = [(k, 2, 40, i, i, bytearray(32)) for k in range(3) for i in (1, 2)] + [(9, 2, 40, i, i, bytearray(32)) for i in (1, 3)]
    placed = spark.createDataFrame(rows, "key long, rows long, size long, item long, component long, sketch binary")
    pairs = lambda n: {tuple(sorted(x)) for x in links.apart(placed, 80, lambda sizes: np.full(len(sizes), n)).collect()}
    assert pairs(1) == {(1, 2), (1, 3)} and pairs(2) == pairs(3) == {(1, 2)} and pairs(4) == set()


def test_sets_of_any_size(spark):
    """Sets of one to a hundred n-grams, near the threshold on both sides, and their copies."""
    r, rows = random.Random(12), []
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 33, 60, 100):
        words = [f"w{size}x{k}" for k in range(size + 3)]
        for change in range(7):
            other = list(words)
            for k in r.sample(range(len(words)), min(change, len(words)) // 2):
                other[k] = f"c{size}x{change}x{k}"
            rows.append((len(rows), " ".join(other + [f"e{size}x{change}"] * (change % 2))))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[::9])]
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in overlap_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.overlap_components(rows)
