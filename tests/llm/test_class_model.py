"""The class model's scores against plain loops over all tokens, given the classes it has learnt."""

import collections
import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from thresher.llm import class_model, links  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())


def learnt_classes(blocks, model, back, buckets):
    slots, classes, known = model
    kinds, held = {}, {r["block"]: r["back"] for r in class_model.with_back(blocks, back).select("block", "back").collect()}
    for r in blocks.collect():
        words = np.array(r["words"], np.int64)
        for w, k, c in zip(words.tolist(), *(x.tolist() for x in class_model.kinds_and_counts(words, held[r["block"]], slots, classes, known, buckets))):
            kinds[w] = k, c
    return kinds


def test_scores_equal_plain_loops(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in class_model.scores(docs).collect()}
    blocks = links.pinned(class_model.blocks_of(docs))
    model, back, buckets, bigrams, *_ = class_model.modelled(blocks)
    kinds = learnt_classes(blocks, model, back, buckets)
    key = lambda w: int(class_model.word_hashes([w]).view(np.int64)[0])
    lines = {i: [(w, *kinds[key(w)]) for w in brute.words(t)] for i, t in documents}
    count, steps, sizes, tokens = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for i, line in lines.items():
        if class_model.held_out(i):
            continue
        for w, k, _ in line:
            count[w] += 1
            tokens[k] += 1
        tokens[0] += 1
        turn = [0, *[k for _, k, _ in line], 0]
        steps.update(zip(turn, turn[1:]))
    for line in lines.values():  # the counts that came back are those of the training texts
        assert all(c == count[w] for w, _, c in line)
    for w in count:
        sizes[kinds[key(w)][0]] += 1
    sizes[0] += 1
    assert all(bigrams[a, b] == steps[a, b] for a in range(class_model.CLASSES) for b in range(class_model.CLASSES))
    whole = sum(steps.values())
    into, out = collections.Counter(), collections.Counter()
    for (a, b), n in steps.items():
        out[a] += n
        into[b] += n
    smooth = class_model.ALPHA * class_model.CLASSES

    def moved(a, b):
        share = (into[b] + class_model.ALPHA) / (whole + smooth)
        return (steps[a, b] + smooth * share) / (out[a] + smooth)

    texts = sum(not class_model.held_out(i) for i in lines)
    for i, line in lines.items():
        score, before = 0.0, 0
        for k, n in [*[(k, count[w]) for w, k, _ in line], (0, texts)]:
            emitted = (n + class_model.DELTA) / (tokens[k] + class_model.DELTA * (sizes[k] + 1))
            score += math.log10(moved(before, k)) + math.log10(emitted)
            before = k
        assert found[i].score == pytest.approx(score, rel=1e-9)
        assert found[i].n_tokens == len(line) + 1 and found[i].n_known == sum(count[w] > 0 for w, _, _ in line) + (texts > 0)


def test_a_table_is_walked_once_for_many_blocks(monkeypatch):
    """Not once for each block, of which there are as many as the input is long."""
    rng, walks, bincount = np.random.default_rng(5), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda cells, *rest: walks.append(len(cells)) or bincount(cells, *rest))
    monkeypatch.setattr(class_model, "HELD_CODES", 1_000)
    parts = [(rng.integers(0, 500, n), rng.integers(1, 9, n).astype("<u4")) for n in [0, 30, 70] * 40]
    wanted = collections.Counter()
    for cells, counts in parts:
        for cell, n in zip(cells.tolist(), counts.tolist()):
            wanted[cell] += n
    found = class_model.added_up(parts, 500)
    assert found.tolist() == [wanted[i] for i in range(500)]
    assert len(walks) <= 5 and sum(walks) == 4_000


def test_blocks_stay_where_they_are(spark, documents):
    """Only what buckets send back is shuffled for the joins."""
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    blocks = class_model.laid_out(class_model.blocks_of(docs))
    assert sorted(x for r in blocks.collect() for x in r["doc_ids"]) == [i for i, _ in documents]
    back = spark.createDataFrame([(r["block"], 0, b"", b"") for r in blocks.collect()], "block long, bucket int, kinds binary, counts binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = class_model.with_back(blocks, back)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
