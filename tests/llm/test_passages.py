"""Shared passages: whole spans against comparing all texts, and how much of planted passages goes."""

import random
from pathlib import Path

import numpy as np
import pytest

from thresher import session
from thresher.llm import overlap_join, passages

SCHEMA = "doc_id long, text string"


def some_words(r, n):
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n)]


def planted(length, changes, seed, pairs=60):
    """Pairs of texts that share a passage with some words changed; (rows, {doc_id: (first, words)})."""
    r, rows, where = random.Random(seed), [], {}
    for i in range(pairs):
        passage = some_words(r, length)
        other = list(passage)
        for k in range(changes):
            other[(k + 1) * length // (changes + 1)] = "changed" + str(r.random())
        for doc_id, inner in ((2 * i, passage), (2 * i + 1, other)):
            before = some_words(r, r.randint(20, 90))
            rows.append((doc_id, " ".join(before + inner + some_words(r, r.randint(20, 90)))))
            where[doc_id] = len(before), length
    return rows, where


@pytest.mark.parametrize("length,changes", [(51, 0), (60, 0), (60, 1), (100, 1), (100, 2)])
def test_planted_passages_go(spark, length, changes):
    rows, where = planted(length, changes, seed=length + changes)
    gone = {}
    for r in passages.shared_passages(spark.createDataFrame(rows, SCHEMA)).filter("removed").collect():
        assert r.doc_id % 2 == 1 and r.first_doc_id == r.doc_id - 1
        gone.setdefault(r.doc_id, set()).update(range(r.first, r.first + r.words))
    shares, beyond = [], 0
    for doc_id, (first, words) in where.items():
        if doc_id % 2:
            inside = set(range(first, first + words))
            shares.append(len(gone.get(doc_id, set()) & inside) / words)
            beyond += len(gone.get(doc_id, set()) - inside)
    assert np.mean(shares) >= 0.9
    assert sum(s == 0 for s in shares) <= 0.02 * len(shares)
    assert beyond <= 0.01 * length * len(shares)  # next to nothing of what is not shared


def test_passage_in_many_texts(spark):
    """A passage that very many texts share goes from all but the first."""
    r = random.Random(4)
    passage = some_words(r, 70)
    rows = [(i, " ".join(some_words(r, 30) + passage + some_words(r, 30))) for i in range(10, 210)]
    gone, firsts = {}, {}
    for x in passages.shared_passages(spark.createDataFrame(rows, SCHEMA)).filter("removed").collect():
        gone[x.doc_id] = gone.get(x.doc_id, 0) + x.words
        firsts[x.doc_id] = min(x.first_doc_id, firsts.get(x.doc_id, x.first_doc_id))
    assert 10 not in gone and len(gone) == 199 and min(gone.values()) >= 66
    assert set(firsts.values()) == {10}


def brute_spans(rows, seeds_of):
    """The spans of each text that are alike with an earlier text, by growing from every place in common."""
    split = {i: [w.lower() for w in t.split()] for i, t in rows}
    out = {}
    for i, a in split.items():
        for j, b in split.items():
            if j < i:
                places = {}
                for k in range(len(b) - 4):
                    places.setdefault(tuple(b[k:k + 5]), k)
                for k in range(len(a) - 4):
                    at = places.get(tuple(a[k:k + 5]))
                    if at is not None:
                        out.setdefault(i, set()).update(range(k, k + 5))
    return out


def test_exact_repeats_equal_brute_force(spark):
    """Where nothing is changed, what goes is what stands word for word in an earlier text, if 15 words or more of it hang together."""
    rows, where = planted(80, 0, seed=9, pairs=25)
    shared = brute_spans(rows, None)
    gone = {}
    for r in passages.shared_passages(spark.createDataFrame(rows, SCHEMA)).filter("removed").collect():
        gone.setdefault(r.doc_id, set()).update(range(r.first, r.first + r.words))
    assert gone == {i: s for i, s in shared.items()}


def test_short_repeats_stay(spark):
    r = random.Random(6)
    line = some_words(r, 12)
    rows = [(i, " ".join(some_words(r, 40) + line + some_words(r, 40))) for i in range(30)]
    assert passages.shared_passages(spark.createDataFrame(rows, SCHEMA)).filter("removed").count() == 0


def test_growing():
    a = np.arange(100, dtype=np.uint32)
    b = a.copy()
    b[60] = 1000
    assert passages.extension(a, b) == 100
    b[58:64] = np.arange(2000, 2006)
    assert passages.extension(a, b) == 100  # 36 words behind a gap of six
    b[80:] = np.arange(3000, 3020)
    assert passages.extension(a, b) == 58  # 16 words do not pay for a gap of six
    assert passages.extension(a[:0], b) == 0
    assert passages.grown(a, a, [(40, 5, 40, 5)], 80) == [(0, 100)]
    other = np.concatenate([np.arange(5000, 5030, dtype=np.uint32), a[20:60], np.arange(6000, 6030, dtype=np.uint32)])
    assert passages.grown(a, other, [(30, 4, 40, 4), (50, 3, 60, 3)], 80) == [(20, 40)]


def test_paragraphs_of_many_texts_are_those_of_each():
    rng = random.Random(8)
    texts = [None, "", " ", "a", "a b", "a " * 40, "k l m n o", None, *(" ".join(rng.choices("abcdefgh", k=rng.randint(0, 70))) for _ in range(300)), ""]
    whole = passages.Paragraphs(texts)
    for i, text in enumerate(texts):
        own, at = passages.Paragraphs([text]), np.flatnonzero(whole.texts == i)
        assert [whole.firsts[at].tolist(), whole.words[at].tolist(), whole.items[at].tolist(), whole.blocks[at].tolist()] == [
            own.firsts.tolist(), own.words.tolist(), own.items.tolist(), list(range(len(own)))]
        assert whole.sets(at) == own.sets(np.arange(len(own))) and [8 * n for n in whole.sizes[at]] == [len(x) for x in whole.sets(at)]
        assert sum(own.words) == len((text or "").split())


def test_superseded_tables_go(spark):
    """What a stage wrote on the way does not lie beside the next stage's tables."""
    folder = Path(session.shared_folder(spark)) / spark.sparkContext.applicationId
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 20) * 100 + k}" for k in range(80))) for i in range(60)], "doc_id long, text string")
    before = set(folder.glob("pinned-*"))
    left = passages.deduplicated(docs)
    assert len(set(folder.glob("pinned-*")) - before) == 1
    assert left.count() == 20
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # texts are cut once
    before = set(folder.glob("pinned-*"))
    kept = overlap_join.first_documents(docs)
    assert len(set(folder.glob("pinned-*")) - before) <= 3
    assert kept.count() == 20
