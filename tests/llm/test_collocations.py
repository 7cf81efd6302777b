"""Collocations against counting every phrase of every text."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from thresher.llm import collocations

SCHEMA = "doc_id long, text string, lang string"
CLASHING = ["n", "phrase", "chunk", "tail", "block", "part", "a", "l", "r", "score", "rank", "size", "words", "cut"]


def slow(rows, least, first, longest=3):
    """{lang: [(rank, phrase, a, l, r, n, score)]}"""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = {}
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = collections.Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    held[p[i:i + size]] = max(held[p[i:i + size]], a)
        rows = []
        for p, a in candidates.items():
            if not held[p] or 100 * held[p] < 50 * a:
                score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out[lang] = [(i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return {lang: rows for lang, rows in out.items() if rows}


def found(spark, rows, **settings):
    table = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)], SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in CLASHING})
    out = collections.defaultdict(list)
    for r in collocations.collocations(table, **settings).collect():
        out[r["lang"]].append((r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
    return {lang: sorted(rows) for lang, rows in out.items()}


@pytest.fixture(scope="module")
def odd():
    r = random.Random(2)
    words = ["a", "B", "é", "É", "ß", "c\x00d", "x y", "z. ", ",", "\n", "\t", "\x1c", "　", "ſ", "e\r\nf", "long" * 50, "…"]
    rows = [(" ".join(r.choices(words, k=r.choice((1, 2, 3, 40, 400)))), r.choice(("en", "de", None, "", "und"))) for _ in range(60)]
    passage = " ".join(f"w{i % 37} v{i}" for i in range(200))
    rows += [(None, "en"), ("", "en"), (" ,. ", "xx"), ("one", "yy"), ("stop " * 5_000, "en"), (passage, "fr")]
    rows += [(f"{i} begins here {passage} and ends", "fr") for i in range(12)] + rows[:10]
    return rows


def test_odd_texts(spark, odd):
    assert found(spark, odd) == slow(odd, 10, 2_000)


def test_other_limits(spark, odd):
    assert found(spark, odd, least=3, first=7) == slow(odd, 3, 7)
    assert found(spark, odd, least=300, first=50) == slow(odd, 300, 50)
    assert found(spark, odd, least=4, first=40, longest=5) == slow(odd, 4, 40, 5)


def test_many_parts(spark, odd, monkeypatch):
    monkeypatch.setattr(collocations, "PART_PHRASES", 2_000)
    assert found(spark, odd) == slow(odd, 10, 2_000)


def test_whole_dictionary_in_small_blocks(spark, odd, monkeypatch):
    """Blocks cut inside one task: the sums must not depend on where."""
    one = collocations.frequencies(spark.createDataFrame(odd, "text string, lang string"))[0]
    whole = sorted(map(tuple, one.select("lang", "phrase", "size", "n").collect()))
    counted = collections.Counter()
    for lang, rows in slow(odd, 10, 10 ** 9).items():
        for _, p, a, *_ in rows:
            counted[lang, p] = a
    have = {(lang, p): n for lang, p, _, n in whole}
    assert all(have[k] == n for k, n in counted.items())


def test_shared_passages_become_shared_chunks(spark, odd):
    table = spark.createDataFrame(odd, "text string, lang string").filter("lang = 'fr'")
    parse = collocations.parsed(table, "text", "lang", 2)
    total, distinct = parse.count(), parse.distinct().count()
    assert distinct < total / 3


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0
