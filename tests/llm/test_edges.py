"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from thresher.llm import chat, class_model, contamination, host_rules, overlap_join, packing, passages, records, style_tree, toxicity  # noqa: E402
from thresher.llm.texts import arrow, batch  # noqa: E402
from thresher.session import pinned  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "host", "item", "key", "size", "block", "of", "component", "found", "hits", "windows", "class", "ws", "spots", "bits", "held", "kept", "first"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"term{i} of{i % 7}" for i in range(30_000))
    plain = " ".join(f"word{i}" for i in range(120))
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "de", None, 4), (4, long, "en", "a", len(long)), (5, plain, "fr", "b", len(plain)),
            (5, plain, "fr", "b", len(plain)), (6, plain.upper(), "fr", None, 1), (7, "one", "en", "b", 3), (8, "a b\nc d e\n", "es", "c", 10),
            (None, plain + " and more", "en", "c", None), (9, "\x00 \U0001f600 ​ ß", "en", "c", 6), (10, "stop stop " * 60, "en", "c", 600)]
    table = spark.createDataFrame(rows, SCHEMA)
    return table.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def items(spark, odd):
    plain = " ".join(f"word{i}" for i in range(20, 60))
    rows = [(1, plain), (1, plain), (2, None), (3, ""), (4, "one"), (5, "never seen in any text at all")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})


def texts(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


def test_records(odd, none):
    rows = records.read_records(records.write_records(odd)).orderBy("start").collect()
    wanted = sorted(texts(odd), key=lambda r: (r[0] is not None, r[0]))
    assert [r.doc_id for r in rows] == [i for i, _ in wanted]
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(i), brute.crc(i)) for i in brute.token_ids([t for _, t in wanted]))
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    assert records.read_records(records.write_records(none)).count() == 0


def test_class_model(odd, none):
    rows = class_model.scores(odd).collect()
    assert len(rows) == odd.count() and all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert sorted(r.n_tokens for r in rows) == sorted(len(brute.words(t)) + 1 for _, t in texts(odd))
    assert class_model.scores(none).count() == 0
    lone = class_model.scores(odd.filter("doc_id is null")).first()
    assert lone.held_out and lone.train_tokens == 0 and lone.n_known == 0


def test_passages(odd, none):
    spans = passages.shared_passages(odd).collect()
    assert {(r.doc_id, r.removed) for r in spans} == {(5, False), (6, True)}
    left = passages.deduplicated(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1  # nothing is left of 6
    assert passages.shared_passages(none).count() == 0 and passages.deduplicated(none).count() == 0


def test_host_rules(odd, none):
    rows = {(r.doc_id, r.n_words): r for r in host_rules.judged(odd).collect()}
    assert rows[1, 0].base_failed and rows[2, 0].n_symbols == 0 and rows[3, 0].word_chars == 0
    assert rows[5, 120].kept and rows[6, 120].kept and rows[None, 122].kept
    assert rows[8, 5].n_dup_lines == 0 and rows[10, 120].n_repeat_words == 120 and not rows[10, 120].kept
    assert rows[4, 60000].n_repeat_words == 0
    kept = host_rules.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert host_rules.judged(none).count() == 0


def test_a_failing_host_goes_and_a_small_one_stays(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "short" if i % 10 else good, "xx", "junk", 1) for i in range(300)]
    rows += [(1000 + i, good if i % 10 else "short", "xx", f"h{i % 6}", 1) for i in range(300)] + [(2000, "short", "xx", "tiny", 1), (2001, good, "xx", "tiny", 1)]
    kept = {r.doc_id for r in host_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect() if r.kept}
    assert kept == {r[0] for r in rows if r[1] == good and r[3] != "junk"}


def test_kept_documents_write_no_text(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{w:x}" for w in rng.integers(1 << 62, size=80 if i % 3 else 20)) for i in range(300)]
    docs = spark.createDataFrame([(i, text, "xx", f"h{i % 4}", 1) for i, text in enumerate(texts)], SCHEMA)
    written = []
    monkeypatch.setattr(host_rules, "pinned", lambda df: written.append(pinned(df)) or written[-1])
    kept = host_rules.kept_documents(docs)
    assert sum(os.path.getsize(f.removeprefix("file:")) for t in written for f in t.inputFiles()) < 20_000 < sum(map(len, texts))
    assert {r.doc_id: r.text for r in kept.collect()} == {i: text for i, text in enumerate(texts) if i % 3}
    # Text is taken apart by steps of the plan, not by a filter that would do so for every word.
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not any("split(" in line for line in plan.splitlines() if "Filter " in line)


def test_contamination(spark, odd, none):
    wanted = items(spark, odd)
    found = sorted((r.doc_id or 0, r.item_id, r.found, r["size"]) for r in contamination.contained(odd, wanted).collect())
    assert found == sorted([(d, 1, 36, 36) for d in (0, 5, 5, 6) for _ in range(2)] + [(7, 4, 1, 1)])
    clean = contamination.clean_documents(odd, wanted)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 5
    assert contamination.contained(none, wanted).count() == 0
    assert contamination.contained(odd, wanted.limit(0)).count() == 0 and contamination.clean_documents(odd, wanted.limit(0)).count() == odd.count()


def test_short_items_in_long_documents(spark):
    """Items of one to four shingles are found as surely as longer ones."""
    random = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{k}" for k in random.integers(0, 10_000, n))
    items = [(f"i{k}", text(5 + k % 4)) for k in range(600)]
    docs = [(k, f"{text(40)} {item} {text(40)}") for k, (_, item) in enumerate(items)]
    found = contamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, item_id) for k, (item_id, _) in enumerate(items)}


def test_overlap_join(odd, none):
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in overlap_join.near_duplicates(odd).collect())
    assert rows == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 59997, 4), (5, 117, 5), (5, 117, 5), (6, 117, 5), (7, 1, 7), (8, 2, 8), (0, 119, 5),
                           (9, 1, 9), (10, 1, 10)])
    kept = overlap_join.first_documents(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert overlap_join.near_duplicates(none).count() == 0 and overlap_join.first_documents(none).count() == 0


def test_chats(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "hi"), (1, 1, "user", "hi"), (None, 1, "assistant", "x"), (2, 1, "assistant", "y" * 50_000), (2, 1, "assistant", "y" * 50_000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(given)).collect()}
    assert found[1].n_turns == 3 and found[1].loss_chars == 0 and found[2].loss_chars == 100_000 and found[None].loss_chars == 1
    assert chat.read_back(chat.format_chats(given.limit(0))).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.example/x", None), (2, None, ""), (3, "not a url", "<p>text &amp; <b>bo</b>ld<br>next"), (4, "http://a.example", "plain < text & 1 > 0"),
            (4, "http://a.example", "plain < text & 1 > 0"), (5, "http://b.example", "<article><p>in " + "long " * 50_000 + "</p></article><p>out</p>"),
            (6, "http://b.example", "<div><ul><li><a href=x>menu item</a></li></ul><p>body</p></div><!-- open"), (7, "x", "<script>never closed"),
            (8, "http://b.example", "<article><form>f</form><aside>a</aside><p>kept <i>it</i></p></article>"), (9, "http://b.example", "</p></div>&lt;p&gt; &copy;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "removed": F.lit("y")})
    found = sorted((r.page_id, r.text, r.n_chars) for r in style_tree.extracted(pages).collect())
    texts = {i: t for i, t, n in found}
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    assert (texts[1], texts[2], texts[3], texts[4], texts[6], texts[7], texts[8], texts[9]) == (
        "", "", "text & bold next", "plain < text & 1 > 0", "body", "", "kept it", "<p> ©")
    assert texts[5] == ("in " + "long " * 50_000).strip()
    assert style_tree.extracted(pages.limit(0)).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    wanted = []
    for (doc_id, _), ids in zip(texts(odd), brute.token_ids([t for _, t in texts(odd)])):  # repeated rows and rows without an id too
        first = (len(ids) - 1) % packing.CAPACITY + 1
        cuts = [0, *range(first, len(ids) + 1, packing.CAPACITY)]
        wanted += [(doc_id, i, a, b - a, brute.crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    order = lambda r: (r[0] is not None, *[x or 0 for x in r])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(wanted, key=order)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= packing.CAPACITY
    equal = odd.filter("doc_id = 5")
    assert packing.pack(equal.unionByName(equal).unionByName(equal)).count() == 6  # ties: pieces of the same length
    assert packing.pack(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (4, None)], "doc_id long, toxic int").withColumn("label", F.lit(1))
    rows = toxicity.scored(odd, *toxicity.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(odd, *toxicity.train(odd, labels.limit(0))).count() == odd.count()
    assert toxicity.scored(none, *toxicity.train(none, labels)).count() == 0


def test_pipeline_stages(spark, odd, none, tmp_path):
    items(spark, odd).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns and after.count() <= docs.count()
                docs = after
            else:
                after.count()


@pytest.mark.parametrize("step", ["n-gram Jaccard join", "substring dedup", "best-fit packing"])
def test_pipeline_sends_texts_in_batches_of_few_bytes(spark, step):
    """A task's whole share of texts went to its Python worker as one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3_000, numPartitions=1).selectExpr("id AS doc_id", "repeat(md5(string(id)), 250) AS text", "'xx' AS lang", "'h' AS source", "8000L AS n_chars")
    measured = lambda: [r.size for r in docs.select("text").mapInArrow(lambda batches: (batch(arrow("size long"), [b.nbytes]) for b in batches), "size long").collect()]
    had = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        dict(corpus_pipeline.STAGES)[step](spark, docs.limit(0), "")
        assert max(measured()) < 5 << 20 and sum(measured()) >= 3_000 * 8_000
        spark.conf.set(name, "1m")  # a session's own limit holds
        dict(corpus_pipeline.STAGES)[step](spark, docs.limit(0), "")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, had) if had else spark.conf.unset(name)


def test_pipeline_of_the_small_tables(spark):
    """Each stage against its brute-force version on what the one before it kept."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.pinned(stages["quality rules"](spark, docs, folder))
    judged = {r.doc_id for r in host_rules.judged(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == judged
    single = corpus_pipeline.pinned(stages["n-gram Jaccard join"](spark, kept, folder))
    groups = brute.overlap_components([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in single.collect()} == {c for _, c in groups.values()}
    cut = corpus_pipeline.pinned(stages["substring dedup"](spark, single, folder))
    before = [(r.doc_id, r.text) for r in single.collect()]
    repeats = brute.long_repeats(before, 15)
    for r in cut.collect():
        assert r.n_chars == len(r.text) and (repeats[r.doc_id] or r.text == dict(before)[r.doc_id])
    clean = corpus_pipeline.pinned(stages["benchmark decontamination"](spark, cut, folder))
    sets = {r.item_id: brute_shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    dirty = {r.doc_id for r in cut.collect() if any(len(s & brute_shingles(r.text)) * 100 >= 80 * len(s) for s in sets.values())}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - dirty
    packed = stages["best-fit packing"](spark, clean, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def brute_shingles(text):
    import regex

    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
