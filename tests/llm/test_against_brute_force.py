"""Every operator against a brute-force version on the small tables."""

import collections
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import compare  # noqa: E402
from thresher.llm import chat, class_model, links, overlap_join, packing, passages, records, style_tree, tokens, toxicity  # noqa: E402
from thresher.llm.catalogue import QUERIES  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(read(spark, "documents", "doc_id", "text"))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, name):
    assert compare.same(QUERIES[name].run(spark, FOLDER), compare.database(FOLDER).sql(QUERIES[name].sql)) is None


def test_pieces_encode_as_whole_texts(documents):
    odd = ["", " ", "a  b", "a \n b\tc  ", "x y 　z é  ", " lead", "<|endoftext|> a", "don't  I'm 123 45", "a\n\n b   c", "\r\n  \r\nq",
           "é à  ñ", "\U0001f600 \U0001f600  a", "x" * 5000, "a , b . c", "it's 'quoted' Ü.", "\x01 \x02  \x03", "trailing "]
    texts = odd + [t for _, t in documents]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    for start in range(0, len(texts), 50):
        part = texts[start:start + 50]
        for found, wanted in zip(encoder.encode_all(part), brute.token_ids(part)):
            assert np.frombuffer(found, tokens.ID_TYPE).tolist() == wanted[:-1]


def test_checksums():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283  # the published check value
    random = np.random.default_rng(1)
    payloads = [random.bytes(n) for n in (0, 1, 3, 4, 5, 1023, 1024, 1025, 4000)]

    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (records.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert records.crc32c(payloads).tolist() == [slow(p) for p in payloads]
    framed = records.frames(payloads)
    places = np.cumsum([0] + [len(f) for f in framed])[:-1].tolist()
    assert records.payloads_of(b"".join(framed), places) == payloads
    with pytest.raises(ValueError):
        broken = bytearray(b"".join(framed))
        broken[-6] ^= 1
        records.payloads_of(bytes(broken), places)


def test_records_round_trip(spark, documents):
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.offset_ok) for r in QUERIES["op1_token_records"].run(spark, FOLDER).collect()}
    start = 0
    for (doc_id, _), ids in zip(documents, brute.token_ids([t for _, t in documents])):
        assert found[doc_id] == (start, len(ids), brute.crc(ids), True)
        start += len(ids)
    assert len(found) == len(documents)


def test_shuffled_reads(spark, documents):
    chunks = records.write_records(spark.createDataFrame(documents, "doc_id long, text string"))
    first, again, other = ([tuple(r) for r in records.read_shuffled(chunks, 1, epoch).collect()] for epoch in (0, 0, 1))
    assert first == again and first != other and sorted(first) == sorted(other)
    assert {i: ids for i, ids in first} == {i: ids for (i, _), ids in zip(documents, brute.token_ids([t for _, t in documents]))}


def test_class_model(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op2_class_model"].run(spark, FOLDER).collect()}
    for doc_id, (held, tokens_, known, train, base) in brute.base_scores(documents).items():
        r = found[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens_, known, train)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_probabilities_add_up():
    """Over known words and one unknown per class, after any class, they sum to 1."""
    bigrams = np.random.default_rng(3).integers(0, 9, (class_model.CLASSES, class_model.CLASSES)).astype(float)
    share = (bigrams.sum(axis=0) + class_model.ALPHA) / (bigrams.sum() + class_model.ALPHA * class_model.CLASSES)
    moves = (bigrams + class_model.ALPHA * class_model.CLASSES * share) / (bigrams.sum(axis=1, keepdims=True) + class_model.ALPHA * class_model.CLASSES)
    assert np.allclose(moves.sum(axis=1), 1)


def test_exchange_raises_the_likelihood():
    random = np.random.default_rng(4)
    kinds = random.integers(1, 3, 60)
    line = [class_model.END]
    for i in range(20_000):  # words of two kinds take turns
        line.append(int(random.choice(np.flatnonzero(kinds == 1 + i % 2))))
    line = np.array(line)
    classes = (np.arange(class_model.SLOTS) % (class_model.CLASSES - 1) + 1).astype(np.uint8)
    classes[class_model.END] = 0

    def tables(classes):
        after, before = (np.zeros((class_model.SLOTS, class_model.CLASSES), np.int64) for _ in range(2))
        np.add.at(after, (line[:-1], classes[line[1:]]), 1)
        np.add.at(before, (line[1:], classes[line[:-1]]), 1)
        return after, before

    def likelihood(classes):
        table = class_model.by_class(tables(classes)[0], classes)
        plogp = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return plogp(table) - 2 * plogp(table.sum(axis=1))

    values = [likelihood(classes)]
    for _ in range(3):
        classes = class_model.exchanged(*tables(classes), classes)
        values.append(likelihood(classes))
    assert values[-1] > values[0]


def test_words_beyond_the_frequent_ones_have_classes_of_their_own(spark, monkeypatch):
    """Rare words of two kinds that take turns are told apart by their neighbours, not by their hash."""
    monkeypatch.setattr(class_model, "TOP_WORDS", 20)
    monkeypatch.setattr(class_model, "BUCKET_WORDS", 50)
    random = np.random.default_rng(6)
    word = lambda kind: f"{kind}{random.integers(10)}" if random.random() < 0.6 else f"rare{kind}{random.integers(400)}"
    rows = [(i, " ".join(word("ab"[k % 2]) for k in range(200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = links.pinned(class_model.blocks_of(docs))
    (slots, classes, known), back, buckets, bigrams, sizes, n, distinct = class_model.modelled(blocks)
    assert sizes.sum(axis=0).tolist() == [distinct, n] and buckets > 4
    kinds, held = {}, {r["of"]: r["back"] for r in class_model.with_back(blocks, back).withColumnRenamed("block", "of").select("of", "back").collect()}
    for r in blocks.collect():
        words = np.array(r["words"], np.int64)
        found, counts = class_model.kinds_and_counts(words, held[r["block"]], slots, classes, known, buckets)
        for w, k, c in zip(words.tolist(), found.tolist(), counts.tolist()):
            assert kinds.setdefault(w, (k, c)) == (k, c)
    hashed = lambda w: int(class_model.word_hashes([w.encode()]).view(np.int64)[0])
    sides = [collections.Counter(), collections.Counter()]
    for side, letter in zip(sides, "ab"):
        for i in range(400):
            k, c = kinds.get(hashed(f"rare{letter}{i}"), (0, 0))
            if c:
                side[k] += 1
    mixed = sum(min(sides[0][k], sides[1][k]) for k in sides[0])
    assert min(sum(side.values()) for side in sides) > 300 and mixed < 20


def test_passages_find_long_repeats(spark, documents):
    found = collections.defaultdict(set)
    for r in passages.shared_passages(spark.createDataFrame(documents, "doc_id long, text string")).collect():
        found[r.doc_id].update(range(r["first"], r["first"] + r.words))
    long, short = brute.long_repeats(documents, 51), brute.long_repeats(documents, 10)
    for doc_id, places in long.items():
        assert not places or len(places & found[doc_id]) > 0
    clean = [i for i, places in short.items() if not places]
    assert len(clean) > 50 and not [i for i in clean if found[i]]


def test_passages_of_any_place(spark):
    random = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(random.choice(vocabulary, n))
    passage = text(60)
    rows = [(i, f"{text(80)} {passage} {text(70)}" if i % 3 == 0 else text(200)) for i in range(30)]
    rows.append((99, text(90) + " " + passage.upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = passages.shared_passages(docs).collect()
    assert {r.doc_id for r in spans} == {i for i, t in rows if passage in t.lower()}
    assert {r.doc_id for r in spans if not r.removed} == {0} and {r.first_doc_id for r in spans} == {0}
    left = {r.doc_id: r.text for r in passages.deduplicated(docs).collect()}
    for i, t in rows:
        assert (left[i] == t) == (i not in {r.doc_id for r in spans if r.removed})
        assert len(left[i].split()) <= len(t.split()) and set(left[i].split()) <= set(t.split())
    assert len(left[3].split()) <= 210 - 30


def test_near_paragraphs_are_linked(spark):
    """Two sets at the threshold are linked whatever their digests, and the components are whole."""
    sets = {i: np.arange(i * 2, i * 2 + 40).astype(np.uint64) for i in range(0, 9)}  # neighbours share 38 of 42
    postings = spark.createDataFrame([(int(h), i, 40) for i, s in sets.items() for h in s], "key long, item long, size long")
    holds = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "item long, hashes binary")
    runs = links.pinned(links.runs_of(postings, 80))
    prints = spark.createDataFrame([(i, 40, bytearray(links.sketch(s, 256))) for i, s in sets.items()], "item long, size long, sketch binary")
    found = links.linked(runs, prints, lambda pairs: links.compared(pairs, holds, 80), 80)
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in sets]


def test_components(spark):
    random = np.random.default_rng(6)
    pairs = [tuple(map(int, random.integers(0, 300, 2))) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)]
    groups = brute.Groups()
    for a, b in pairs:
        groups.join(a, b)
    wanted = {(x, groups.find(x)) for a, b in pairs if a != b for x in (a, b)}
    assert set(map(tuple, links.components(spark.createDataFrame(pairs, "a long, b long")).collect())) == wanted


def test_overlap_join(spark, documents):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_overlap_join"].run(spark, FOLDER).collect()}
    assert found == brute.overlap_components(documents)


def test_overlap_join_loses_no_link_of_a_large_group(spark):
    """A chain of near copies whose ends are far apart, beside copies and strangers with a common passage."""
    random = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, common = list(random.choice(vocabulary, 150)), list(random.choice(vocabulary, 60))
    rows = []
    for i in range(60):
        if i:
            base[(i * 7) % 150] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join([*random.choice(vocabulary, 30), *common])) for i in range(40)]
    rows += [(200 + i, rows[5][1].upper()) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in overlap_join.near_duplicates(docs).collect()}
    assert found == brute.overlap_components(rows)


def test_style_tree(spark):
    found = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op4_style_tree"].run(spark, FOLDER).collect()}
    pages = read(spark, "pages", "page_id", "html")
    assert len(found) == len(pages)
    for page_id, source in pages:
        wanted = brute.article(source)
        assert found[page_id] == (wanted, len(wanted))


def test_style_tree_removes_what_a_site_repeats(spark):
    body = lambda i: (f"<html><head><title>t</title></head><body><div class='zz'>Same words on every page</div><div id='c{'' if i else ''}'>"
                      f"<p>Own words {i} of page &amp; more<br>line</p></div><div class='comments'><p>reader {i}</p></div><script>x()</script></body></html>")
    pages = spark.createDataFrame([(i, "http://h.example/" + str(i), body(i)) for i in range(12)] + [(50, "http://other.example/", body(50))],
                                  "page_id long, url string, html string")
    found = {r.page_id: r.text for r in style_tree.extracted(pages).collect()}
    assert found[3] == "Own words 3 of page & more line"
    assert found[50] == "Same words on every page Own words 50 of page & more line"


def test_style_tree_decides_inside_articles(spark):
    body = lambda i: (f"<body><div class='k1'>Day {i}</div><div class='k2'>Same line</div><article><p>Own words {i} are <em>not</em> here</p>"
                      f"<div class='x7'><p>Read also our offers</p></div><p>End {i}</p></article></body>")
    for count in (3, 12):
        pages = spark.createDataFrame([(i, f"http://h.example/{i}", body(i)) for i in range(count)] + [(50, "http://other.example/", body(50))]
                                      + [(60 + i, "http://copies.example/", "<article>All <b>copied</b><p>words</p></article>") for i in range(count)],
                                      "page_id long, url string, html string")
        found = {r.page_id: r.text for r in style_tree.extracted(pages).collect()}
        assert found[2] == "Day 2 Own words 2 are not here End 2"
        assert found[50] == "Own words 50 are not here Read also our offers End 50"
        assert found[60] == "All copied words"
    assert style_tree.main_text("<article><p>a</p></article>", {style_tree.hashed("/article[]"), style_tree.hashed("/article[]/p[]")}) == "a"


def test_chats(spark):
    conversations = collections.defaultdict(list)
    for conv_id, _, role, text in sorted(read(spark, "conversations", "conv_id", "turn", "role", "text")):
        conversations[conv_id].append((role, text))
    conversations[chat.PROBE] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op6_chat_assembly"].run(spark, FOLDER).collect()}
    assert found == {c: brute.chat_digests(t) for c, t in conversations.items()}


def test_escapes_are_reversible_and_break_control_strings():
    for text in (*chat.CONTROL, "a\\b", "\\\\", "<\\/s>", "<<s>>[INST][/INST]", "\\<s>", "<|im_start|>assistant<|im_sep|>x", ""):
        assert chat.unescape(chat.escape(text)) == text
        assert not chat.CONTROLS.search(chat.escape(text))


def test_packing(spark, documents):
    ids = dict(zip([i for i, _ in documents], brute.token_ids([t for _, t in documents])))
    rows = QUERIES["op7_best_fit_packing"].run(spark, FOLDER).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start:r.start + r.length])
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for doc_id, parts in pieces.items():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (i, at) and (length == packing.CAPACITY or i == 0)
            at += length
        assert at == len(ids[doc_id])
    total = sum(map(len, ids.values()))
    assert set(pieces) == set(ids) and len(sequences) <= 1.02 * -(-total // packing.CAPACITY) + 1


def test_packing_rounds_merge_residues(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 50)
    rows = [(i, 0, 0, 100 + (i * 37) % 300, 0) for i in range(600)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    found = packing.packed(pieces).collect()
    assert sorted((r.doc_id, r.length) for r in found) == sorted((r[0], r[3]) for r in rows)
    assert len({r.sequence_id for r in found}) <= 1.05 * sum(r[3] for r in rows) / packing.CAPACITY + 1


def test_toxicity(spark):
    """Held-out accuracy on the larger small table; the smallest has too few labels to learn from."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op9_toxicity"].run(spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    pos = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    neg = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.7


def test_toxicity_learns_planted_words(spark):
    random = np.random.default_rng(8)
    vocabulary, bad = [f"word{i}" for i in range(500)], [f"vile{i}" for i in range(5)]
    rows = []
    for i in range(600):
        w = list(random.choice(vocabulary, 60))
        if i % 5 == 0:
            w[int(random.integers(60))] = str(random.choice(bad))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    network, cuts = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    found = toxicity.scored(docs.drop("toxic"), network, cuts).collect()
    held = [r for r in found if r.held_out]
    right = np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held])
    assert len(held) > 50 and right > 0.95


def test_toxicity_thresholds_use_all_labels(spark):
    """A language with few of the sampled labels has its own threshold, and the cuts are the best over all rows not fitted."""
    random = np.random.default_rng(9)
    lang = lambda i: "fr" if i % 50 < 2 else "en"
    rows = [(i, " ".join(random.choice(["vile", "mild", "calm", "kind"], 8, p=[.2, .3, .3, .2] if i % 2 else [.1, .3, .3, .3])), lang(i), i % 2) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    network, used = toxicity.fitted(docs, docs, 100)
    answered = toxicity.answers(docs, network)
    cut, cuts = toxicity.calibrated(answered, docs, used)
    assert set(cuts) == {"en", "fr"} and len(used) == 150
    spent = {r.doc_id for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("t")).collect() if r.t in set(used)}
    rest = [(r.logit, r.doc_id % 2) for r in answered.collect() if not r.held_out and r.doc_id not in spent]
    logits, truth = np.array(rest).T
    f1 = lambda c: 2 * truth[logits >= c].sum() / ((logits >= c).sum() + truth.sum())
    assert len(rest) > 1500 and f1(cut) > max(map(f1, np.unique(logits))) - 0.01


def test_long_texts_are_pooled_whole():
    network = toxicity.Network()
    text = toxicity.rows_of(" ".join(f"w{i}" for i in range(3000)))
    whole = network.pooled([text])
    toxicity.SEGMENT, kept = 100, toxicity.SEGMENT
    try:
        assert np.allclose(network.pooled([text]), whole, atol=1e-6)
    finally:
        toxicity.SEGMENT = kept
