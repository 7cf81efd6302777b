"""Near-duplicate passages inside documents, by MinHash banding of paragraphs.

The passages that documents share begin and end anywhere, mid-line as well, so lines make
poor paragraphs. A paragraph here is a run of words between two cuts that the content
itself makes: text is cut before a word pair whose hash is the least of all pairs up to
REACH words to either side. Whatever stands around a passage, its inside is cut alike.

Paragraphs are banded by MinHash values of their 5-word shingles; bands are tuned to the
recall asked for. Paragraphs that collide in a band and differ are compared by exact
Jaccard similarity and linked at 80 % (:mod:`thresher.llm.links`); equal ones are one item
from the start. Each component keeps its first paragraph, by doc_id and place.

The other paragraphs are seeds. A changed word spoils the paragraph around it and a passage
begins inside one, so a seed is extended over the words of its text and of the keeper's text
to either side, as long as that gains: an equal word counts 1, an unequal one takes PENALTY away.
The extended span is removed with its seed if the shingles of both spans are 80 % alike, exactly
counted. What is removed side by side is one span, and stays if it has under LEAST_WORDS words, as
licence lines do. A text is compared with the texts of its keepers only, which have lesser
doc_ids, so of every passage a copy stays, and a passage in n texts costs n comparisons.

Null, empty and blank texts have no paragraphs and stay as they are. Repeats inside one
doc_id are left alone, and so are texts without a doc_id. Rows with equal doc_id and text are the same document and lose
the same words. Very long texts are many paragraphs like any others. An empty table has no passages.
Columns other than doc_id and text travel along under their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from thresher.llm.links import bit_table, compared, linked, runs_of, sketch, told
from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, mix, shingles, signed, slices, word_hashes, words_of
from thresher.operators.ordering import attach
from thresher.session import pinned, settled

WORDS = 5
PERCENT = 80
RECALL = 0.98
ROWS = 2
REACH = 5
LEAST_WORDS = 15
SKETCH_BITS = 64
PENALTY = 5
# An extension ends where it has lost so much against its best point; AROUND words are at hand beyond the seeds.
DROP = 40
AROUND = 64
STEP_WORDS = 128
SPANS = "doc_id long, text_hash long, first long, words long, first_doc_id long"
PLACES = "doc_id long, text_hash long, item long, block int, first int, words int, hashes binary"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bands_for(percent=PERCENT, recall=RECALL, rows=ROWS):
    """The fewest bands of `rows` values that find pairs at the threshold with the given chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def least_of(values, size):
    """The least of each `size` values in a row."""
    have = 1
    while 2 * have <= size:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return np.minimum(values[:len(values) - (size - have)], values[size - have:]) if have < size else values


def cuts(hashes, sizes, reach=REACH):
    """Where paragraphs begin in texts of so many words that stand one after the other in `hashes`."""
    count, ends = len(hashes), np.cumsum(sizes)
    highest = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Between texts stand `reach` pairs that are no less than any; the last word of a text begins no pair.
    places = np.arange(count) + reach * (1 + np.repeat(np.arange(len(sizes)), sizes))
    pairs = np.full(count + reach * (len(sizes) + 1), highest)
    pairs[places[:-1]] = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    pairs[places[ends[sizes > 0] - 1]] = highest
    least = least_of(pairs, reach)
    # Of equal ones the first counts.
    begins = (pairs[places] < least[places - reach]) & (pairs[places] <= least[places + 1])
    begins[(ends - sizes)[sizes > 0]] = True
    return np.flatnonzero(begins)


class Paragraphs:
    """The paragraphs of some texts: text, place in it, first word, number of words, and shingles one after the other.

    `elements[starts[i]:starts[i + 1]]` are the shingles of the i-th, `items` name their
    multisets, `sizes` count distinct ones. A paragraph of fewer words than a shingle is one element.
    """

    def __init__(self, texts):
        lists = [words_of(text) for text in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        hashes = word_hashes([w for words in lists for w in words])
        begins = cuts(hashes, counts) if len(hashes) else np.empty(0, np.int64)
        text_begins = np.cumsum(counts) - counts
        self.texts = np.repeat(np.arange(len(counts)), counts)[begins]
        self.words = np.diff(begins, append=len(hashes))
        self.firsts = begins - text_begins[self.texts]
        self.blocks = np.arange(len(begins)) - np.searchsorted(self.texts, np.arange(len(counts)))[self.texts]
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.words - WORDS + 1, 1))])
        self.elements = np.empty(self.starts[-1], np.uint64)
        for size in range(1, WORDS):
            short = np.flatnonzero(self.words == size)
            self.elements[self.starts[short]] = shingles_at(hashes, begins[short], size)
        long = self.words >= WORDS
        lengths = (self.words - WORDS + 1)[long]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        windows = shingles(hashes, WORDS) if len(hashes) >= WORDS else np.empty(0, np.uint64)
        self.elements[np.repeat(self.starts[:-1][long], lengths) + inside] = windows[np.repeat(begins[long], lengths) + inside]
        if not len(begins):
            self.sizes, self.items = np.empty(0, np.int64), np.empty(0, np.int64)
            return
        self.sizes = self.distinct_sizes()
        self.items = signed(mix(np.add.reduceat(mix(self.elements + np.uint64(1)), self.starts[:-1]) + np.diff(self.starts).astype(np.uint64)))

    def __len__(self):
        return len(self.firsts)

    def distinct_sizes(self):
        sizes = np.diff(self.starts)
        of = np.repeat(np.arange(len(self)), sizes)
        keys = mix(self.elements + mix(of.astype(np.uint64)))  # a shingle that comes again in a paragraph has an equal key
        order = np.sort(keys)
        again = order[1:][order[1:] == order[:-1]]
        if len(again):
            for i in np.unique(of[np.isin(keys, again)]).tolist():
                sizes[i] = len(np.unique(self.elements[self.starts[i]:self.starts[i + 1]]))
        return sizes

    def sets(self, chosen):
        """The sorted distinct shingles of the chosen paragraphs, as bytes."""
        return [np.unique(self.elements[a:b]).tobytes() for a, b in zip(self.starts[chosen].tolist(), self.starts[chosen + 1].tolist())]


def shingles_at(hashes, begins, size):
    """The shingles of `size` words that begin at the given words."""
    return shingles(hashes[begins[:, None] + np.arange(size)].T, size)[0] if len(begins) else np.empty(0, np.uint64)


def band_keys(whole, starts, bands, rows, seeds):
    """The band keys of sets that stand one after the other in `whole`: one row per band."""
    values = [np.minimum.reduceat(mix(whole ^ seed), starts) for seed in seeds]
    keys = np.zeros((bands, len(starts)), np.uint64)
    for i in range(bands):
        for j in range(rows):
            keys[i] = mix(keys[i] + values[i * rows + j] + np.uint64(i + 1))
    return keys


def seeds_of(count):
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def postings(documents: DataFrame, bands, rows) -> DataFrame:
    """The band keys of all paragraphs."""

    def run(batches):
        schema, seeds = arrow("key long, item long, size long"), seeds_of(bands * rows)
        for one in slices(batches, 500, 1 << 20):
            found = Paragraphs(one.column(0).to_pylist())
            if len(found):
                keys = band_keys(found.elements, found.starts[:-1], bands, rows, seeds)
                yield batch(schema, signed(keys.ravel()), np.tile(found.items, bands), np.tile(found.sizes, bands))

    return documents.select("text").mapInArrow(run, "key long, item long, size long")


def places_of(documents: DataFrame, wanted: DataFrame, differing: DataFrame) -> DataFrame:
    """Where the wanted items stand; with their shingles where they meet differing ones.

    Both are told by bit tables of fixed size first; a false positive is joined away.
    """
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((bit_table(wanted.select("item")), bit_table(differing.select("item"))))

    def run(batches):
        schema = arrow(PLACES)
        known, unlike = shared.value
        for one in slices(batches, 500, 1 << 20):
            found = Paragraphs(one.column(1).to_pylist())
            spots = np.flatnonzero(told(known, found.items))
            texts, differs = pa.array(found.texts[spots]), told(unlike, found.items[spots])
            hashes = np.full(len(spots), None, object)
            hashes[differs] = found.sets(spots[differs])
            yield batch(schema, one.column(0).take(texts), one.column(2).take(texts), found.items[spots],
                        *(x[spots].astype(np.int32) for x in (found.blocks, found.firsts, found.words)), hashes)

    found = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, PLACES)
    return found.join(wanted.withColumnRenamed("item", "wanted"), F.col("item") == F.col("wanted"), "left_semi")


def sketches_of(batches):
    for one in batches:
        prints = [sketch(np.frombuffer(h, np.uint64), SKETCH_BITS) for h in one.column(2).to_pylist()]
        yield batch(arrow("item long, size long, sketch binary"), one.column(0), [n // 8 for n in one.column(1).to_pylist()], prints)


def extension(a, b):
    """How many words of two arrays go on alike from their beginnings."""
    best = total = at = length = 0
    end = min(len(a), len(b))
    while at < end and total >= best - DROP:
        stop = min(at + STEP_WORDS, end)
        same = a[at:stop] == b[at:stop]
        first = int(same.argmin()) if len(same) else 0  # the first unequal word, or 0 if all are equal
        if same[first]:
            total += stop - at
            if total > best:
                best, length = total, stop
        elif stop == end and np.count_nonzero(same[first:]) <= PENALTY:  # nothing behind it can make up for it
            return at + first if total + first > best else length
        else:
            sums = total + np.cumsum(np.where(same, 1, -PENALTY))
            k = int(sums.argmax())
            if sums[k] > best:
                best, length = int(sums[k]), at + k + 1
            total = int(sums[-1])
        at = stop
    return length


def alike_spans(a, b, percent):
    if len(a) == len(b) and (a == b).all():
        return True
    few, many = (np.unique(shingles(x.astype(np.uint64), WORDS)) for x in (a, b))
    shared = len(np.intersect1d(few, many, assume_unique=True))
    return 100 * shared >= percent * (len(few) + len(many) - shared)


def grown(a, b, seeds, percent):
    """The spans (first, words) of `a` that seeds (first, words, other first, other words) grow to; `b` holds the others."""
    spans, done = [], -1
    for first, words, other, others in sorted(seeds):
        if first + words <= done:
            continue
        end, other_end = first + words, other + others
        left, right = extension(a[:first][::-1], b[:other][::-1]), extension(a[end:], b[other_end:])
        low, other_low, high, other_high = first - left, other - left, end + right, other_end + right
        if words != others:  # the two may be cut apart at one end only
            back, on = extension(a[:end][::-1], b[:other_end][::-1]), extension(a[first:], b[other:])
            if back > words + left:
                low, other_low = end - back, other_end - back
            if on > words + right:
                high, other_high = first + on, other + on
        if alike_spans(a[low:high], b[other_low:other_high], percent):
            spans.append((low, high - low))
            done = high
    return spans


def word_rows(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hash, hashes) of the documents whose (id, hash) is wanted: 32 bits a word."""
    key = lambda a, b: F.xxhash64(a, b)
    shared = documents.sparkSession.sparkContext.broadcast(bit_table(wanted.select(key("id", "hash"))))

    def run(batches):
        schema = arrow("id long, hash long, hashes binary")
        for one in slices(batches, 500):
            spots = np.flatnonzero(told(shared.value, one.column(3).to_numpy()))
            yield batch(schema, one.column(0).take(pa.array(spots)), one.column(1).take(pa.array(spots)),
                        [word_hashes(words_of(one.column(2)[i].as_py())).astype("<u4").tobytes() for i in spots.tolist()])

    named = documents.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    return named.withColumn("key", key("id", "hash")).mapInArrow(run, "id long, hash long, hashes binary").dropDuplicates(["id", "hash"])


def extended(documents: DataFrame, seeds: DataFrame, percent) -> DataFrame:
    """The spans that seeds grow to.

    `seeds` has doc_id, text_hash, first, words, and the same of the keeper in a struct. A row goes out
    for each document and keeper, with the words of both around their seeds only.
    """
    pairs = pinned(seeds.filter(F.col("doc_id") != F.col("keeper.doc_id")).groupBy(
        "doc_id", "text_hash", F.col("keeper.doc_id").alias("k_id"), F.col("keeper.text_hash").alias("k_hash")).agg(
        F.collect_list(F.array("first", "words", "keeper.first", "keeper.words")).alias("seeds")))
    ends = F.explode(F.array(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), F.struct(F.col("k_id").alias("id"), F.col("k_hash").alias("hash"))))
    texts = pinned(word_rows(documents, pairs.select(ends.alias("e")).select("e.*").distinct()))

    def beside(rows, name, id_column, hash_column, at):
        low = F.greatest(F.lit(0), F.array_min(F.transform("seeds", lambda x: x[at])) - AROUND)
        high = F.array_max(F.transform("seeds", lambda x: x[at] + x[at + 1])) + AROUND
        held = texts.select(F.col("id").alias(f"{name}_of"), F.col("hash").alias(f"{name}_text"), F.col("hashes").alias(f"{name}_hashes"))
        joined = rows.withColumns({f"{name}_low": low, f"{name}_high": high}).join(held, (F.col(id_column) == F.col(f"{name}_of")) & (F.col(hash_column) == F.col(f"{name}_text")))
        part = F.substring(F.col(f"{name}_hashes"), F.col(f"{name}_low") * 4 + 1, (F.col(f"{name}_high") - F.col(f"{name}_low")) * 4)
        return joined.withColumn(name, part).drop(f"{name}_of", f"{name}_text", f"{name}_hashes", f"{name}_high")

    both = beside(beside(pairs, "a", "doc_id", "text_hash", 0), "b", "k_id", "k_hash", 2)

    def run(batches):
        schema = arrow(SPANS)
        for one in slices(batches, 200):
            rows, bounds = [], np.cumsum(pc.list_value_length(one.column(3)).to_numpy()).tolist()
            doc_ids, hashes, k_ids, a_lows, b_lows = (one.column(i).to_pylist() for i in (0, 1, 2, 4, 6))
            seeds = one.column(3).flatten().flatten().to_numpy().reshape(-1, 4)
            for i, (low, high) in enumerate(zip([0, *bounds], bounds)):
                a, b = (np.frombuffer(one.column(c)[i].as_buffer(), "<u4") for c in (5, 7))
                found = grown(a, b, (seeds[low:high] - np.array([a_lows[i], 0, b_lows[i], 0])).tolist(), percent)
                rows += [(doc_ids[i], hashes[i], first + a_lows[i], words, k_ids[i]) for first, words in found]
            yield batch(schema, *(zip(*rows) if rows else [[]] * 5))

    return both.select("doc_id", "text_hash", "k_id", "seeds", "a_low", "a", "b_low", "b").mapInArrow(run, SPANS)


def merged(spans: DataFrame, least_words) -> DataFrame:
    """Spans of a text that touch, made one; those of fewer than `least_words` go."""
    lists = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", "words", "first_doc_id"))).alias("spans"))

    def run(batches):
        schema = arrow(SPANS)
        for one in slices(batches, 1_000):
            rows = []
            for doc_id, text_hash, found in zip(*(c.to_pylist() for c in one.columns)):
                whole = []
                for x in found:
                    low, high, of = x["first"], x["first"] + x["words"], x["first_doc_id"]
                    if whole and low <= whole[-1][1]:
                        whole[-1] = (whole[-1][0], max(whole[-1][1], high), min(whole[-1][2], of))
                    else:
                        whole.append((low, high, of))
                rows += [(doc_id, text_hash, low, high - low, of) for low, high, of in whole if high - low >= least_words]
            yield batch(schema, *(zip(*rows) if rows else [[]] * 5))

    return lists.mapInArrow(run, SPANS)


def repeated_paragraphs(documents: DataFrame, percent, recall) -> DataFrame:
    """The paragraphs of components that several documents have, each with its keeper and whether it is a copy."""
    bands = bands_for(percent, recall)
    runs = pinned(runs_of(postings(documents, bands, ROWS), percent, copies=True))
    wanted = pinned(runs.select("item").distinct())
    differing = pinned(runs.groupBy("key").agg(F.min("item").alias("low"), F.max("item").alias("high")).filter("low <> high")
                       .select(F.col("key").alias("of")).join(runs, F.col("of") == F.col("key")).select("key", "item", "size", "before"))
    places = pinned(places_of(documents, wanted, differing.select("item")))
    sets = pinned(places.filter("hashes is not null").groupBy("item").agg(F.first("hashes").alias("hashes")))
    sketches = sets.select("item", F.length("hashes").cast("long").alias("bytes"), "hashes").mapInArrow(sketches_of, "item long, size long, sketch binary")
    found = linked(differing, pinned(sketches), lambda pairs: compared(pairs, sets, percent), percent)
    named = pinned(places.join(found.withColumnRenamed("item", "of"), F.col("item") == F.col("of"), "left").select(
        "doc_id", "text_hash", "block", "first", "words", F.coalesce("component", "item").alias("component")))
    spot = F.struct("doc_id", "block", "text_hash", "first", "words")
    firsts = named.groupBy("component").agg(F.min(spot).alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).filter("keeper.doc_id < last")
    repeated = attach(named, firsts, "component", "size", ["keeper"]).filter("keeper is not null").dropDuplicates(["doc_id", "text_hash", "block"])
    return repeated.withColumn("removed", (F.col("doc_id") != F.col("keeper.doc_id")) | (F.col("block") != F.col("keeper.block"))).drop("component")


def shared_passages(documents: DataFrame, percent=PERCENT, recall=RECALL, least_words=LEAST_WORDS) -> DataFrame:
    """One row per passage that a document shares with others.

    doc_id, text_hash, first (word), words, first_doc_id (the least doc_id that has one
    of the paragraphs), removed (false for the copy that stays).
    """
    documents = documents.filter("doc_id is not null")
    repeated = settled(documents.sparkSession, lambda: repeated_paragraphs(documents, percent, recall))
    copies = repeated.filter("removed")
    gone = merged(extended(documents, copies, percent).unionByName(copies.select(
        "doc_id", "text_hash", F.col("first").cast("long").alias("first"), F.col("words").cast("long").alias("words"), F.col("keeper.doc_id").alias("first_doc_id"))), least_words)
    # The copies that stay. Neighbouring paragraphs form one run: their blocks rise as their row numbers do. A document's rows are few.
    numbered = repeated.withColumn("run", F.col("block") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("block")))
    whole = numbered.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "text_hash", "run"))).filter(F.col("run_words") >= least_words)
    stay = whole.filter("not removed").withColumn("part", F.col("block") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("block")))
    stay = stay.groupBy("doc_id", "text_hash", "part").agg(
        F.min("first").cast("long").alias("first"), F.sum("words").cast("long").alias("words"), F.min("keeper.doc_id").alias("first_doc_id")).drop("part")
    return gone.withColumn("removed", F.lit(True)).unionByName(stay.withColumn("removed", F.lit(False)))


def without(text, spans):
    """A text less the given (first word, words), each with the white space that follows."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for first, count in sorted(spans):
        out.append(text[at:starts[first]])
        at = starts[first + count]
    return "".join([*out, text[at:]])


def deduplicated(documents: DataFrame, **settings) -> DataFrame:
    """The documents without their removed passages; documents of which nothing is left go.

    `n_chars`, where there is one, is counted again.
    """
    # Written, so that all else may go and Spark knows whether texts need to move to them.
    spans = settled(documents.sparkSession, lambda: shared_passages(documents, **settings).filter("removed").groupBy(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("first", "words")).alias("_spans")))
    joined = documents.join(spans, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if s is None else without(t, [(x["first"], x["words"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    # Said to be nondeterministic, or the filter would cut once more, in a worker of its own.
    cut = cut.asNondeterministic()
    edited = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut(F.when(F.col("_spans").isNotNull(), F.col("text")), "_spans"))
    rows = joined.withColumn("text", edited)
    rows = rows.filter(F.col("_spans").isNull() | (F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns])


@query()
def op3_shared_passages(spark, sf_dir):
    """The passages that documents share: which words of which document, and whether they are removed."""
    return shared_passages(table(spark, sf_dir, "documents")).select("doc_id", "first", "words", "first_doc_id", "removed")
