"""Jaccard join of documents on word n-grams by T-occurrence search.

Two sets of n-grams with 100 * intersection >= percent * union share at least
T = ceil(percent * n / 100) elements, n the size of either. As in DivideSkip the inverted lists of a
set are divided: it is posted under its n - T + t shortest lists only, t = OCCURS (or T, if that
is less), and a partner occurs in at least t of these. Sets under a key are merged in the order of size; what
occurs together is counted, and pairs of t occurrences are kept. The T - t long lists are never
made: whether a pair reaches T is told by binary probes of the one set's elements in the
other's sorted ones. Groups of near copies do not make all their pairs: neighbours under a key are
probed first, and only sets of different components are counted (:mod:`thresher.llm.links`).

Which lists are short is told by a table of counts of fixed size that n-grams are hashed to; a wrong
count makes a list longer, never a link lost, since any one order of the n-grams gives the same
result. Partners whose parity sketches differ too much to be linked are dropped before their sets are
fetched.

Documents with equal sets are one class, found by a digest, and take part once. Null,
empty and blank texts have an empty set and no links. Repeated doc_ids are separate rows. A very long
text is a large set; sets of equal size meet in an order by digest. An empty table gives an empty result.
Only doc_id and text are read of the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from thresher.llm.links import bit_table, compared, linked, runs_of, sketch, told
from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, digest, shingles, signed, slices, word_hashes, words_of
from thresher.session import pinned, settled

WORDS = 4
PERCENT = 85
# How many of a set's short lists a partner occurs in.
OCCURS = 3
# Cells of the count table that is broadcast, two bytes each.
CELL_BITS = 21
CELLS_PER_CHUNK = 4096
SURVEY = "doc_id long, item long, size long, sketch binary, chunk int, cells binary, counts binary"
# Bits of a set's sketch; it rules out most chance partners of sets of up to about 2.5 times as many elements.
SKETCH_BITS = 1024


def set_of(text, words):
    """The sorted hashes of a text's n-grams."""
    return np.unique(shingles(word_hashes(words_of(text)), words))


def item_of(hashes):
    return digest(hashes) if len(hashes) else None


def surveyed(documents: DataFrame, words) -> DataFrame:
    """Per document its class and size, and per task the cells its n-grams fall in."""

    def run(batches):
        schema, counts = arrow(SURVEY), np.zeros(1 << CELL_BITS, np.int64)
        for one in slices(batches):
            ids, items, sizes, sketches = one.column(0).to_pylist(), [], [], []
            for text in one.column(1):
                hashes = set_of(text.as_py(), words)
                np.add.at(counts, hashes & np.uint64((1 << CELL_BITS) - 1), 1)
                items.append(item_of(hashes))
                sizes.append(len(hashes))
                sketches.append(sketch(hashes, SKETCH_BITS))
            yield batch(schema, ids, items, sizes, sketches, *[[None] * len(ids)] * 3)
        table = counts.reshape(-1, CELLS_PER_CHUNK)
        rows = [(None, None, None, None, c, np.flatnonzero(table[c]).astype("<u2").tobytes(), table[c][table[c] > 0].astype("<u4").tobytes())
                for c in np.flatnonzero(table.any(axis=1)).tolist()]
        yield batch(schema, *(zip(*rows) if rows else [[]] * 7))

    return documents.select("doc_id", "text").mapInArrow(run, SURVEY)


def cell_ranks(survey: DataFrame):
    """The count of each cell, as far as two bytes tell it; fixed in size."""

    def run(batches):
        totals = {}
        for one in batches:
            for chunk, cells, counts in zip(*(one.column(i).to_pylist() for i in range(3))):
                total = totals.setdefault(chunk, np.zeros(CELLS_PER_CHUNK, np.int64))
                total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<u4")
        yield batch(arrow("chunk int, ranks binary"), list(totals), [
            np.minimum(t, 65535).astype(np.uint16).tobytes() for t in totals.values()])

    parts = survey.filter("chunk is not null").select("chunk", "cells", "counts").repartition("chunk")
    ranks = np.zeros(((1 << CELL_BITS) // CELLS_PER_CHUNK, CELLS_PER_CHUNK), np.uint16)
    for row in parts.mapInArrow(run, "chunk int, ranks binary").collect():
        ranks[row["chunk"]] = np.frombuffer(row["ranks"], np.uint16)
    return ranks.ravel()


def short_lists(documents: DataFrame, ranks, words, percent) -> DataFrame:
    """The postings of each document's shortest lists; copies inside a batch count once."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        schema, order_by = arrow("key long, item long, size long"), shared.value
        for one in slices(batches):
            seen, keys, items, sizes = set(), [np.empty(0, np.uint64)], [], []
            for text in one.column(1):
                hashes = set_of(text.as_py(), words)
                item = item_of(hashes)
                if item is None or item in seen:
                    continue
                seen.add(item)
                size = len(hashes)
                most = (percent * size + 99) // 100
                short = size - most + min(OCCURS, most)
                rank = order_by[hashes & np.uint64((1 << CELL_BITS) - 1)]
                keys.append(hashes[np.argsort(rank, kind="stable")[:short]])
                items.append(np.full(short, item, np.int64))
                sizes.append(np.full(short, size, np.int64))
            if items:
                yield batch(schema, signed(np.concatenate(keys)), np.concatenate(items), np.concatenate(sizes))

    return documents.select("doc_id", "text").mapInArrow(run, "key long, item long, size long")


def sets_of(documents: DataFrame, wanted: DataFrame, words) -> DataFrame:
    """(item, hashes) of the wanted (item, first), made again from the texts of these documents.

    A bit table of fixed size tells the documents, so that no other text is looked at or
    shuffled. The few sets it lets through by chance meet no pair in the joins that follow.
    """
    spark = documents.sparkSession
    ids = F.xxhash64("doc_id").alias("hash")
    shared = spark.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("first"))))

    def run(batches):
        schema = arrow("item long, hashes binary")
        for one in slices(batches):
            found = {}
            for i in np.flatnonzero(told(shared.value, one.column(0).to_numpy())):
                hashes = set_of(one.column(1)[i].as_py(), words)
                found[item_of(hashes)] = hashes.tobytes()
            yield batch(schema, list(found), list(found.values()))

    return documents.select(ids, "text").mapInArrow(run, "item long, hashes binary")


def near_duplicates(documents: DataFrame, words=WORDS, percent=PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id it is linked with, over any steps)."""
    survey = pinned(surveyed(documents, words))
    rows = survey.filter("chunk is null").select("doc_id", "item", "size", "sketch")
    classes = pinned(rows.filter("item is not null").groupBy("item").agg(
        F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"), F.first("size").alias("size")))
    runs = pinned(runs_of(short_lists(documents, cell_ranks(survey), words, percent), percent))

    def compare(pairs):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct()
        wanted = pinned(classes.join(ends, F.col("item") == F.col("end"), "left_semi").select("item", "first"))
        return compared(pairs, pinned(sets_of(documents, wanted, words)), percent)

    occurs = lambda sizes: np.minimum(OCCURS, (percent * sizes + 99) // 100)
    found = linked(runs, classes.select("item", "size", "sketch"), compare, percent, occurs)
    placed = pinned(classes.join(found.withColumnRenamed("item", "of"), F.col("item") == F.col("of"), "left").select(
        "item", "first", F.coalesce("component", "item").alias("component")))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least.withColumnRenamed("component", "of"), F.col("component") == F.col("of")).select(
        F.col("item").alias("of"), "component_id")
    return rows.join(named, F.col("item") == F.col("of"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_documents(documents: DataFrame, words=WORDS, percent=PERCENT) -> DataFrame:
    """The documents whose doc_id is that of their component.

    Repeated rows are one document; rows that share a doc_id and differ in text all stay.
    """
    named = settled(documents.sparkSession, lambda: near_duplicates(documents, words, percent))
    gone = pinned(named.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())  # its size decides whether texts move
    kept = documents.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = named.groupBy(F.col("doc_id").alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_twice")
    if twice.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("_twice"))
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


@query()
def op10_overlap_join(spark, sf_dir):
    """The component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
