"""Best-fit packing of token pieces into sequences, by merging residues up a tree.

Documents are tokenized in place and only longer ones are cut: into pieces of `capacity`
ids, of which the first may be shorter. A full piece is a sequence. All others are packed
best-fit, longest first, inside every partition; bins with at most `slack` free ids are
final. The bins below that are items of the next round, dealt to fewer partitions, and
so on until one partition holds all that is left or a round stops helping. A bin carries
its members, at most `capacity` of them, so no round joins anything.

Null and empty texts are one piece, the end id. Repeated doc_ids are separate documents
whose pieces look alike. Empty tables give no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, slices
from thresher.llm.tokens import END_ID, ID_TYPE, encoder, vocabulary_path
from thresher.session import pinned

CAPACITY = 1024
SLACK = 16
# Items that one task packs: its memory is bounded by their members.
TASK_ITEMS = 100_000
# How many partitions meet in one of the next round.
FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "length long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def cut_points(size, capacity):
    """Where the pieces of a document begin, and its size at the end."""
    first = (size - 1) % capacity + 1
    return [0, *range(first, size + 1, capacity)]


def tokenized(documents: DataFrame, capacity=CAPACITY, vocabulary=None) -> DataFrame:
    """One row per piece."""
    vocabulary = vocabulary or vocabulary_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        schema, encode = arrow(PIECES), encoder(vocabulary).encode_all
        for one in slices(batches):
            rows = []
            for doc_id, ids in zip(one.column(0).to_pylist(), encode(one.column(1).to_pylist())):
                wide = np.frombuffer(ids, ID_TYPE).astype("<u4").tobytes() + end
                cuts = cut_points(len(wide) // 4, capacity)
                rows += [(doc_id, i, a, b - a, zlib.crc32(wide[4 * a:4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths, capacity):
    """Bins of item numbers: longest items first, each into the fullest bin it fits."""
    bins, free = [], []  # free: sorted (room, bin)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        spot = bisect_left(free, (lengths[i], -1))
        if spot == len(free):
            room, which = capacity, len(bins)
            bins.append([])
        else:
            room, which = free.pop(spot)
        bins[which].append(i)
        if room > lengths[i]:
            insort(free, (room - lengths[i], which))
    return bins


def pack_round(items: DataFrame, parts, capacity) -> DataFrame:
    """Best-fit inside each of `parts` partitions of items, TASK_ITEMS of them at a time."""

    def run(batches):
        import pyarrow as pa

        waiting, count = [], 0

        def packed():
            items = pa.Table.from_batches(waiting).combine_chunks()
            lengths, members = items.column("length").to_pylist(), items.column("members").chunk(0)
            starts, values = members.offsets.to_numpy(), members.values
            found = best_fit(lengths, capacity)
            order = np.concatenate([np.arange(starts[i], starts[i + 1]) for b in found for i in b])
            sizes = [sum(int(starts[i + 1] - starts[i]) for i in b) for b in found]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([pa.array([sum(lengths[i] for i in b) for b in found], pa.int64()), lists], names=["length", "members"])

        for one in batches:
            if one.num_rows:
                waiting.append(one)
                count += one.num_rows
            if count >= TASK_ITEMS:
                yield packed()
                waiting, count = [], 0
        if waiting:
            yield packed()

    dealt = items.repartition(parts, F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"]))
    return dealt.mapInArrow(run, BINS)


def packed(pieces: DataFrame, capacity=CAPACITY, slack=SLACK) -> DataFrame:
    """`pieces` with a sequence_id and the offset in it.

    Sequences are named by their first member, which no other sequence holds.
    """
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    done = [pieces.filter(F.col("length") >= capacity).select("length", F.array(member).alias("members"))]
    open_bins = pieces.filter(F.col("length") < capacity).select("length", F.array(member).alias("members"))
    count = open_bins.count()
    parts = max(1, -(-count // TASK_ITEMS))
    while count:
        bins = pinned(pack_round(open_bins, parts, capacity))
        under = bins.filter(F.col("length") < capacity - slack)
        left = under.count()
        if parts == 1 or left >= 0.98 * count and parts * TASK_ITEMS >= count:
            done.append(bins)
            break
        done.append(bins.filter(F.col("length") >= capacity - slack))
        open_bins, count = under, left
        parts = max(-(-count // TASK_ITEMS), parts // FAN_IN, 1)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    before = F.aggregate(F.slice("members", 1, F.col("place")), F.lit(0).cast("long"), lambda a, m: a + m["length"])
    placed = numbered.select("sequence_id", "members", F.posexplode("members").alias("place", "m"))
    return placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", before.alias("offset"))


def pack(documents: DataFrame, capacity=CAPACITY, slack=SLACK, vocabulary=None) -> DataFrame:
    """Pieces of all documents with their places; the pieces are written once, as tokenizing is the dear part."""
    return packed(pinned(tokenized(documents, capacity, vocabulary)), capacity, slack)


@query()
def op7_best_fit_packing(spark, sf_dir):
    """Where each piece of each document goes."""
    return pack(table(spark, sf_dir, "documents"))
