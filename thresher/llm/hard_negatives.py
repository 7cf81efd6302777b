"""Hard negatives of anchors by exact integer scores, looked up in subset-sum tables.

Components become floor(256 x). A candidate's components are cut into bit planes (two's
complement) and the planes into bytes, one for each group of eight dimensions. For an
anchor and a group, a table holds the sum of the anchor's components for each of the 256
subsets of the group. A plane's share of the score is then one lookup a group, and
planes are added up by shifting: no multiplication is done, and the score is exact
(the method of the four Russians).

Anchors are packed into blocks and candidates into chunks, both of a bounded number of
components. Every block meets every part of the chunks as one row group of a shuffle, so
neither side is ever whole in one place; a task holds one block, one chunk and the best
rows so far. A first pass finds positives among the rows of the anchor's label; a second
one finds negatives in the score range of each positive.

A row takes part if its id, label and vector are not null and all components are finite. Scores
must fit a long, so components of LARGEST and more (after scaling) and vectors of more than
LONGEST components take no part either; a shorter vector counts as filled up with zeros.
Order is by score, highest first, then least id. A repeated row is a row of its own: it
can be the positive of its copy, and an anchor that is there twice is mined twice. An anchor
without positives, and a positive without negatives in its range, give no rows. Empty
tables give an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, slices
from thresher.session import parallelism, pinned

SCALE = 256
LARGEST = 1 << 21
LONGEST = 8192
# Components in a block of anchors, in a chunk of candidates, and in the rows whose tables are held at a time.
BLOCK_VALUES, CHUNK_VALUES, TABLED_VALUES = 1 << 21, 1 << 16, 1 << 14
# Fewest chunks that are worth a task.
CHUNKS_PER_PART = 8
# Rows a task gathers before it sorts out the best again.
GATHERED = 500_000
PACKED = "chunk long, rows int, width int, ids binary, labels binary, prints binary, planes binary, values binary"
FOUND = "block long, spot int, anchor long, place int, id long, score long, self boolean"
# Below every score.
NONE = -(1 << 62)


def taking_part(vectors: DataFrame, id_column, label, vector) -> DataFrame:
    """(id, label, vector) of the rows that take part; the vector as doubles."""
    fits = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < LARGEST, F.lit(False)))
    return vectors.select(F.col(id_column).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") <= LONGEST) & fits)


def scaled(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows of whole numbers, zeros behind short ones."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()] * SCALE).astype(np.int64)
    width = int(lengths.max(initial=0))
    width += -width % 8
    rows = np.zeros((len(lengths), width), np.int64)
    rows[np.arange(width) < lengths[:, None]] = values
    return rows


def bit_planes(rows) -> np.ndarray:
    """(planes, groups, rows) of bytes: bit i of a byte is a plane's bit of the group's component i."""
    top = int(np.maximum(rows, ~rows).max(initial=0)).bit_length()
    planes = [np.packbits(((rows >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(top + 1)]
    return np.ascontiguousarray(planes)


def subset_sums(rows) -> np.ndarray:
    """(groups, 256, rows): for each group of eight components, the sums over all its subsets."""
    count, width = rows.shape
    groups = rows.reshape(count, width // 8, 8).transpose(1, 2, 0)
    sums = np.zeros((width // 8, 256, count), rows.dtype)
    for i in range(8):
        np.add(sums[:, :1 << i], groups[:, i:i + 1], out=sums[:, 1 << i:2 << i])
    return sums


def looked_up(planes, sums) -> np.ndarray:
    """(candidates, anchors) of exact inner products; the top plane holds the signs."""
    groups = min(planes.shape[1], sums.shape[0])
    total = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    found, share = np.empty_like(total), np.empty_like(total)
    for p in range(len(planes) - 1, -1, -1):
        share[:] = 0
        for g in range(groups):
            np.take(sums[g], planes[p, g], axis=0, out=found, mode="clip")
            share += found
        if p == len(planes) - 1:
            np.negative(share, out=total)
        else:
            total <<= 1
            total += share
    return total


def packed(rows: DataFrame, limit) -> DataFrame:
    """(id, label, vector) rows packed into rows of at most `limit` components, or one vector."""

    def pack(parts, number):
        ids, labels = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (0, 1))
        values = scaled(pa.concat_arrays([p.column(2) for p in parts]))
        order = np.lexsort((ids, labels))
        ids, labels, values = ids[order], labels[order], values[order]
        prints = np.fromiter((xxhash.xxh3_64_intdigest(np.trim_zeros(v, "b").tobytes()) for v in values), np.uint64, len(values))
        cells = [x.tobytes() for x in (ids, labels, prints, bit_planes(values), values.astype(np.int32))]
        return batch(arrow(PACKED), [number], [len(ids)], [values.shape[1]], *([c] for c in cells))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, most, count = [], 8, 0
        for one in slices(batches, 256):
            if not one.num_rows:
                continue
            wide = max(most, int(np.diff(one.column(2).offsets.to_numpy()).max()))
            if held and (count + one.num_rows) * wide > limit:
                yield pack(held, number)
                held, wide, count, number = [], max(8, int(np.diff(one.column(2).offsets.to_numpy()).max())), 0, number + 1
            rows = max(1, limit // wide)
            while one.num_rows > rows:
                yield pack([one.slice(0, rows)], number)
                one, number = one.slice(rows), number + 1
            held.append(one)
            most, count = wide, count + one.num_rows
        if held:
            yield pack(held, number)

    return rows.select("id", "label", "vector").mapInArrow(run, PACKED)


def unpacked(row):
    """(ids, labels, prints, planes, values) of a packed row."""
    ids, labels, prints = (np.frombuffer(row[k], kind) for k, kind in (("ids", np.int64), ("labels", np.int64), ("prints", np.uint64)))
    planes = np.frombuffer(row["planes"], np.uint8)
    groups = row["width"] // 8
    planes = planes.reshape(-1, groups, len(ids)) if groups else np.zeros((1, 0, len(ids)), np.uint8)
    return ids, labels, prints, planes, np.frombuffer(row["values"], np.int32).reshape(len(ids), -1)


def first_of(rows, limit):
    """The rows (spot, place, id, score, self) that are among the first `limit` of their spot and place."""
    spots, places, ids, scores, _ = rows
    order = np.lexsort((ids, -scores, places, spots))
    spots, places = spots[order], places[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (spots[1:] != spots[:-1]) | (places[1:] != places[:-1])
    ranks = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    kept = order[ranks < limit]
    return [column[kept] for column in rows]


class Gathered:
    """The best rows so far, sorted out whenever many have come together."""

    def __init__(self, limit):
        self.limit, self.parts, self.rows = limit, [], 0

    def add(self, rows):
        self.parts.append(rows)
        self.rows += len(rows[0])
        if self.rows > GATHERED:
            self.parts = [self.best()]
            self.rows = min(self.rows, len(self.parts[0][0])) // 2  # so that a full house is not sorted at every step

    def best(self):
        return first_of([np.concatenate(columns) for columns in zip(*self.parts)], self.limit)


def same_label(anchors, chunk, gathered):
    """Adds the scores of the chunk's rows with the anchors that have their label."""
    a_ids, a_labels, a_prints, _, a_values = anchors
    ids, labels, prints, planes, _ = chunk
    for label in np.intersect1d(a_labels, labels):
        low, high = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
        begin, end = np.searchsorted(a_labels, label), np.searchsorted(a_labels, label, "right")
        for start in range(begin, end, tabled(a_values)):
            some = slice(start, min(start + tabled(a_values), end))
            scores = looked_up(planes[:, :, low:high], subset_sums(a_values[some].astype(number_kind(a_values, planes))))
            spots = np.broadcast_to(np.arange(some.start, some.stop, dtype=np.int32), scores.shape).ravel()
            own = ((ids[low:high, None] == a_ids[some]) & (prints[low:high, None] == a_prints[some])).ravel()
            gathered.add(first_of([spots, np.zeros(len(spots), np.int32), np.repeat(ids[low:high], scores.shape[1]), scores.ravel().astype(np.int64), own], gathered.limit))


def in_range(anchors, chunk, positives, gathered, least_percent):
    """Adds the chunk's rows of other labels whose scores lie in the range of an anchor's positives.

    `positives` is (anchors, places) of scores, with a number below all scores where there is none.
    """
    _, a_labels, _, _, a_values = anchors
    ids, labels, _, planes, _ = chunk
    for start in range(0, len(a_labels), tabled(a_values)):
        some = slice(start, min(start + tabled(a_values), len(a_labels)))
        scores = looked_up(planes, subset_sums(a_values[some].astype(number_kind(a_values, planes)))).astype(np.int64)
        tops = positives[some]
        least = np.where(tops < 0, np.iinfo(np.int64).max, tops).min(axis=1)  # below zero a range is empty
        rows, spots = np.nonzero((scores <= tops.max(axis=1)) & (scores * 100 >= least_percent * np.minimum(least, 1 << 55)) & (labels[:, None] != a_labels[some]))
        found = scores[rows, spots]
        for place in range(tops.shape[1]):
            top = tops[spots, place]
            fit = (top >= 0) & (found <= top) & (found * 100 >= least_percent * top)
            if fit.any():
                n = int(fit.sum())
                gathered.add(first_of([(spots[fit] + start).astype(np.int32), np.full(n, place + 1, np.int32), ids[rows[fit]], found[fit], np.zeros(n, bool)], gathered.limit))


def tabled(values):
    """How many anchors' tables are held at a time."""
    return max(8, TABLED_VALUES // max(values.shape[1], 1))


def number_kind(values, planes):
    """32 bits if no score of the chunk, nor a part of one, can be larger."""
    largest = int(np.abs(values).max(initial=0)) * max(values.shape[1], 1) << len(planes)
    return np.int32 if largest < 1 << 31 else np.int64


def scored(blocks: DataFrame, chunks: DataFrame, limit, least_percent=None) -> DataFrame:
    """The best `limit` rows by block, spot and place of each part of the chunks.

    Without `least_percent`, rows of the anchor's label; with it, rows of other labels in the
    ranges of the block's `tops`: numbers of spot and place, each followed by its score.
    """
    known = [r[0] for r in blocks.select("chunk").collect()]  # a number for each 2 million components of anchors
    wanted = -(-chunks.count() // CHUNKS_PER_PART)
    parts = max(1, min(wanted, -(-2 * parallelism(blocks.sparkSession) // max(len(known), 1))))
    columns = [f.name for f in arrow(PACKED)]

    def run(batches):
        schema = arrow(FOUND)
        block = anchors = tops = None
        gathered = Gathered(limit)

        def best():
            if not gathered.parts:
                return
            rows = gathered.best()
            for start in range(0, len(rows[0]), GATHERED):
                spots, places, ids, scores, own = (c[start:start + GATHERED] for c in rows)
                yield batch(schema, np.full(len(spots), block), spots, anchors[0][spots], places, ids, scores, own)

        for one in batches:
            for i in range(one.num_rows):
                row = {name: one.column(name)[i].as_py() for name in columns}
                if one.column("is_block")[i].as_py():
                    yield from best()
                    block, anchors, gathered = one.column("block")[i].as_py(), unpacked(row), Gathered(limit)
                    if least_percent is not None:
                        known_tops = one.column("tops")[i].values.to_numpy().reshape(-1, 2)
                        tops = np.full(int(known_tops[:, 0].max()) // len(anchors[0]) * len(anchors[0]) + len(anchors[0]), NONE)
                        tops[known_tops[:, 0]] = known_tops[:, 1]
                        tops = tops.reshape(-1, len(anchors[0])).T
                elif least_percent is None:
                    same_label(anchors, unpacked(row), gathered)
                else:
                    in_range(anchors, unpacked(row), tops, gathered, least_percent)
        yield from best()

    every = lambda numbers: F.explode(F.array(*[F.lit(n).cast("long") for n in numbers]) if len(numbers) else F.array().cast("array<bigint>"))
    nothing = F.lit(None).cast("array<bigint>")
    one_side = blocks.select(F.col("chunk").alias("block"), every(range(parts)).alias("part"), F.lit(True).alias("is_block"), *columns,
                             (nothing if least_percent is None else F.col("tops")).alias("tops"))
    other = chunks.select(every(known).alias("block"), F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"), F.lit(False).alias("is_block"), *columns,
                          nothing.alias("tops"))
    dealt = one_side.unionByName(other).repartition("block", "part").sortWithinPartitions("block", "part", F.col("is_block").desc(), "chunk")
    return dealt.mapInArrow(run, FOUND)


def mined(vectors: DataFrame, anchor, id_column="vec_id", label="label", vector="embedding", positives=5, negatives=5, least_percent=80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` is a condition on `id`; `label` may be a column. For each anchor the first
    `positives` other rows of its label are its positives; for each of them the first `negatives`
    rows of other labels follow whose score is at least `least_percent` of the positive's and
    no more than it.
    """
    rows = taking_part(vectors, id_column, label, vector)
    chunks = pinned(packed(rows, CHUNK_VALUES))
    anchors = rows.filter(anchor)
    shares = anchors.agg(F.sum(F.greatest(F.size("vector"), F.lit(8)))).first()[0] or 0
    blocks = pinned(packed(anchors.repartition(max(1, -(-shares // BLOCK_VALUES))), BLOCK_VALUES))
    of = Window.partitionBy("block", "spot")
    found = scored(blocks, chunks, positives + 1).withColumn("at", F.row_number().over(of.orderBy(F.col("score").desc(), "id", F.col("self").desc())))
    # One of the rows that are the anchor itself is left out; its copies stay.
    found = found.filter(F.col("at") <= positives + 1).withColumn("itself", F.min(F.when(F.col("self"), F.col("at"))).over(of))
    others = found.filter(F.col("itself").isNull() | (F.col("at") != F.col("itself")))
    place = (F.col("at") - F.when(F.col("at") > F.col("itself"), 1).otherwise(0)).cast("int")
    best = pinned(others.select("block", "spot", place.alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).filter(F.col("place") <= positives))
    number = ((F.col("place") - 1).cast("long") * F.col("rows") + F.col("spot"))
    tops = best.join(blocks.select(F.col("chunk").alias("of_block"), "rows"), F.col("block") == F.col("of_block")).groupBy("of_block").agg(
        F.flatten(F.collect_list(F.array(number, "positive_score"))).alias("tops"))  # `positives` numbers for each anchor of a block
    ranged = blocks.join(tops, F.col("chunk") == F.col("of_block")).drop("of_block")
    low = scored(ranged, chunks, negatives, least_percent)
    order = Window.partitionBy("block", "spot", "place").orderBy(F.col("score").desc(), "id")
    ranked = low.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = best.select(F.col("block").alias("in_block"), F.col("spot").alias("at_spot"), F.col("place").alias("at_place"), "positive_id", "positive_score")
    met = ranked.join(named, (F.col("block") == F.col("in_block")) & (F.col("spot") == F.col("at_spot")) & (F.col("place") == F.col("at_place")))
    return met.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.r AS a, b.vec_id AS id, b.r AS b, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM parts a, parts b WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, a, id AS positive_id, b AS p, score AS positive_score FROM pairs WHERE same AND a <> b
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY a, p ORDER BY score DESC, id) AS rank
  FROM positives JOIN pairs USING (anchor_id, a)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@query(SQL)
def op11_hard_negatives(spark, sf_dir):
    """Five hard negatives for each of five positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)
