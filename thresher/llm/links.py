"""Links between similar sets, and their components, without comparing all pairs of a group.

Postings say under which keys a set can be found. Sets under one key are sorted by size
and, among equals, by a digest that differs from key to key, and each is first compared with the
one before it only. So a group of n near copies costs n comparisons per key, and each member
meets others under other keys. The components of the links found then tell which sets
of a key are still apart; of those, and only of those, every pair that sizes and sketches
do not rule out is compared. So no link between different components is lost, and none
inside a component is needed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from thresher.llm.texts import arrow, batch
from thresher.session import pinned

# Sets that meet one set in one task; a set with more partners is sent to several tasks.
PARTNERS = 500
RUNS = "key long, item long, size long, before long"
# A set of up to CHAIN_SIZE elements uses all its keys for the first comparisons; larger ones use about as many, whatever their size.
CHAIN_SIZE = 80
# Pairs a task holds before it passes them on.
HELD_PAIRS = 50_000
# Rows of a key that one task compares with each other, or with as many others.
BLOCK_ROWS = 4_096
FOUND = "a long, b long"
COUNTED = "a long, b long, need long, n long"


def lowest(shared, of, percent):
    """Whether 100 * shared >= percent * of, for columns or numbers."""
    return shared * 100 >= of * percent


def star(edges: DataFrame, large) -> DataFrame:
    """One star step: hangs neighbours of each item on the least of them.

    `edges` have a > b. The large step looks at all neighbours and hangs the greater ones,
    the small step looks at the lesser ones and hangs them and the item. Rows stream
    through sorted by item and neighbour, so the least one is the first.
    """

    def run(batches):
        schema = arrow(FOUND)
        last, least = None, None
        for one in batches:
            u, v = one.column(0).to_numpy(), one.column(1).to_numpy()
            if not len(u):
                continue
            begins = np.ones(len(u), bool)
            begins[1:] = u[1:] != u[:-1]
            begins[0] = last is None or u[0] != last
            firsts = v.copy()
            if not begins[0]:
                firsts[0] = least
            spots = np.maximum.accumulate(np.where(begins, np.arange(len(u)), 0))
            m = firsts[spots]
            last, least = u[-1], m[-1]
            hung = np.minimum(u, m) if large else m
            keep = (v > u) if large else (v != m)
            a, b = v[keep], hung[keep]
            if not large:
                a, b = np.concatenate([a, u[begins]]), np.concatenate([b, m[begins]])
            found = np.unique(np.column_stack([a, b]), axis=0)
            yield batch(schema, np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1]))

    rows = edges.select("a", "b")
    if large:
        rows = rows.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    return rows.repartition("a").sortWithinPartitions("a", "b").mapInArrow(run, FOUND)


def components(edges: DataFrame) -> DataFrame:
    """(item, component) for every item of the edges (a, b); a component is its least item.

    Large and small star steps take turns until the edges stay as they are. Every turn
    is written, so a lost executor repeats one turn at most.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = None
    while True:
        edges = pinned(star(star(edges, True), False).distinct())
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            break
        state = now
    return edges.select(F.explode(F.array("a", "b")).alias("item"), F.col("b").alias("component")).distinct()


def runs_of(postings: DataFrame, percent, copies=False) -> DataFrame:
    """Postings of the keys that more than one item has, each with the item before it.

    Items none of whose neighbours in size can be linked to them are left out; `before` is
    the item itself where only the next one can. With `copies`, items that a key has more
    than once stay too. Rows stream through sorted by key;
    a row or two are held at a time.
    """

    def run(batches):
        schema = arrow(RUNS)
        key = last = waiting = held = None
        last_size = 0

        def walk(rows, keep):
            nonlocal key, last, last_size, waiting
            out = []
            for i in keep:
                k, size, item = rows[0][i], rows[1][i], rows[2][i]
                if k == key and item == last:
                    if copies and waiting:
                        out.append(waiting)
                        waiting = None
                    continue
                if k == key and lowest(last_size, size, percent):
                    if waiting:
                        out.append(waiting)
                        waiting = None
                    out.append((k, item, size, last))
                else:  # a row that waits is dropped: nothing of its size is near
                    waiting = k, item, size, item
                key, last, last_size = k, item, size
            return out

        for one in batches:
            columns = [one.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            if not len(columns[0]):
                continue
            held = [c[-1:] for c in columns]
            rows = [c[:-1] for c in columns]
            follows = columns[0][:-1] == columns[0][1:]
            same = follows.copy()
            same[1:] |= follows[:-1]
            if len(same) and key is not None:
                same[0] |= bool(rows[0][0] == key)
            keep = np.flatnonzero(same)
            out = walk([c[keep].tolist() for c in rows], range(len(keep)))
            yield batch(schema, *(zip(*out) if out else [[]] * 4))
        if held is not None:
            out = walk([c.tolist() for c in held], [0])
            yield batch(schema, *(zip(*out) if out else [[]] * 4))

    ordered = postings.select("key", "size", "item").repartition("key").sortWithinPartitions("key", "size", F.xxhash64("item", "key"), "item")
    return ordered.mapInArrow(run, RUNS)


def compared(pairs: DataFrame, sets: DataFrame, percent) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union.

    `sets` holds each item's sorted hashes as binary. The set of `a` comes first in its
    slice and the partners stream past it; long lists are probed by binary search. A set
    with many partners is sent to as many slices as PARTNERS asks for.
    """

    def run(batches):
        schema = arrow(FOUND)
        held, values = None, None
        for one in batches:
            a, part, b = (one.column(i).to_pylist() for i in range(3))
            found = []
            for i in range(one.num_rows):
                other = np.frombuffer(one.column(3)[i].as_buffer(), np.uint64)
                if b[i] is None:
                    held, values = (a[i], part[i]), other.copy()
                    continue
                if held != (a[i], part[i]):
                    raise ValueError("a set is missing")
                few, many = (other, values) if len(other) < len(values) else (values, other)
                spots = np.searchsorted(many, few)
                shared = int((many[np.minimum(spots, len(many) - 1)] == few).sum()) if len(few) else 0
                if shared and lowest(shared, len(few) + len(many) - shared, percent):
                    found.append((a[i], b[i]))
            yield batch(schema, *(zip(*found) if found else [[]] * 2))

    held = sets.select(F.col("item").alias("of"), "hashes")
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("long").alias("parts"))
    first = counts.join(held, F.col("a") == F.col("of")).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "hashes")
    spread = pairs.join(counts.withColumnRenamed("a", "of_a"), F.col("a") == F.col("of_a"))
    partners = spread.join(held, F.col("b") == F.col("of")).select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b", "hashes")
    ordered = first.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(run, FOUND)


def sketch(hashes, bits):
    """The parity of the number of elements in each of `bits` cells.

    Sketches of two sets differ in no more bits than the sets do in elements.
    """
    return np.packbits(np.bincount(hashes.astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketched(column):
    """Sketches of an Arrow column as rows of bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def may_link(differ, sizes, percent):
    """Whether sets whose sketches differ in so many bits can have the similarity; `sizes` is the sum of theirs."""
    return differ * (100 + percent) <= (100 - percent) * sizes


def alike(pairs: DataFrame, sketches: DataFrame, percent) -> DataFrame:
    """The pairs (a, b) that their sketches (item, size, sketch) do not rule out."""

    def run(batches):
        for one in batches:
            differ = np.bitwise_count(sketched(one.column(2)) ^ sketched(one.column(3))).sum(axis=1, dtype=np.int64) if one.num_rows else np.empty(0)
            yield one.filter(pa.array(may_link(differ, one.column(4).to_numpy(), percent))).select([0, 1])

    side = lambda end: sketches.select(F.col("item").alias(f"of_{end}"), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}"))
    both = pairs.join(side("a"), F.col("a") == F.col("of_a")).join(side("b"), F.col("b") == F.col("of_b"))
    return both.select("a", "b", "sketch_a", "sketch_b", (F.col("size_a") + F.col("size_b")).alias("sizes")).mapInArrow(run, FOUND)


def in_blocks(placed: DataFrame) -> DataFrame:
    """Rows (key, rows, size, item, component, sketch) dealt to pairs of blocks of a key: adds i, j and second.

    Most keys are one block, paired with itself. Those of more than BLOCK_ROWS rows are cut by size into
    blocks, and each pair of blocks is a group of its own, so no task compares all of a key.
    """
    small = placed.filter(F.col("rows") <= BLOCK_ROWS).drop("rows").withColumns({"i": F.lit(0), "j": F.lit(0), "second": F.lit(False)})
    place = F.row_number().over(Window.partitionBy("key").orderBy("size", "item")) - 1
    large = placed.filter(F.col("rows") > BLOCK_ROWS).withColumn("block", F.floor(place / BLOCK_ROWS).cast("int")).withColumn(
        "last", F.floor((F.col("rows") - 1) / BLOCK_ROWS).cast("int")).drop("rows")
    other = lambda low, high: F.transform(F.sequence(low, high), lambda b: F.struct(
        F.least("block", b).alias("i"), F.greatest("block", b).alias("j"), (b < F.col("block")).alias("second")))
    pairs = large.withColumn("pair", F.explode(other(F.lit(0), F.col("last")))).select(*[c for c in large.columns if c not in ("block", "last")], "pair.*")
    return small.unionByName(pairs)


def apart(placed: DataFrame, percent, least) -> DataFrame:
    """The pairs of different components that meet under keys often enough and that sizes and sketches do not rule out.

    `placed` is (key, rows, size, item, component, sketch); `least` makes of an array of sizes how
    often a set of that size meets each partner at least. Rows stream through sorted by key and size;
    of a key, only the rows not yet too small for the next one are held, and pairs are counted where they
    are made.
    """

    def run(batches):
        schema = arrow(COUNTED)
        last, window = None, None
        for one in batches:
            keys = np.column_stack([one.column(i).to_numpy() for i in (0, 1, 2)])
            columns = [one.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)] + [sketched(one.column(7)) if one.num_rows else np.empty((0, 1), np.uint8)]
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]])
            found = Counter()
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if start == end:
                    continue
                rows, before, key = [c[start:end] for c in columns], 0, tuple(keys[start].tolist())
                if key == last:
                    before = len(window[0])
                    rows = [np.concatenate([w, r]) for w, r in zip(window, rows)]
                second, sizes, items, kinds, prints = rows
                needs = least(sizes)
                lows = np.searchsorted(sizes, (sizes * percent + 99) // 100)
                ends = np.arange(len(sizes)) if key[1] == key[2] else np.where(second, np.argmax(second) if second.any() else len(sizes), 0)
                for k in range(before, len(sizes)):
                    other = np.flatnonzero(kinds[lows[k]:ends[k]] != kinds[k]) + lows[k]
                    if len(other):
                        differ = np.bitwise_count(prints[other] ^ prints[k]).sum(axis=1, dtype=np.int64)
                        other = other[may_link(differ, sizes[other] + sizes[k], percent)]
                        found.update((int(items[k]), int(items[m]), int(min(needs[k], needs[m]))) for m in other)
                        if len(found) > HELD_PAIRS:
                            yield batch(schema, *zip(*[(*pair, n) for pair, n in found.items()]))
                            found = Counter()
                # Rows of the second block meet all of the first, and those of a block the ones before them.
                last, window = key, [r[lows[-1]:] for r in rows] if key[1] == key[2] else [r[~second] for r in rows]
            yield batch(schema, *(zip(*[(*pair, n) for pair, n in found.items()]) if found else [[]] * 4))

    dealt = in_blocks(placed).select("key", "i", "j", "second", "size", "item", "component", "sketch")
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second", "size", "item")
    return ordered.mapInArrow(run, COUNTED).groupBy("a", "b", "need").agg(F.sum("n").alias("n")).filter("n >= need").select("a", "b")


def once(sizes):
    return np.ones(len(sizes), np.int64)


def linked(runs: DataFrame, sketches: DataFrame, compare, percent, least=once) -> DataFrame:
    """(item, component) of all items that have a link.

    `runs` is what :func:`runs_of` gives, written; `sketches` is (item, size, sketch) of its
    items; `compare` takes pairs (a, b) and gives those that are similar; `least` tells how many keys
    a set of a size has in common with any set it is linked with.
    """
    some = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.floor(2 * (F.col("size") - CHAIN_SIZE) / CHAIN_SIZE))) == 0
    chain = runs.filter(F.col("item") != F.col("before")).filter(some).select(
        F.least("item", "before").alias("a"), F.greatest("item", "before").alias("b")).distinct()
    seen = pinned(alike(chain, sketches, percent))
    found = components(pinned(compare(seen)))
    placed = pinned(runs.join(found.withColumnRenamed("item", "of"), F.col("item") == F.col("of"), "left").select(
        "key", "item", "size", F.coalesce("component", "item").alias("component")))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low <> high").select(
        F.col("key").alias("split_key"), "rows")
    rest = placed.join(split, F.col("key") == F.col("split_key"))
    rest = rest.join(sketches.select(F.col("item").alias("of"), "sketch"), F.col("item") == F.col("of")).select("key", "rows", "size", "item", "component", "sketch")
    rest = apart(rest, percent, least)
    seen = seen.select(F.col("a").alias("seen_a"), F.col("b").alias("seen_b"))
    seen = seen.union(seen.select("seen_b", "seen_a"))
    rest = pinned(rest.join(seen, (F.col("a") == F.col("seen_a")) & (F.col("b") == F.col("seen_b")), "left_anti"))
    if rest.isEmpty():
        return found
    more = pinned(compare(rest))
    if more.isEmpty():
        return found
    return components(found.select(F.col("item").alias("a"), F.col("component").alias("b")).union(more))


# Bits of a table of wanted rows that is sent to every task.
BITS = 1 << 23
BITS_PER_CHUNK = 1 << 15


def bit_table(hashes):
    """A table of BITS bits, packed, in which the bits of a one-column DataFrame of longs are set."""

    def run(batches):
        totals = {}
        for one in batches:
            spots = one.column(0).to_numpy()
            for chunk in np.unique(spots // BITS_PER_CHUNK).tolist():
                bits = totals.setdefault(chunk, np.zeros(BITS_PER_CHUNK, bool))
                bits[spots[spots // BITS_PER_CHUNK == chunk] % BITS_PER_CHUNK] = True
        yield batch(arrow("chunk int, bits binary"), list(totals), [np.packbits(b).tobytes() for b in totals.values()])

    spots = hashes.toDF("hash").select(F.pmod("hash", F.lit(BITS)).cast("long").alias("spot")).distinct()
    dealt = spots.repartition((F.col("spot") / BITS_PER_CHUNK).cast("int"))
    table = np.zeros((BITS // BITS_PER_CHUNK, BITS_PER_CHUNK // 8), np.uint8)
    for row in dealt.mapInArrow(run, "chunk int, bits binary").collect():  # BITS / 8 bytes in all
        table[row["chunk"]] |= np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def told(table, hashes):
    """Which of an array of longs may be in a bit table."""
    spots = np.mod(hashes, BITS)
    return (table[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1 == 1
