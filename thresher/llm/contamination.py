"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of 5-word shingles, each class twice as wide as
the one before. For a class of up to S shingles a document is seen as windows of three
blocks of S / 2, so any run of S shingles lies whole in one window and its Jaccard
similarity with the window is at least a fixed share, however long the document is. Windows
and items that agree in one of the MinHash values meet in a join, and what meets is verified:
the share of the item's distinct shingles found in the whole document.

A window can only agree with an item if it holds one of the item's shingles. So windows
are formed around such shingles alone, told by a bit table of fixed size: its false
positives cost time, and it has no false negatives.

Built of column functions only. Words are runs of letters and digits in lower case. A
text with fewer than five words is one shingle. Null and blank texts, and items without
words, match nothing; repeated documents are found each, repeated item_ids are separate
items; an empty table on either side gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.session import pinned

WORDS = 5
PERCENT = 80
RECALL = 0.9999
SMALLEST_CLASS = 1
# Bits of the table that tells shingles of items, in words of 64.
BITS = 1 << 20
MASK = BITS // 64 - 1


def permutations(percent=PERCENT, recall=RECALL):
    """How many MinHash values find an item with the given chance.

    An item has more than S / 2 shingles and its window at most 3 S / 2, so at full
    containment their similarity is 1/3; at `percent` it is `share` below.
    """
    share = percent / 100 / (3 + 1 - percent / 100)
    return math.ceil(math.log(1 - recall) / math.log(1 - share))


def shingle_hashes(text, words=WORDS):
    """(words, shingles) as two steps; see :func:`with_shingles`."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_shingles(rows: DataFrame, words=WORDS) -> DataFrame:
    """Replaces `text` by `shingles`, the hash of each run of words in order."""
    split = rows.withColumn("ws", shingle_hashes(F.col("text"))).drop("text")
    at = lambda i, k: F.get("ws", i + k)
    runs = F.transform(F.sequence(F.lit(0), F.size("ws") - words), lambda i: F.xxhash64(*[at(i, k) for k in range(words)]))
    whole = F.array(F.xxhash64(F.array_join("ws", " ")))
    none = F.array().cast("array<bigint>")
    return split.withColumn("shingles", F.when(F.size("ws") >= words, runs).when(F.size("ws") > 0, whole).otherwise(none)).drop("ws")


def probes(h):
    """The two places of a hash in the bit table, as (word, bit)."""
    other = F.shiftrightunsigned(h, 32)
    return [(F.shiftright(x, 6).bitwiseAND(MASK).cast("int"), x.bitwiseAND(63).cast("int")) for x in (h, other)]


def bit_table(items: DataFrame):
    """The words of the bit table of all shingles of the items, as one row; its size is fixed."""
    spark = items.sparkSession
    hashes = items.select(F.explode("shingles").alias("h"))
    (a, i), (b, j) = probes(F.col("h"))
    spots = hashes.select(F.explode(F.array(F.struct(a.alias("w"), i.alias("b")), F.struct(b.alias("w"), j.alias("b")))).alias("s"))
    filled = spots.groupBy(F.col("s.w").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, s.b)")).alias("bits"))
    every = spark.range(MASK + 1).join(filled, F.col("id") == F.col("w"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("table"))


def size_class(size):
    """The least class of at least `size` shingles: SMALLEST_CLASS times a power of two."""
    return (SMALLEST_CLASS * F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(size / SMALLEST_CLASS))))).cast("int")


def signature(shingles, count):
    """MinHash values of an array of hashes, one per seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))


def prepared_items(items: DataFrame) -> DataFrame:
    """(item, item_id, shingles, size, class); `item` names the row."""
    rows = with_shingles(items.select("item_id", "text")).withColumn("shingles", F.array_distinct("shingles"))
    rows = rows.withColumn("size", F.size("shingles").cast("long")).withColumn("class", size_class(F.greatest("size", F.lit(1))))
    return pinned(rows.withColumn("item", F.monotonically_increasing_id())).filter("size > 0")


def windows_near(documents: DataFrame, items: DataFrame, classes) -> DataFrame:
    """For each document (doc_id, hits, windows); both are empty for most.

    `windows` are (class, shingles) around the hits, `hits` the distinct hashes that the bit table knows.
    """
    def known(h):
        (a, i), (b, j) = probes(h)
        return (F.getbit(F.get("bits", a), i) == 1) & (F.getbit(F.get("bits", b), j) == 1)

    rows = with_shingles(documents.select("doc_id", "text"))
    # No filter stands between these steps: Spark would push it down and repeat the steps inside it.
    spots = F.when(F.size("shingles") > 0, F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: known(F.get("shingles", i))))
    rows = rows.withColumn("bits", bit_table(items).scalar()).withColumn("spots", F.coalesce(spots, F.array().cast("array<int>")))

    def around(size):
        block = max(1, size // 2)
        firsts = F.array_distinct(F.flatten(F.transform("spots", lambda p: F.sequence(
            F.greatest(F.lit(0), F.floor(p / block).cast("int") - 2), F.floor(p / block).cast("int")))))
        return F.transform(firsts, lambda f: F.struct(F.lit(size).alias("class"), F.slice("shingles", f * block + 1, 3 * block).alias("shingles")))

    return rows.select(
        "doc_id", F.array_distinct(F.transform("spots", lambda p: F.get("shingles", p))).alias("hits"),
        F.concat(*[around(c) for c in classes]).alias("windows"))


def contained(documents: DataFrame, items: DataFrame, percent=PERCENT, recall=RECALL) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, found, size (shingles of the item), row.

    `row` tells repeated doc_ids apart. Hits and signatures are written once and read by
    both the search and the verification.
    """
    items = prepared_items(items)
    classes = sorted(r[0] for r in items.select("class").distinct().collect())  # one per doubling of item sizes
    if not classes:
        return documents.select("doc_id", F.lit("").alias("item_id"), F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("size"),
                                F.lit(0).cast("long").alias("row")).limit(0).withColumn("item_id", F.lit(None).cast(items.schema["item_id"].dataType))
    count = permutations(percent, recall)
    near = windows_near(documents, items, classes)
    signed = near.select("doc_id", "hits", F.transform("windows", lambda w: F.struct(
        w["class"].alias("class"), signature(w["shingles"], count).alias("values"))).alias("windows"))
    near = pinned(signed.withColumn("row", F.monotonically_increasing_id()))
    keys = near.select("row", F.explode("windows").alias("w")).select("row", F.col("w.class").alias("class"), F.posexplode("w.values").alias("k", "value")).distinct()
    wanted = items.select("item", F.col("class").alias("item_class"), F.posexplode(signature(F.col("shingles"), count)).alias("item_k", "item_value"))
    meet = (F.col("class") == F.col("item_class")) & (F.col("k") == F.col("item_k")) & (F.col("value") == F.col("item_value"))
    pairs = keys.join(wanted, meet).select("row", "item").distinct()
    texts = near.filter(F.size("hits") > 0).select(F.col("row").alias("of_row"), "doc_id", "hits")
    sets = items.select(F.col("item").alias("of_item"), "item_id", "shingles", "size")
    found = pairs.join(texts, F.col("row") == F.col("of_row")).join(sets, F.col("item") == F.col("of_item")).withColumn(
        "found", F.size(F.array_intersect("hits", "shingles")).cast("long"))
    return found.filter(F.col("found") * 100 >= F.col("size") * percent).select("doc_id", "item_id", "found", "size", "row")


def clean_documents(documents: DataFrame, items: DataFrame, percent=PERCENT) -> DataFrame:
    """The documents that hold no item; documents that share a doc_id with one that does go with it.

    The list of these is written first: while it is small, Spark knows that no text needs to move.
    """
    bad = pinned(contained(documents, items, percent).select(F.col("doc_id").alias("_contaminated")).distinct())
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("_contaminated")), "left_anti")


SQL = """
WITH words AS (
  SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' '))
    WHEN len(ws) > 0 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT id AS item_id, count(*) AS size FROM shingles WHERE kind = 'b' GROUP BY id),
found AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS found
  FROM shingles d JOIN shingles b ON d.kind = 'd' AND b.kind = 'b' AND d.s = b.s GROUP BY d.id, b.id)
SELECT doc_id, item_id, found, size FROM found JOIN sizes USING (item_id) WHERE 100 * found >= 80 * size
"""


@query(SQL)
def op8_contained_items(spark, sf_dir):
    """Every document and the benchmark items it holds."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "found", "size")
