"""What has been taken in before, stored so that a run reads only what its rows may hit.

Keys (digests, shard names) lie sorted by BUCKETS buckets of their hash. Beside them every delivery
has filter pages: a page is a bitmap of PAGE_BITS bits for about KEYS_PER_PAGE keys, in which
each key sets HASHES bits. A batch looks at the pages first, a fiftieth of the keys in size; only
buckets in which a page tells that a key may be known are read (statistics of files and row
groups let the others be passed over), and the keys found there decide. Filters never miss a
known key, so the result is exact.

The state of a history is one small file: the deliveries that count, running totals, and the last batch
of each stream. States are numbered and put in place as in :mod:`thresher.sources.versions`, so a
delivery that failed half-way is never seen and two writers cannot undo each other. When
more than MOST_FOLDERS deliveries have come together they are merged into one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.operators.lineage import exclude_content
from thresher.session import pinned
from thresher.sources.versions import DIGITS, Files, commit_folder, versions

BUCKETS = 256
PAGE_BITS = 32_768  # of the bitmap functions
KEYS_PER_PAGE = 3_000
HASHES = 4
MOST_FOLDERS = 16
ROW_GROUP_BYTES = 4 << 20
# Versions of the state that stay for readers that hold one.
STATES_KEPT = 4


class Late(ValueError):
    """Another writer has committed since the state was read."""


def read_state(spark: SparkSession, root) -> tuple[int, dict]:
    """The number of the newest state (0: none) and its content."""
    number = (versions(spark, root) or [0])[-1]
    if not number:
        return 0, {"folders": [], "totals": {}, "batches": {}}
    return number, json.loads(Files(spark, root).read(f"{commit_folder(root)}/{number:0{DIGITS}d}"))


def commit_state(spark: SparkSession, root, after, state) -> int:
    """Makes `state` the one that follows state `after`; :class:`Late` if there is such a one."""
    files, draft = Files(spark, root), f"{commit_folder(root)}/_draft-{uuid.uuid4().hex}"
    files.write(draft, json.dumps(state))
    if not files.claim(draft, f"{commit_folder(root)}/{after + 1:0{DIGITS}d}"):
        files.remove(draft)
        raise Late(f"state {after + 1} of {root} is there already")
    for old in versions(spark, root)[:-STATES_KEPT]:
        files.remove(f"{commit_folder(root)}/{old:0{DIGITS}d}")
    return after + 1


def bucket_of(key):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def bits_of(key):
    """The bits of a page that a key sets."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i + 2)), F.lit(PAGE_BITS)).cast("int") for i in range(HASHES)])


def page_of(key, pages):
    return F.pmod(F.xxhash64(key, F.lit(1)), pages).cast("long")


def all_keys(spark, root):
    return spark.read.schema("key string, bucket int, folder string").parquet(f"{root}/keys")


def write_keys(keys: DataFrame, root) -> str:
    """Writes distinct keys and their pages as a new delivery, not yet committed; returns its name."""
    spark, folder = keys.sparkSession, uuid.uuid4().hex
    named = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).filter("key is not null").distinct()
    # Spark makes as many files as the bytes ask for.
    sorted_out = lambda df, *order: df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP_BYTES)
    sorted_out(named.withColumn("bucket", bucket_of(F.col("key"))), "bucket", "key").parquet(f"{root}/keys/folder={folder}")
    known = spark.read.schema("key string, bucket int").parquet(f"{root}/keys/folder={folder}")
    sizes = known.groupBy(F.col("bucket").alias("of")).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / KEYS_PER_PAGE)).cast("long").alias("pages"))
    paged = known.join(F.broadcast(sizes), F.col("bucket") == F.col("of"))  # BUCKETS rows
    bits = paged.select("bucket", "pages", page_of(F.col("key"), F.col("pages")).alias("page"), F.explode(bits_of(F.col("key"))).alias("bit"))
    sorted_out(bits.groupBy("bucket", "pages", "page").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "bucket", "page").parquet(f"{root}/pages/folder={folder}")
    return folder


def maybe_known(keys: DataFrame, root, folders) -> DataFrame:
    """(key, folder, bucket) of the distinct `keys` that a page of a delivery does not rule out."""
    spark = keys.sparkSession
    pages = spark.read.schema("bucket int, pages long, page long, bitmap binary, folder string").parquet(f"{root}/pages").filter(F.col("folder").isin(folders))
    counts = F.broadcast(pages.select(F.col("folder").alias("in_folder"), F.col("bucket").alias("of"), F.col("pages").alias("in_all")).distinct())  # MOST_FOLDERS x BUCKETS rows
    looked = keys.join(counts, F.col("bucket") == F.col("of")).withColumn("at", page_of(F.col("key"), F.col("in_all")))
    met = looked.join(pages.select("folder", F.col("bucket").alias("page_bucket"), "page", "bitmap"),
                      (F.col("in_folder") == F.col("folder")) & (F.col("bucket") == F.col("page_bucket")) & (F.col("at") == F.col("page")))
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda bit: F.call_function("shiftright", byte(bit), bit % 8) % 2 == 1
    return met.filter(F.forall(bits_of(F.col("key")), is_set)).select("key", "folder", "bucket")


def known_keys(keys: DataFrame, root, folders) -> DataFrame:
    """The distinct `keys` (key, bucket) that deliveries hold. Only buckets that may hold one are read."""
    spark = keys.sparkSession
    if not folders:
        return keys.select("key").limit(0)
    maybe = pinned(maybe_known(keys, root, folders))
    hit = maybe.select("folder", "bucket").distinct().collect()  # MOST_FOLDERS x BUCKETS rows at most
    if not hit:
        return keys.select("key").limit(0)
    stored = all_keys(spark, root).filter(F.col("folder").isin(sorted({r["folder"] for r in hit})) & F.col("bucket").isin(sorted({r["bucket"] for r in hit})))
    return stored.join(maybe.select(F.col("key").alias("wanted"), F.col("bucket").alias("in_bucket")).distinct(),
                       (F.col("key") == F.col("wanted")) & (F.col("bucket") == F.col("in_bucket"))).select("key").distinct()


def unseen(df: DataFrame, root, key, state=None) -> DataFrame:
    """The rows of `df` whose key no delivery holds; rows without a key stay. A key may have very many rows."""
    root = root.rstrip("/")
    folders = (state or read_state(df.sparkSession, root)[1])["folders"]
    text = F.col(key).cast("string")
    asked = df.select(text.alias("key")).filter("key is not null").distinct().withColumn("bucket", bucket_of(F.col("key")))
    return exclude_content(df, known_keys(asked, root, folders).withColumnRenamed("key", key).withColumn(key, F.col(key).cast(df.schema[key].dataType)), key)


def merged_folders(spark, root, folders) -> list:
    """The deliveries that stand for `folders`: one that holds the keys of all when there are too many."""
    if len(folders) <= MOST_FOLDERS:
        return folders
    return [write_keys(all_keys(spark, root).filter(F.col("folder").isin(folders)).select("key"), root)]


def remember(df: DataFrame, root, key) -> int:
    """Adds the keys of `df` to a history and returns the number of its new state."""
    spark, root = df.sparkSession, root.rstrip("/")
    folder = write_keys(df.select(key), root)
    while True:
        number, state = read_state(spark, root)
        try:
            return commit_state(spark, root, number, {**state, "folders": merged_folders(spark, root, [*state["folders"], folder])})
        except Late:
            continue
