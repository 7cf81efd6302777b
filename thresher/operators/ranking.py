"""Hard-example mining, caps, quotas and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from thresher.fixed_values import SOURCE_QUOTAS
from thresher.functions.hashing import seeded
from thresher.functions.scores import mined_flag
from thresher.operators.ordering import as_list, take_by_hash, top_per_group


def hardest(df: DataFrame, k, score, key, where=None) -> DataFrame:
    """The k highest scores among eligible rows; ties go to the higher key."""
    eligible = df if where is None else df.filter(where)
    return top_per_group(eligible, k, [f"-{score}"] + [f"-{c}" for c in as_list(key)])


def hardest_per_group(df: DataFrame, k, keys, score, key, threshold, split="split", train="train") -> DataFrame:
    """Top k per group of the train split; other splits whole; every row says why it is kept.

    Ties keep key order.
    """
    mined = top_per_group(df.filter(F.col(split) == train), k, [f"-{score}", *as_list(key)], as_list(keys))
    held_out = df.filter(F.col(split) != train)
    return mined.unionByName(held_out).withColumn("selection", mined_flag(score, threshold, split))


def hard_plus_random(df: DataFrame, k, m, score, key, seed) -> DataFrame:
    """The k - m hardest rows and m seeded random ones of the rest, k in all.

    The rest is found by comparing with the last of the hard rows, not by a join.
    """
    if m < 0 or k - m < 1:
        raise ValueError("need at least one hard row")
    keys = as_list(key)
    place = F.struct(-F.col(score), *[F.col(c) for c in keys])
    hard = top_per_group(df, k - m, [f"-{score}", *keys])
    last = hard.agg(F.max(place)).scalar()
    easy = take_by_hash(df.filter(place > last), m, keys, seed)
    chosen = hard.withColumn("part", F.lit("hard")).unionByName(easy.withColumn("part", F.lit("random")))
    available = df.agg(F.count(F.lit(1))).scalar()
    return chosen.withColumn("part", F.when(available < k, F.raise_error(F.lit("fewer rows than requested"))).otherwise(F.col("part")))


def first_per_key(df: DataFrame, keys, order, n=1) -> DataFrame:
    """The first n rows of each key in scan order; n = 1 is exact deduplication."""
    return top_per_group(df, n, order, as_list(keys))


def representative(df: DataFrame, keys, preferences, key) -> DataFrame:
    """One row per key: the first by a list of boolean columns (false wins), then by id."""
    marks = {f"_prefer_{i}": test for i, test in enumerate(preferences)}
    marked = df.withColumns(marks)
    return top_per_group(marked, 1, [*marks, *as_list(key)], as_list(keys)).drop(*marks)


def round_robin(df: DataFrame, category, document, page, cap, quota, seed) -> DataFrame:
    """Page 1 of every document of a category, then page 2, ..., until the quota.

    Documents of a category and pages of a document come in seeded order; a document
    gives at most `cap` pages. Two top-k steps do it: documents need no rank of their
    own because their digest already orders them.
    """
    dealt = df.withColumn("_page_digest", F.sha2(seeded(seed, category, document, page), 256))
    pages = top_per_group(dealt, cap, ["_page_digest", page], [category, document], rank="page_rank").drop("_page_digest")
    shuffled = pages.withColumn("_document_digest", F.sha2(seeded(seed, category, document), 256))
    picked = top_per_group(shuffled, quota, ["page_rank", "_document_digest", document], [category], rank="pick")
    return picked.drop("_document_digest")


def source_quotas(supply: DataFrame, spec, target) -> DataFrame:
    """Rows to take from each source: its share of the target, then top-ups.

    `supply` has (source, available). `spec` lists (source, pool, share, max_rows) in
    order. A pool that stays short of the target is topped up source by source from
    what the sources have left, counting each row once.
    """
    spark = supply.sparkSession
    table = spark.createDataFrame(
        [(i, s, pool, float(share), int(most)) for i, (s, pool, share, most) in enumerate(spec)],
        "position int, source string, pool string, share double, max_rows bigint")
    known = F.broadcast(table).join(supply.withColumnRenamed("source", "_source"), F.col("source") == F.col("_source"), "left")
    available = F.coalesce("available", F.lit(0).cast("bigint"))
    share = F.least("max_rows", F.bround(F.col("share") * F.lit(float(target)), 0).cast("bigint"))
    first = known.select("position", "source", "pool", available.alias("available"), F.least(share, available).alias("first"),
                         F.least("max_rows", available).alias("most"))
    pool = Window.partitionBy("pool")
    earlier = pool.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("most") - F.col("first")
    missing = F.greatest(F.lit(target) - F.sum("first").over(pool), F.lit(0)) - F.coalesce(F.sum(left).over(earlier), F.lit(0))
    return first.withColumn("extra", F.greatest(F.lit(0), F.least(missing, left))).select(
        "position", "source", "pool", "available", "first", "extra", (F.col("first") + F.col("extra")).alias("quota"))


def quota_topup(df: DataFrame, source, order, spec=SOURCE_QUOTAS, target=3000) -> DataFrame:
    """The rows :func:`source_quotas` asks for, in scan order within each source."""
    supply = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("available"))
    quotas = F.broadcast(source_quotas(supply, spec, target).select(  # one row per entry of `spec`
        F.col("source").alias("_source"), "quota", "pool"))
    known = df.join(quotas, F.col(source) == F.col("_source")).drop("_source")
    ranked = top_per_group(known, max(int(most) for _, _, _, most in spec), order, [source], rank="place")
    return ranked.filter(F.col("place") <= F.col("quota")).drop("quota")


def arrival_caps(df: DataFrame, split, order, targets) -> DataFrame:
    """The first rows of each split in arrival order, as many as its target."""
    caps = None
    for name, cap in targets.items():
        caps = F.when(F.col(split) == name, cap) if caps is None else caps.when(F.col(split) == name, cap)
    wanted = df.filter(F.col(split).isin(*targets))
    ranked = top_per_group(wanted, max(targets.values()), order, [split], rank="_place")
    return ranked.filter(F.col("_place") <= caps).drop("_place")


def misses(df: DataFrame, y, score, threshold, columns) -> DataFrame:
    """Positives below the threshold."""
    return df.filter((F.col(y) == 1) & (F.col(score) < threshold)).select(*columns)


def exemplars(df: DataFrame, score, key, columns, n=50) -> DataFrame:
    """One row holding the n highest scores as an array of structs, for reports."""
    best = top_per_group(df, n, [f"-{score}", *as_list(key)])
    place = F.struct((-F.col(score)).alias("_place"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(as_list(key))])
    rows = F.array_sort(F.collect_list(F.struct(place.alias("at"), F.struct(*columns).alias("row"))))
    return best.agg(F.transform(rows, lambda r: r["row"]).alias("examples"))
