"""Splits, samples, thinning, oversampling and pair plans, all decided by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.fixed_values import SPLITS
from thresher.functions.hashing import hash_number, seeded
from thresher.functions.labels import root_or_self
from thresher.operators.ordering import (
    HOT_SHARE, as_list, attach, dense_index, guard, prefix_sums, take_by_hash, with_digest,
)
from thresher.session import pinned


def stratified_group_split(df: DataFrame, group, label, seed, fractions=(0.8, 0.1, 0.1), names=SPLITS) -> DataFrame:
    """Adds `split`: whole groups go to one split, labels keep their shares.

    A group belongs to the stratum of its majority label (ties: the lowest). Groups of
    a stratum come in seeded digest order, and running row totals cut the order.
    """
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_c"))
    groups = counts.groupBy(group).agg(
        F.sum("_c").alias("_rows"), F.min(F.struct(-F.col("_c"), F.col(label).alias("label"))).getField("label").alias("_stratum"))
    hashed = with_digest(groups, group, seed)
    placed = prefix_sums(hashed, "_rows", ["_digest", group], "_prefix", ["_stratum"])
    share = F.col("_rows_upto").cast("double") / F.col("_rows_total")
    split, edge = None, 0.0
    for name, fraction in zip(names[:-1], fractions[:-1]):
        edge = round(edge + fraction, 12)
        split = F.when(share <= edge, name) if split is None else split.when(share <= edge, name)
    decided = placed.select(group, "_rows", split.otherwise(names[-1]).alias("split"))
    return attach(df, decided, group, "_rows", ["split"])


def least_costly(allocated, counts, targets):
    """The split in which a group's class counts bring squared deviations, relative to the classes, down most; ties to the first."""
    best, place = None, 0
    for j, (have, wanted) in enumerate(zip(allocated, targets)):
        cost = 0.0
        for label, (total, target) in wanted.items():
            off = have[label] - target
            with_it = off + counts.get(label, 0)
            cost += (with_it * with_it - off * off) / (float(total) * float(total))
        if best is None or cost < best:
            best, place = cost, j
    return place


def balanced_group_split(df: DataFrame, group, label, seed, fractions=(0.8, 0.1, 0.1), names=SPLITS, large_share=HOT_SHARE) -> DataFrame:
    """Adds `split`: whole groups go to one split, and large groups do not upset the shares of the labels.

    A group with at least a `large_share`-th of all rows is large; there are `large_share` of them
    at most. They are placed first, largest first (ties in seeded digest order), each where
    the class shares of all splits come closest to their targets. The other groups are cut in digest
    order as in :func:`stratified_group_split`, but so that each label gets what it still lacks in
    a split. A null label is a class of its own; a row without a group gets no split.
    """
    spark = df.sparkSession
    counts = pinned(df.filter(F.col(group).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("_c")))
    totals = {r[0]: r[1] for r in counts.groupBy(label).agg(F.sum("_c")).orderBy(label).collect()}  # one row per class
    groups = with_digest(counts.groupBy(group).agg(
        F.sum("_c").alias("_rows"), F.min(F.struct(-F.col("_c"), F.col(label).alias("label"))).getField("label").alias("_stratum")), group, seed)
    is_large = F.col("_rows") * large_share >= sum(totals.values())
    large = groups.filter(is_large).select(F.col(group).alias("_large"), "_rows", "_digest")
    rows = counts.join(F.broadcast(large), F.col(group) == F.col("_large")).select(group, label, "_c", "_rows", "_digest").collect()  # large_share x classes at most
    classes, order = {}, {}
    for name, kind, c, size, digest in rows:
        classes.setdefault(name, {})[kind] = c
        order[name] = (-size, digest, name)
    targets = [{k: (n, f * n) for k, n in totals.items()} for f in fractions]
    allocated, placed = [dict.fromkeys(totals, 0) for _ in names], []
    for name in sorted(order, key=order.get):
        j = least_costly(allocated, classes[name], targets)
        placed.append((name, -order[name][0], names[j]))
        for kind, c in classes[name].items():
            allocated[j][kind] += c
    ranked = prefix_sums(groups.filter(~is_large), "_rows", ["_digest", group], "_prefix", ["_stratum"])
    share = F.col("_rows_upto").cast("double") / F.col("_rows_total")
    split = F.lit(names[-1])
    for kind in totals:
        lacking = [max(0.0, target[kind][1] - have[kind]) for target, have in zip(targets, allocated)]
        lacking = lacking if sum(lacking) else list(fractions)
        cut = F.lit(names[-1])
        for j in range(len(names) - 2, -1, -1):
            cut = F.when(share <= sum(lacking[:j + 1]) / sum(lacking), names[j]).otherwise(cut)
        split = F.when(F.col("_stratum").eqNullSafe(F.lit(kind)), cut).otherwise(split)
    decided = ranked.select(group, "_rows", split.alias("split")).unionByName(
        spark.createDataFrame(placed, f"`{group}` {df.schema[group].dataType.simpleString()}, _rows bigint, split string"))
    return attach(df, decided, group, "_rows", ["split"])


def assert_no_leaks(df: DataFrame, group, split="split") -> DataFrame:
    """`df`, failing if a group stands in more than one split; apply it to the final table, forced rows included."""
    apart = df.groupBy(group).agg(F.min(split).alias("_low"), F.max(split).alias("_high")).agg(F.count_if(F.col("_low") != F.col("_high")).alias("leaks"))
    return guard(df, apart, "a group stands in more than one split")


def force_splits(df: DataFrame, forced: DataFrame, split="split", names=SPLITS) -> DataFrame:
    """Appends rows whose split is given; an unknown split name fails the query."""
    checked = F.when(F.col(split).isin(*names), F.col(split)).otherwise(
        F.raise_error(F.concat(F.lit("invalid forced split "), F.coalesce(F.col(split), F.lit("null")))))
    return df.unionByName(forced.withColumn(split, checked), allowMissingColumns=True)


def thin_by_source(df: DataFrame, source, fraction, key, seed, where=None) -> DataFrame:
    """Keeps max(1, round(n * fraction)) rows of each thinned source, half to even.

    Sources outside `where` are kept whole.
    """
    if not 0.0 < fraction <= 1.0:
        raise ValueError("the fraction must be in (0, 1]")
    thinned = df if where is None else df.filter(where)
    quota = lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction)), 0))
    kept = take_by_hash(thinned, quota, key, seed, [source])
    return kept if where is None else kept.unionByName(df.filter(~where))


def oversample(df: DataFrame, where, repeat) -> DataFrame:
    """Each row that meets the condition appears `repeat` times."""
    if repeat < 1:
        raise ValueError("repeat must be at least 1")
    times = F.when(where, repeat).otherwise(1)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


def seeded_sample(df: DataFrame, m, key, seed) -> DataFrame:
    """m rows without replacement; fewer if there are fewer."""
    return take_by_hash(df, m, key, seed)


def exact_sample(df: DataFrame, m, key, seed) -> DataFrame:
    """m rows without replacement; too few rows fail the query."""
    short = df.agg(F.when(F.count(F.lit(1)) < m, 1).otherwise(0).alias("short"))
    return guard(seeded_sample(df, m, key, seed), short, f"fewer than {m} eligible rows")


def per_class_sample(df: DataFrame, label, m, key, seed) -> DataFrame:
    """m rows of each class."""
    return take_by_hash(df, m, key, seed, [label])


def pair_pools(df: DataFrame, source, label, background="coco_photos", derived_prefix="synthetic_") -> dict[str, DataFrame]:
    """The three pools pairs are drawn from; derived rows are in none."""
    real = df.filter(~F.col(source).startswith(derived_prefix))
    return {
        "positives": real.filter(F.col(label) == 1),
        "negatives": real.filter((F.col(label) == 0) & (F.col(source) != background)),
        "backgrounds": real.filter(F.col(source) == background),
    }


def pool_sizes(pools) -> DataFrame:
    """Sizes of the pools in one row; an empty pool fails the query."""
    row = None
    for name, pool in pools.items():
        size = pool.agg(F.count(F.lit(1)).alias(name))
        row = size if row is None else row.withColumn(name, size.scalar())
    return row.select(*[F.when(F.col(n) == 0, F.raise_error(F.lit(f"no {n}"))).otherwise(F.col(n)).alias(n) for n in pools])


def pair_plan(documents: DataFrame, backgrounds: DataFrame, key, n, kind, label, seed) -> DataFrame:
    """n draws with replacement of a document and a background, with label and lineage.

    Draw i hashes to a position in each pool; pools are numbered in digest order.
    """
    spark = documents.sparkSession
    draws = spark.range(n).withColumnRenamed("id", "draw")
    pools = {}
    for side, pool in (("document", documents), ("background", backgrounds)):
        numbered = dense_index(pool.select(F.col(key).alias(side)), side, f"{seed}:{side}", f"_{side}_index")
        pools[side] = numbered
        size = pool.agg(F.count(F.lit(1))).scalar()
        drawn = hash_number(seeded(seed, F.lit(kind), F.lit(side), "draw"), 0, 13) % size
        draws = draws.withColumn(f"_{side}_draw", drawn)
    planned = draws.join(pools["document"], F.col("_document_draw") == F.col("_document_index")).join(
        pools["background"], F.col("_background_draw") == F.col("_background_index"))
    return planned.select(
        F.format_string(f"syn_{kind}_%05d.jpg", "draw").alias("filepath"), F.lit(f"synthetic_{kind}").alias("source"),
        F.lit(label).alias("invoice_label"), F.col("document").alias("source_doc"), "background")


def group_key(df: DataFrame, source_doc="source_doc", path="filepath", name="group") -> DataFrame:
    """Adds the grouping key of a row: its lineage root, or itself."""
    return df.withColumn(name, root_or_self(source_doc, path))
