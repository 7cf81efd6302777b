"""Exact order-dependent results without ever ordering a whole group in one task.

Three ways are used, and every operator picks one of them:

* *prefix sums* (:func:`prefix_sums`): rows are first reduced to one row per key and
  value, spread over value ranges, totalled per range, and only then ordered within
  each range. Areas under curves, quantiles and thresholds come from this.
* *top-k* (:func:`top_per_group`): each input task keeps its best k rows of a group and
  sends them to one slice of it, then the slices are merged, so a group holding a third
  of the table costs the last task `slices x k` rows, and that number is bounded.
* *digest order* (:func:`take_by_hash`, :func:`dense_index`): digests are uniform, so
  their leading digits are ready-made ranges of equal size.

Cut values only spread work; no result depends on where they fall.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from thresher.functions.hashing import seeded
from thresher.session import parallelism, pinned

# Most rows of a group, slices times k, that are merged in one task; beyond it rows are ranked in range slices.
MERGE_LIMIT = 1_000_000
# Largest k of a whole-table top-k that each task keeps in a heap.
HEAP_LIMIT = 1000
# Smallest k for which groups are merged slice by slice first.
SLICE_FROM = 32
# Hex digits of a digest that name its range: 65,536 ranges.
PREFIX_DIGITS = 4
# A key with at least one row in HOT_SHARE is hot; there cannot be more than HOT_SHARE of them.
HOT_SHARE = 1000
# Points of a score column that one range holds, about.
RANGE_POINTS = 1_000_000


def as_list(names):
    return [names] if isinstance(names, str) else list(names)


def order_columns(order):
    """`["-score", "id"]` as sort columns; a leading minus means descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in as_list(order)]


def order_names(order):
    return [o.lstrip("-") for o in as_list(order)]


def group_window(keys):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def join_on(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join in which null keys meet each other.

    Null-safe tests also keep Spark from adding "is not null" filters to one branch of a
    table that is used twice, which would stop it from reusing the shuffle of the other.
    """
    keys = list(keys)
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    tests = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, tests), how).drop(*[f"_right_{k}" for k in keys])


# --- prefix sums ------------------------------------------------------------------


def cut_values(df: DataFrame, value, parts=None):
    """At most `parts - 1` values that divide the rows of a numeric column into similar shares.

    Without `parts` there is one for every RANGE_POINTS rows, and one per shuffle task at least.
    """
    parts = parts or max(parallelism(df.sparkSession), df.count() // RANGE_POINTS)
    if parts < 2:
        return []
    column = df.select(F.col(value).cast("double").alias("value"))
    found = column.approxQuantile("value", [i / parts for i in range(1, parts)], 1.0 / (2 * parts))
    return sorted(set(found))


def bucketed(df: DataFrame, value, cuts, name="_range") -> DataFrame:
    """Adds the index of the range between sorted `cuts` that holds the value."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    as_double = df.withColumn("_cut_value", F.col(value).cast("double"))
    split = Bucketizer(splits=splits, inputCol="_cut_value", outputCol=name, handleInvalid="keep")
    placed = split.transform(as_double).drop("_cut_value")
    return placed.withColumn(name, F.col(name).cast("int"))


def prefix_sums(points: DataFrame, measures, order, range_column, keys=(), descending=False) -> DataFrame:
    """Adds `<m>_upto` (inclusive running total) and `<m>_total` for each measure.

    `points` has few rows per range; ranges ascend with `order`. Per key the range
    totals are at most as many rows as there are ranges, so their window is small.
    """
    keys, measures, order = as_list(keys), as_list(measures), as_list(order)
    direct = F.desc if descending else F.asc
    # One struct names a range of a key. It is never null, so a plain equality will do, and
    # the window and the join agree on one shuffle of the points.
    grouped = points.withColumn("_group", F.struct(*keys, range_column))
    totals = grouped.groupBy("_group").agg(*[F.sum(m).alias(m) for m in measures])
    group = group_window([F.col("_group")[k] for k in keys])
    before = group.orderBy(direct(F.col("_group")[range_column])).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_group").alias("_of"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_before") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
    )
    within = (Window.partitionBy("_group").orderBy(*[direct(o) for o in order])
              .rowsBetween(Window.unboundedPreceding, 0))
    running = grouped.withColumns({f"_{m}_within": F.sum(m).over(within) for m in measures})
    joined = running.join(offsets, F.col("_group") == F.col("_of"))
    return joined.select(
        *[c for c in points.columns if c != range_column],
        *[(F.col(f"_{m}_within") + F.col(f"_{m}_before")).alias(f"{m}_upto") for m in measures],
        *[F.col(f"{m}_total") for m in measures],
    )


def score_points(df: DataFrame, score, measures, keys=(), descending=False) -> DataFrame:
    """One row per key and distinct score, with measures and their running totals.

    `measures` maps a name to an aggregate column. The table is read once: its points are
    written, and the ranges are cut by points, so a score that most rows share is one
    point of one range.
    """
    keys = as_list(keys)
    known = df.filter(F.col(score).isNotNull())
    points = pinned(known.groupBy(*keys, score).agg(*[c.alias(name) for name, c in measures.items()]))
    cuts = cut_values(points, score)
    return prefix_sums(bucketed(points, score, cuts), list(measures), score, "_range", keys, descending)


def covers(rank, count="_n"):
    """Whether a point of `score_points` holds the 0-based rank."""
    return (F.col(f"{count}_upto") > rank) & (F.col(f"{count}_upto") - F.col(count) <= rank)


def interpolate(low, high, fraction):
    """Linear interpolation, taken from the nearer end so that equal ends stay exact."""
    return F.when(fraction >= 0.5, high - (high - low) * (F.lit(1.0) - fraction)).otherwise(
        low + (high - low) * fraction)


def quantile_columns(score, probabilities, count="_n"):
    """For an aggregation over `score_points`: two columns per probability.

    Combine them with :func:`quantile_from` afterwards.
    """
    columns = []
    for i, p in enumerate(probabilities):
        position = (F.col(f"{count}_total") - 1) * F.lit(float(p))
        columns.append(F.max(F.when(covers(F.floor(position), count), F.col(score))).alias(f"_low_{i}"))
        columns.append(F.max(F.when(covers(F.ceil(position), count), F.col(score))).alias(f"_high_{i}"))
    return columns


def quantile_from(i, probability, total):
    position = (F.col(total) - 1) * F.lit(float(probability))
    return interpolate(F.col(f"_low_{i}"), F.col(f"_high_{i}"), position - F.floor(position))


def quantile_rows(points: DataFrame, score, probabilities, keys=(), count="_n") -> DataFrame:
    """Exact quantiles in long form, (keys, probability, quantile), for long lists of them."""
    keys = as_list(keys)
    grid = F.array(*[F.lit(float(p)) for p in probabilities])
    position = lambda p: (F.col(f"{count}_total") - 1) * p
    hit = F.filter(grid, lambda p: covers(F.floor(position(p)), count) | covers(F.ceil(position(p)), count))
    rows = points.select(*keys, score, count, f"{count}_upto", f"{count}_total", F.explode(hit).alias("probability"))
    spot = position(F.col("probability"))
    ends = rows.groupBy(*keys, "probability").agg(
        F.max(F.when(covers(F.floor(spot), count), F.col(score))).alias("_low"),
        F.max(F.when(covers(F.ceil(spot), count), F.col(score))).alias("_high"),
        F.max(spot - F.floor(spot)).alias("_fraction"),
    )
    return ends.select(*keys, "probability", interpolate(F.col("_low"), F.col("_high"), F.col("_fraction")).alias("quantile"))


# --- top-k ------------------------------------------------------------------------


def rank_rows(df: DataFrame, order, keys=(), name="rank") -> DataFrame:
    """Exact 1-based rank within groups of any size.

    Rows are range-partitioned on the whole order and written, which pins the slices:
    a lost executor cannot move a row to another slice between the two passes.
    """
    keys = as_list(keys)
    sort = [F.col(k).asc() for k in keys] + order_columns(order)
    sliced = df.repartitionByRange(parallelism(df.sparkSession), *sort).withColumn("_slice", F.spark_partition_id())
    written = pinned(sliced).withColumn("_group", F.struct(*keys, "_slice"))
    sizes = written.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    whole = group_window([F.col("_group")[k] for k in keys])
    before = whole.orderBy(F.col("_group")["_slice"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_group").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = written.withColumn("_within", F.row_number().over(Window.partitionBy("_group").orderBy(*order_columns(order))))
    ranked = placed.join(offsets, F.col("_group") == F.col("_of"))
    return ranked.select(*df.columns, (F.col("_within") + F.col("_before")).alias(name))


def top_per_group(df: DataFrame, k, order, keys=(), rank=None) -> DataFrame:
    """The first `k` rows of each group in `order` (make it total: end with an id).

    Spark limits each group before the shuffle (WindowGroupLimit). From SLICE_FROM rows
    on, slices of a group are merged in a second step, so that many input tasks do not
    all send their k rows to one task; an input task feeds one slice and so sends k rows
    of a group at most. `rank` names a column to keep the rank in.
    """
    keys, name = as_list(keys), rank or "_rank"
    if k < 1:
        return df.limit(0) if rank is None else df.withColumn(rank, F.lit(0)).limit(0)
    parts = parallelism(df.sparkSession)
    if k * (parts if k >= SLICE_FROM else 1) > MERGE_LIMIT:
        kept = rank_rows(df, order, keys, name).filter(F.col(name) <= k)
        return kept if rank else kept.drop(name)
    sort = order_columns(order)
    part = df
    if not keys and rank is None and k <= HEAP_LIMIT:
        return df.orderBy(*sort).limit(k)  # a heap per task and no sort
    if k >= SLICE_FROM:
        part = df.withColumn("_salt", F.spark_partition_id() % parts)
        sliced = Window.partitionBy(*keys, "_salt").orderBy(*sort)
        part = part.withColumn(name, F.row_number().over(sliced)).filter(F.col(name) <= k).drop(name, "_salt")
    if not keys and rank is None:
        return part.orderBy(*sort).limit(k)
    kept = part.withColumn(name, F.row_number().over(group_window(keys).orderBy(*sort))).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


# --- digest order -----------------------------------------------------------------


def with_digest(df: DataFrame, id_columns, seed) -> DataFrame:
    """Adds the digest that seeded orders sort by, and its leading digits."""
    hashed = df.withColumn("_digest", F.sha2(seeded(seed, *as_list(id_columns)), 256))
    return hashed.withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))


def take_by_hash(df: DataFrame, quota, id_columns, seed, keys=()) -> DataFrame:
    """The first `quota` rows of each group in seeded digest order, for any quota.

    `quota` is a number or a function of the group-size column. A number that one task
    can merge is a plain top-k. Otherwise digest ranges are
    counted, the one range holding the last kept row is ordered, and the row found
    there becomes a cut that the table is filtered by: the rows themselves are not
    shuffled. `id_columns` must identify a row.
    """
    keys, ids = as_list(keys), as_list(id_columns)
    wanted = quota if callable(quota) else (lambda n: F.lit(quota))
    marked = with_digest(df, ids, seed)
    if not callable(quota) and quota <= MERGE_LIMIT:
        return top_per_group(marked, quota, ["_digest", *ids], keys).select(*df.columns)
    slim = marked.select(*keys, *[c for c in ids if c not in keys], "_digest", "_prefix")
    counts = slim.groupBy(*keys, "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    group = group_window(keys)
    upto = group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.select(*keys, "_prefix", "_rows", F.sum("_rows").over(upto).alias("_upto"), F.sum("_rows").over(group).alias("_size"))
    ranges = ranges.withColumn("_quota", F.least(wanted(F.col("_size")).cast("bigint"), F.col("_size")))
    edge = ranges.filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_rows") < F.col("_quota"))).select(
        *keys, F.struct(F.col("_prefix").alias("prefix"), (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("need"),
                        F.col("_size").alias("size")).alias("_edge"), "_size")
    if keys:
        near = join_small(slim, edge, keys, "_size")
    else:
        near = slim.withColumn("_edge", edge.select("_edge").scalar())
    near = near.filter(F.col("_prefix") == F.col("_edge.prefix"))  # one range per key
    place = F.row_number().over(Window.partitionBy(*keys, "_prefix").orderBy("_digest", *ids))
    cut_at = F.struct("_digest", *[F.col(c) for c in ids])
    cut = near.withColumn("_place", place).filter(F.col("_place") == F.col("_edge.need")).select(
        *keys, F.col("_edge.size").alias("_size"), cut_at.alias("_cut"))
    if keys:
        kept = join_small(marked, cut, keys, "_size")
    else:
        kept = marked.withColumn("_cut", cut.select("_cut").scalar())
    return kept.filter(cut_at <= F.col("_cut")).select(*df.columns)


def dense_index(df: DataFrame, id_columns, seed, name="index") -> DataFrame:
    """Numbers rows 0..n-1 in seeded digest order."""
    ids = as_list(id_columns)
    marked = with_digest(df, ids, seed).withColumn("_one", F.lit(1).cast("bigint"))
    counted = prefix_sums(marked, "_one", ["_digest", *ids], "_prefix")
    return counted.withColumn(name, F.col("_one_upto") - 1).select(*df.columns, name)


# --- joins on keys that may be hot --------------------------------------------------


def join_small(rows: DataFrame, table: DataFrame, keys, size, how="inner") -> DataFrame:
    """Joins a table that has one row per key; `size` is the number of rows each key has.

    The keys travel as one struct, in which Spark takes nulls, NaN, and zeros of either
    sign for equal as grouping does, and :func:`attach` does the rest: hot keys are split
    off, and a small table is broadcast by its real size.
    """
    keys = as_list(keys)
    values = [c for c in table.columns if c not in keys + [size]]
    packed = table.select(F.struct(*keys).alias("_packed"), size, F.struct(*values).alias("_found"))
    joined = attach(rows.withColumn("_packed", F.struct(*keys)), packed, "_packed", size, ["_found"])
    if how == "inner":
        joined = joined.filter(F.col("_found").isNotNull())
    return joined.select(*rows.columns, "_found.*")


def attach(rows: DataFrame, groups: DataFrame, key, size, columns) -> DataFrame:
    """Left-joins `groups` (one row per key, `size` = rows it has in `rows`).

    The groups are written first, since they are used three times. Keys holding a large
    share of the rows are few by arithmetic, at most HOT_SHARE, so those are broadcast;
    their rows, and rows without a key, are spread over all tasks of the second join
    instead of meeting in one. The other keys are an ordinary join: Spark knows the size of the written
    table and shuffles only if it is large.
    """
    columns = as_list(columns)
    groups = pinned(groups.select(key, size, *columns))
    total = groups.agg(F.sum(size)).scalar()
    is_hot = F.col(size) * HOT_SHARE >= total
    hot = groups.filter(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*columns).alias("_hot"))
    cold = groups.filter(~is_hot).select(F.col(key).alias("_cold_key"), F.struct(*columns).alias("_cold"), F.lit(0).alias("_cold_spread"))
    slices = parallelism(rows.sparkSession)
    spread = 1 + F.pmod(F.xxhash64(*[c for c in rows.columns if c != key] or [key]), F.lit(slices))
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    elsewhere = F.col("_hot").isNotNull() | F.col(key).isNull()
    first = first.withColumn("_spread", F.when(elsewhere, spread).otherwise(0))
    both = first.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_spread") == F.col("_cold_spread")), "left")
    kept = [c for c in rows.columns if c not in columns]
    return both.select(*kept, *[
        F.when(F.col("_hot").isNotNull(), F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")).alias(c) for c in columns])


def attach_reference(rows: DataFrame, reference: DataFrame, key, columns, reference_key=None) -> DataFrame:
    """Left-joins a unique-key reference to rows whose key may be hot.

    The keys are counted first, so the reference meets one row per key, and
    :func:`attach` then brings the result to the rows.
    """
    reference_key = reference_key or key
    columns = as_list(columns)
    counts = rows.groupBy(F.col(key).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = reference.select(F.col(reference_key).alias("_reference"), *columns)
    groups = counts.join(wanted, F.col("_group") == F.col("_reference"), "left").select(
        F.col("_group").alias(key), "_rows", *columns)
    return attach(rows, groups, key, "_rows", columns)


# --- guards -------------------------------------------------------------------------


def guard(df: DataFrame, violations: DataFrame, message) -> DataFrame:
    """`df`, failing when `violations` (one row, one count) is not zero.

    The check is a filter, so it holds for a count or any choice of columns too, and a
    branch that never has rows, so it holds for an empty table.
    """
    fails = lambda n: F.when(n > 0, F.raise_error(F.lit(message)).cast("boolean"))
    never = violations.filter(fails(F.col(violations.columns[0])).otherwise(F.lit(False)))
    nothing = never.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.filter(fails(violations.scalar()).otherwise(F.lit(True))).unionByName(nothing)
