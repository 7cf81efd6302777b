"""Manifest algebra: union, disjointness, conforming, row-count checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from thresher.operators.metrics import duplicates
from thresher.operators.ordering import as_list, guard
from thresher.session import pinned


def concat_unique(*manifests: DataFrame, key) -> DataFrame:
    """All rows of all manifests; a key that occurs twice fails the query."""
    whole = reduce(lambda a, b: a.unionByName(b), manifests)
    repeated = duplicates(whole, key).agg(F.count(F.lit(1)).alias("n"))
    return guard(whole, repeated, "duplicate keys in the combined manifest")


def overlap(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Keys in both tables. Copies are dropped before the tables meet, not after."""
    packed = F.struct(*as_list(key))
    left, right = a.select(packed.alias("_left")).distinct(), b.select(packed.alias("_right")).distinct()
    return left.join(right, F.col("_left") == F.col("_right")).select("_left.*")


def assert_disjoint(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """`b`, failing if any of its keys is in `a`."""
    shared = overlap(a, b, key).agg(F.count(F.lit(1)).alias("n"))
    return guard(b, shared, "keys already exist in the base manifest")


def conform(df: DataFrame, shape, constants=None) -> DataFrame:
    """Projects to the columns of `shape`, filling those named in `constants`.

    A constant may be a value or a column. A column that is neither present nor a
    constant is an error.
    """
    constants = constants or {}
    chosen = []
    for name in shape:
        if name in constants:
            value = constants[name]
            chosen.append((value if hasattr(value, "alias") else F.lit(value)).alias(name))
        else:
            chosen.append(F.col(name))
    return df.select(*chosen)


def union_conformed(shape, *parts) -> DataFrame:
    """Unions (df, constants) pairs in one shape."""
    return reduce(lambda a, b: a.unionByName(b), [conform(df, shape, constants) for df, constants in parts])


def add_train_only(base: DataFrame, mined: DataFrame, key, fields, split="split", selection="selection") -> DataFrame:
    """Adds the train rows of a mined manifest to the base.

    Fails if a held-out row is marked train, if a key exists already, or if the mined
    manifest has no train rows.
    """
    train = mined.filter(F.col(split) == "train")
    checked = train.withColumn(key, F.when(
        F.col(selection) == "external_holdout", F.raise_error(F.lit("a held-out row is marked train"))).otherwise(F.col(key)))
    none = train.agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("none"))
    additions = assert_disjoint(base, checked.select(*fields), key)
    return guard(base.select(*fields), none, "no train rows in the mined manifest").unionByName(additions)


def preserve_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after`, failing unless it has as many rows as `before`."""
    n_before = before.agg(F.count(F.lit(1))).scalar()
    changed = after.agg(F.when(F.count(F.lit(1)) != n_before, 1).otherwise(0).alias("changed"))
    return guard(after, changed, "rows were lost or added")


def transform_preserving(before: DataFrame, transform) -> DataFrame:
    """`transform(before)`, written; fails unless it has as many rows as `before`. It must read its argument.

    Rows of the input are counted while they pass (`observe`), and those of the result by the
    footers of the written table, so both tables are made once. A repeated stage can make the
    first count too large, so before the step fails the input is counted for itself.
    """
    passed = Observation()
    counted = before.observe(passed, F.count(F.lit(1)).alias("n"))
    after = pinned(transform(counted))
    n_after = after.count()
    if passed.get["n"] != n_after and before.count() != n_after:
        raise ValueError("rows were lost or added")
    return after


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of both tables and whether they agree."""
    counted = before.agg(F.count(F.lit(1)).alias("rows_before"))
    counted = counted.withColumn("rows_after", after.agg(F.count(F.lit(1))).scalar())
    return counted.withColumn("preserved", (F.col("rows_before") == F.col("rows_after")).cast("int"))
