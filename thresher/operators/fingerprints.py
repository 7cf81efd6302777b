"""Fingerprints by range, so that a mismatch can be looked up where it is.

A row's digest is that of :func:`thresher.operators.metrics.fingerprint`, and its range is the
first digits of the digest of its key. Digests add up by range, and ranges to the fingerprint of
the table. Two tables are compared by their ranges, 16 ** DIGITS rows, and rows are read of the ranges
that differ only; a table written by range is sorted by it, so the statistics of its files and row groups
let the others be passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.operators.ordering import as_list

DIGITS = 3
ROW_GROUP_BYTES = 8 << 20
CHANGES = ("removed", "added", "changed")


def cell_digests(columns):
    return [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in as_list(columns)]


def with_range(df: DataFrame, key, name="range", digits=DIGITS) -> DataFrame:
    """Adds the range that the key of a row belongs to."""
    return df.withColumn(name, F.substring(F.sha2(F.concat_ws("|", *cell_digests(key)), 256), 1, digits))


def range_fingerprints(df: DataFrame, key, columns, digits=DIGITS) -> DataFrame:
    """(range, n, fingerprint) of every range that has rows."""
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", *cell_digests(columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return with_range(df, key, digits=digits).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("_sum")).select(
        "range", "n", F.col("_sum").cast("string").alias("fingerprint"))


def table_of_ranges(ranges: DataFrame) -> DataFrame:
    """(n, fingerprint) of the table, equal to its :func:`thresher.operators.metrics.fingerprint`."""
    return ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                      F.coalesce(F.sum(F.col("fingerprint").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def differing_ranges(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(range, n_recorded, n_found) of the ranges whose rows are not the same."""
    other = found.select(F.col("range").alias("_range"), F.col("n").alias("_n"), F.col("fingerprint").alias("_fingerprint"))
    both = recorded.join(other, F.col("range") == F.col("_range"), "full")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("fingerprint").eqNullSafe(F.col("_fingerprint"))
    zero = F.lit(0).cast("bigint")
    return both.filter(~same).select(F.coalesce("range", "_range").alias("range"), F.coalesce("n", zero).alias("n_recorded"), F.coalesce("_n", zero).alias("n_found"))


def write_by_range(df: DataFrame, path, key, digits=DIGITS) -> None:
    """Writes a table with its ranges, in their order and in row groups that hold few of them."""
    ranged = with_range(df, key, digits=digits)
    ranged.repartitionByRange("range").sortWithinPartitions("range").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def differing_rows(before: DataFrame, after: DataFrame, ranges: DataFrame, key, columns) -> DataFrame:
    """(key, change) of the keys that were removed, added or changed, read from the given ranges only.

    Both tables have a `range` column. Rows of one key count together, so repeated rows are told too.
    """
    keys = as_list(key)
    wanted = [r[0] for r in ranges.select("range").distinct().collect()]  # 16 ** DIGITS at most
    if not wanted:
        return before.select(*keys, F.lit("").alias("change")).limit(0)
    row = F.sha2(F.concat_ws("|", *cell_digests(columns)), 256)

    def side(df, name):
        packed = df.filter(F.col("range").isin(wanted)).select(F.struct(*keys).alias(f"_{name}"), row.alias("_row"))
        return packed.groupBy(f"_{name}").agg(F.sort_array(F.collect_list("_row")).alias(f"_{name}_rows"))

    met = side(before, "old").join(side(after, "new"), F.col("_old") == F.col("_new"), "full")
    change = F.when(F.col("_new").isNull(), CHANGES[0]).when(F.col("_old").isNull(), CHANGES[1]).otherwise(CHANGES[2])
    changed = met.filter(~F.col("_old_rows").eqNullSafe(F.col("_new_rows")))
    return changed.select(F.coalesce("_old", "_new").alias("_key"), change.alias("change")).select("_key.*", "change")
