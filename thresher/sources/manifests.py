"""Manifests, split tables, reports and operating points on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from thresher.fixed_values import FIELD_TYPES, FIELDS
from thresher.operators.lineage import exclude_content

OPERATING_POINT = (
    "calibration struct<alpha_direct_head: double, alpha_class_bill_head: double, threshold: double, "
    "metrics: struct<n: bigint, positive: bigint, negative: bigint, recall: double, fpr: double, precision: double, "
    "auc: double, tp: bigint, fn: bigint, fp: bigint, tn: bigint>>"
)


def string_schema(fields):
    return StructType([StructField(name, StringType()) for name in fields])


def read_manifest(spark: SparkSession, path, kind, multi_line=False) -> DataFrame:
    """A CSV manifest with a header: all columns are read as strings, then cast.

    Values keep their blanks. Values with line breaks need `multi_line`, which reads a
    file in one task; large tables are better kept as Parquet.

    `kind` names a declared field list or is one. Types are never inferred; a value
    that cannot be cast fails the query, as an empty one does not (it is null).
    """
    fields = FIELDS[kind] if isinstance(kind, str) else tuple(kind)
    raw = (spark.read.schema(string_schema(fields)).option("header", True).option("enforceSchema", False)
           .option("escape", '"').option("mode", "FAILFAST").option("multiLine", multi_line)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return raw.select(*[F.col(f).cast(FIELD_TYPES[f]).alias(f) if f in FIELD_TYPES else F.col(f) for f in fields])


def scan_split(manifest: DataFrame, split) -> DataFrame:
    """Rows of one split; on a table written by :func:`write_splits` only its files are read."""
    return manifest.filter(F.col("split") == split)


def write_splits(df: DataFrame, path) -> None:
    """Writes a table partitioned by split."""
    df.write.mode("error").partitionBy("split").parquet(path)


def write_manifest(df: DataFrame, path, kind, form="csv") -> None:
    """Writes the declared fields to a new path.

    The commit protocol shows the files only when all are complete, so readers never see
    a half-written manifest; an existing path is never replaced under a reader.
    """
    fields = FIELDS[kind] if isinstance(kind, str) else tuple(kind)
    writer = df.select(*fields).write.mode("error")
    if form == "csv":
        (writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        writer.format(form).save(path)


def append_manifest(df: DataFrame, path, form="parquet") -> None:
    """Adds derived rows to a written manifest."""
    df.write.mode("append").format(form).save(path)


def write_report(report: DataFrame, path) -> None:
    """Writes a one-row nested report as JSON."""
    report.coalesce(1).write.mode("error").json(path)


def report_json(report: DataFrame, name="report") -> DataFrame:
    """The report as a JSON string column."""
    return report.select(F.to_json(F.struct("*")).alias(name))


def read_operating_point(spark: SparkSession, path) -> DataFrame:
    """(alpha, threshold) of a calibration report."""
    report = spark.read.schema(OPERATING_POINT).option("multiLine", True).json(path)
    return report.select(
        F.col("calibration.alpha_direct_head").alias("alpha"), F.col("calibration.threshold").alias("threshold"))


def new_arrivals(df: DataFrame, seen: DataFrame, keys) -> DataFrame:
    """Rows whose value of no key column has been seen already.

    Each key is judged on its own: a shard counts as done by its name, a record by its
    digest. One shard may hold a large share of the rows.
    """
    fresh = df
    for key in [keys] if isinstance(keys, str) else keys:
        fresh = exclude_content(fresh, seen, key)
    return fresh
