"""Directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.fixed_values import IMAGE_SUFFIXES
from thresher.functions.text import basename, suffix


def scan_files(spark: SparkSession, root, suffixes=IMAGE_SUFFIXES, recursive=False, content=False) -> DataFrame:
    """Files below a folder whose suffix, in any case, is in the set.

    Without `content` the bytes are not read: Spark prunes the column.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    found = found.withColumn("file", basename("path")).filter(suffix("path").isin(*suffixes))
    return found.select("path", "file", "length", *(["content"] if content else []))


def ordered_files(listing: DataFrame) -> DataFrame:
    """The listing in path order."""
    return listing.orderBy(F.col("path"))
