"""Nested annotation files and image-record metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PARAGRAPHS = "array<struct<lines:array<struct<text:string,words:array<struct<text:string>>>>>>"
RECORD = f"struct<image_id:string,paragraphs:{PARAGRAPHS}>"


def read_annotations(spark: SparkSession, path, multi_line=True) -> DataFrame:
    """Annotation files (also gzipped): an object with `annotations`, or one record.

    An object that is neither gives no rows.
    """
    schema = f"annotations array<{RECORD}>, image_id string, paragraphs {PARAGRAPHS}"
    return annotation_rows(spark.read.schema(schema).option("multiLine", multi_line).json(path))


def annotation_rows(files: DataFrame) -> DataFrame:
    single = F.when(F.col("image_id").isNotNull(), F.array(F.struct("image_id", "paragraphs")))
    records = F.coalesce("annotations", single)
    return files.select(F.explode(records).alias("record")).select("record.image_id", "record.paragraphs")


def parse_records(df: DataFrame, column, schema, keep=()) -> DataFrame:
    """Rows of a JSON array, or of a single object, held in a string column.

    `schema` is the schema of one record. Text that is neither gives no rows.
    """
    text = F.col(column)
    as_array = F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = F.from_json(as_array, f"array<struct<{schema}>>")
    return df.select(*keep, F.explode(parsed).alias("_record")).select(*keep, "_record.*")


def read_image_records(spark: SparkSession, path, schema) -> DataFrame:
    """The `images` array of a split metadata file, one row per image."""
    files = spark.read.schema(f"images array<struct<{schema}>>").option("multiLine", True).json(path)
    return files.select(F.explode("images").alias("image")).select("image.*")
