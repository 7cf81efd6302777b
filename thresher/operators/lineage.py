"""Lookups, label repair along lineage, and pairing by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.fixed_values import BILL_CLASSES, CLASS_NAMES
from thresher.functions.labels import or_error, own_class, taxonomy
from thresher.operators.ordering import attach_reference


def lookup(df: DataFrame, reference: DataFrame, key, column, required=True) -> DataFrame:
    """Brings one column of a unique-key table to rows whose key is unique too.

    With `required`, a row without a match fails the query.
    """
    wanted = reference.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    joined = df.join(wanted, F.col(key) == F.col("_key"), "left")
    value = F.col("_value")
    if required:
        value = or_error(value, F.concat(F.lit(f"no {column} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(column, value).drop("_key", "_value")


def override(df: DataFrame, overrides: DataFrame, key, column) -> DataFrame:
    """Replaces a column wherever the override table names the key."""
    wanted = overrides.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    joined = df.join(wanted, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_value", column)).drop("_key", "_value")


def derive_fixes(manifest: DataFrame, overrides: DataFrame, source, expected, key="filepath", predicted="predicted_class", column="class_name") -> DataFrame:
    """(key, column): the class fixes of one source's rows.

    A reviewed label of `overrides` (key, label) comes first; without one, a row whose
    teacher class is not the expected one gets the family of that class.
    """
    rows = manifest.filter(F.col("source") == source).select(key, predicted)
    reviewed = overrides.select(F.col(key).alias("_key"), F.col("label").alias("_label"))
    teacher = F.lower(F.regexp_replace(F.coalesce(predicted, F.lit("")), r"^\s+|\s+$", ""))
    label = F.coalesce("_label", F.when(teacher != expected, teacher))
    joined = rows.join(reviewed, F.col(key) == F.col("_key"), "left").withColumn("_fix", label)
    return joined.filter(F.col("_fix").isNotNull()).select(key, taxonomy("_fix").alias(column))


def repair_classes(df: DataFrame, fixes: DataFrame, key, parent, column,
                   positives=tuple(CLASS_NAMES[i] for i in BILL_CLASSES)) -> DataFrame:
    """Applies a class fix of the row itself, else of its lineage root.

    Only rows whose class is a positive one are changed. `fixes` has (key, column),
    one row per key. A root may own a large share of the rows.
    """
    fixes = fixes.select(F.col(key).alias("_fixed"), F.col(column).alias("_own_fix"))
    own = df.join(fixes, F.col(key) == F.col("_fixed"), "left").drop("_fixed")
    both = attach_reference(own, fixes.withColumnRenamed("_own_fix", "_root_fix"), parent, ["_root_fix"], "_fixed")
    fix = F.coalesce("_own_fix", "_root_fix")
    changed = fix.isNotNull() & F.col(column).isin(*positives)
    return both.withColumn(column, F.when(changed, fix).otherwise(F.col(column))).drop("_own_fix", "_root_fix")


def inherit_label(df: DataFrame, key, parent, label, source, derived_prefix="synthetic_",
                  names=("synthetic_hard_neg", "synthetic_hard_pos")) -> DataFrame:
    """Derived rows take the label of their root and are renamed by it.

    Roots keep theirs. A derived row whose root is missing fails the query; a derived
    row does not count as a root.
    """
    derived = F.col(source).startswith(derived_prefix)
    roots = df.filter(~derived).select(F.col(key).alias("_root"), F.col(label).alias("_root_label"))
    joined = attach_reference(df, roots, parent, ["_root_label"], "_root")
    inherited = or_error(F.col("_root_label"), F.concat(F.lit("missing lineage root of "), F.col(key).cast("string")))
    joined = joined.withColumn(label, F.when(derived, inherited).otherwise(F.col(label)))
    renamed = F.when(F.col(label) == 1, names[1]).otherwise(names[0])
    return joined.withColumn(source, F.when(derived, renamed).otherwise(F.col(source))).drop("_root_label")


def derive_class(df: DataFrame, key="filepath", parent="source_doc", label="invoice_label",
                 source="source", predicted="predicted_class") -> DataFrame:
    """Adds `class_name`; negative composites inherit the class of their root (depth one)."""
    own = df.withColumn("class_name", own_class(label, source, parent, predicted))
    parents = own.select(F.col(key).alias("_root"), F.col("class_name").alias("_root_class"))
    joined = attach_reference(own, parents, parent, ["_root_class"], "_root")
    composite = (F.col(label) != 1) & F.col(source).isin("synthetic_hard_neg", "synthetic_hard_pos")
    inherits = composite & F.col("_root_class").isNotNull()
    return joined.withColumn("class_name", F.when(inherits, F.col("_root_class")).otherwise(F.col("class_name"))).drop("_root_class")


def refresh_labels(splits: DataFrame, manifest: DataFrame, key, label) -> DataFrame:
    """Recopies labels into a split table; membership stays, a missing row fails."""
    return lookup(splits.drop(label), manifest, key, label).select(*splits.columns)


def listed(df: DataFrame, chosen: DataFrame, key) -> DataFrame:
    """Rows whose key is in the list."""
    return df.join(chosen.select(key).distinct(), key, "left_semi")


def _flagged(df, other, column):
    known = other.select(F.col(column).alias("_other")).distinct().withColumn("_known", F.lit(1))
    return attach_reference(df, known, column, ["_known"], "_other")


def exclude_content(df: DataFrame, other: DataFrame, digest) -> DataFrame:
    """Rows whose digest does not occur in `other`; a digest may have very many copies."""
    return _flagged(df, other, digest).filter(F.col("_known").isNull()).drop("_known")


def content_overlap(df: DataFrame, other: DataFrame, digest) -> DataFrame:
    """How many rows :func:`exclude_content` keeps and drops, from digest counts alone."""
    counts = df.groupBy(digest).agg(F.count(F.lit(1)).alias("_rows"))
    known = other.select(F.col(digest).alias("_other")).distinct()
    joined = counts.join(known, F.col(digest) == F.col("_other"), "left")
    seen = F.col("_other").isNotNull()
    return joined.agg(
        F.coalesce(F.sum(F.when(~seen, F.col("_rows"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(seen, F.col("_rows"))), F.lit(0)).alias("excluded"),
    )


def keep_selected(df: DataFrame, chosen: DataFrame, key, split="split", train="train") -> DataFrame:
    """Rows of the train split only if chosen; every other row."""
    flags = chosen.select(F.col(key).alias("_chosen")).distinct()
    joined = df.join(flags, F.col(key) == F.col("_chosen"), "left")
    return joined.filter((F.col(split) != train) | F.col("_chosen").isNotNull()).drop("_chosen")


def pair_models(a: DataFrame, b: DataFrame, key, score) -> DataFrame:
    """(key, a's columns, score_a, score_b) of rows both models scored, joined on the key."""
    other = b.select(F.col(key).alias("_key"), F.col(score).alias("score_b"))
    joined = a.withColumnRenamed(score, "score_a").join(other, F.col(key) == F.col("_key"))
    return joined.drop("_key")


def missing_files(manifest: DataFrame, listing: DataFrame, key) -> DataFrame:
    """Manifest rows with no file in the listing."""
    return manifest.join(listing.select(key), key, "left_anti")
