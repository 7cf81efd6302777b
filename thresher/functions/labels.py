"""Label and class expressions over manifest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.fixed_values import (
    ADVERTISEMENT_LABELS, BILL_CLASSES, CAPTURE_CONTEXTS, CLASS_NAMES, NARRATIVE_LABELS,
    PAGE_CLASSES, SCENE_LABELS, SCREENSHOT_PREFIXES, SOURCE_LABELS, STRUCTURED_LABELS, TARGETED_LABELS,
)
from thresher.functions.hashing import as_column

DEFAULT_FAMILY = "structured_document"
FAMILIES = {
    "structured_document": STRUCTURED_LABELS,
    "narrative_document": NARRATIVE_LABELS,
    "advertisement_presentation": ADVERTISEMENT_LABELS,
}
# The scene families exist in one of the two published mappers only.
FAMILIES_WITH_SCENES = {**FAMILIES, **{family: (label,) for label, family in SCENE_LABELS.items()}}


def or_error(value, message):
    """`value`, or a failing query where it is null. `message` may be a column."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.coalesce(value, F.raise_error(message))


def value_map(value, mapping):
    """Look a value up in a Python mapping; null where it is unknown."""
    value = as_column(value)
    chain = None
    for key, result in mapping.items():
        chain = F.when(value == key, result) if chain is None else chain.when(value == key, result)
    return chain


def map_label(source, mapping=SOURCE_LABELS, on_unknown="error"):
    """Ground-truth label of a source. An unknown source fails unless told otherwise."""
    label = value_map(source, mapping)
    if on_unknown == "error":
        return or_error(label, F.concat(F.lit("no label configured for source "), F.coalesce(as_column(source), F.lit("null"))))
    return label


def targeted_label(number, mapping=TARGETED_LABELS):
    """Name of a numeric label that is imported as a targeted negative; null for others."""
    return value_map(number, mapping)


def teacher_flag(predicted_class, positive="invoice"):
    """The teacher's opinion: recorded for audits, never used as the label."""
    return (as_column(predicted_class) == positive).cast("int")


def taxonomy(label, families=FAMILIES_WITH_SCENES, default=DEFAULT_FAMILY):
    """Family of a free-form document label."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(as_column(label), r"^\s+|\s+$", "")), "_", " ")
    chain = None
    for family, members in families.items():
        test = clean.isin(*members)
        chain = F.when(test, family) if chain is None else chain.when(test, family)
    return chain.otherwise(default)


def own_class(label, source, source_doc, predicted_class):
    """Class of a row from its own columns, leaving out what it inherits."""
    label, source = as_column(label), as_column(source)
    source_doc, predicted_class = as_column(source_doc), as_column(predicted_class)
    receipts = ("cord_receipts", "sroie_receipts")
    from_receipt = F.lit(False)
    for name in receipts:
        from_receipt = from_receipt | source_doc.contains(name)
    positive = (
        F.when(source.isin(*receipts), "receipt")
        .when((source == "synthetic_hard_pos") & from_receipt, "receipt")
        .otherwise("invoice")
    )
    negative = (
        F.when(source == "coco_photos", "natural_photo")
        .when(source == "hiertext_text_scene", "text_scene")
        .when(source == "target_hard_negative", DEFAULT_FAMILY)
        .when(source.startswith("rvl_targeted_"),
              taxonomy(F.regexp_replace(source, "^rvl_targeted_", ""), FAMILIES))
        .otherwise(taxonomy(F.coalesce(predicted_class, F.lit("")), FAMILIES))
    )
    return F.when(label == 1, positive).otherwise(negative)


def bill_label(class_index, classes=BILL_CLASSES):
    return as_column(class_index).isin(*classes).cast("int")


def class_position(class_name, names=CLASS_NAMES):
    """Index of a class name; an unknown name fails the query."""
    found = F.array_position(F.array(*[F.lit(n) for n in names]), as_column(class_name))
    return or_error(F.when(found > 0, (found - 1).cast("int")),
                    F.concat(F.lit("unknown class "), F.coalesce(as_column(class_name), F.lit("null"))))


def is_screenshot(path, prefixes=SCREENSHOT_PREFIXES):
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | as_column(path).startswith(prefix)
    return hit


def capture_context(path, prefixes=SCREENSHOT_PREFIXES):
    direct, screenshot = CAPTURE_CONTEXTS
    return F.when(is_screenshot(path, prefixes), screenshot).otherwise(direct)


def force_prefix(split, path, prefix, target="train"):
    """Rows below a path prefix go to one split."""
    return F.when(as_column(path).startswith(prefix), target).otherwise(as_column(split))


def lineage_key(*parts):
    """Parts joined with colons; a null part is empty, and keeps its colon."""
    return F.concat_ws(":", *[F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts])


def root_or_self(source_doc, path):
    """The lineage root, or the row itself where none is recorded (null or empty)."""
    return F.coalesce(F.nullif(as_column(source_doc), F.lit("")), as_column(path))


def page_class(category, mapping=PAGE_CLASSES):
    """struct(class_index, class_name) of a page category; null where unknown."""
    return F.struct(
        value_map(category, {k: v[0] for k, v in mapping.items()}).alias("class_index"),
        value_map(category, {k: v[1] for k, v in mapping.items()}).alias("class_name"),
    )
