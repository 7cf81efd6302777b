"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from thresher.fixed_values import OPERATING_TARGET
from thresher.functions.text import nested_text
from thresher.operators.calibration import calibrate_fusion
from thresher.plans.calibrating import BEST_FUSION
from thresher.plans.registry import query
from thresher.plans.views import ARRIVALS, EXAMPLES, NESTED_TEXT, SCORED
from thresher.session import fresh_path
from thresher.sources.annotations import PARAGRAPHS, parse_records, read_annotations
from thresher.sources.files import scan_files
from thresher.sources.history import remember, unseen
from thresher.sources.json_arrays import read_array_records
from thresher.sources.manifests import (
    append_manifest, new_arrivals, read_manifest, read_operating_point, report_json, scan_split, write_manifest,
    write_report, write_splits,
)
from thresher.sources.versions import open_version, publish, replace

MANIFEST = EXAMPLES + """,
manifest AS (
  SELECT id::VARCHAR AS filepath, source, category AS predicted_class, invoice_label::INT AS invoice_label,
    length(source)::DOUBLE / 8 AS confidence, source_doc FROM examples)"""


def manifest(t):
    return t.examples().select(
        F.col("id").cast("string").alias("filepath"), "source", F.col("category").alias("predicted_class"),
        F.col("invoice_label").cast("int").alias("invoice_label"),
        (F.length("source").cast("double") / 8).alias("confidence"), "source_doc")


@query("A1", f"WITH {MANIFEST} SELECT * FROM manifest")
def read_csv_manifest(t):
    path = fresh_path(t.spark, "manifest")
    write_manifest(manifest(t), path, "labeled")
    return read_manifest(t.spark, path, "labeled")


@query("A2", f"WITH {SCORED} SELECT id, class_index, y, direct, split FROM scored WHERE split = 'val'")
def scan_one_split(t):
    path = fresh_path(t.spark, "splits")
    write_splits(t.scored().select("id", "class_index", "y", "direct", "split"), path)
    return scan_split(t.spark.read.parquet(path), "val")


@query("A3", f"WITH {MANIFEST} SELECT filepath, invoice_label, source_doc FROM manifest")
def write_declared_fields(t):
    path = fresh_path(t.spark, "written")
    write_manifest(manifest(t), path, ("filepath", "invoice_label", "source_doc"), "parquet")
    return t.spark.read.parquet(path)


@query("A3", f"""WITH {MANIFEST}
SELECT 1 AS version, filepath, invoice_label FROM manifest
UNION ALL SELECT 2, filepath, coalesce(invoice_label, 0) FROM manifest""")
def replace_manifest(t):
    """A manifest with repaired labels takes the place of the first one, which a reader goes on reading."""
    root, fields = fresh_path(t.spark, "versions"), "filepath string, invoice_label int"
    publish(manifest(t).select("filepath", "invoice_label"), root)
    opened = open_version(t.spark, root, fields)
    replace(t.spark, root, fields, lambda newest: newest.withColumn("invoice_label", F.coalesce("invoice_label", F.lit(0))))
    number = lambda df, n: df.select(F.lit(n).alias("version"), "filepath", "invoice_label")
    return number(opened, 1).unionByName(number(open_version(t.spark, root, fields), 2))


@query("A4", f"""WITH {MANIFEST}
SELECT filepath, source, invoice_label, source_doc FROM manifest
UNION ALL SELECT 'syn/' || filepath, 'synthetic_hard_pos', invoice_label, source_doc FROM manifest WHERE invoice_label = 1""")
def append_derived_rows(t):
    path, fields = fresh_path(t.spark, "appended"), ["filepath", "source", "invoice_label", "source_doc"]
    base = manifest(t).select(*fields)
    write_manifest(base, path, fields, "parquet")
    derived = base.filter(F.col("invoice_label") == 1).select(
        F.concat(F.lit("syn/"), "filepath").alias("filepath"), F.lit("synthetic_hard_pos").alias("source"), "invoice_label", "source_doc")
    append_manifest(derived, path)
    return t.spark.read.parquet(path)


@query("A5", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars >= 500")
def pruned_scan(t):
    return t.documents().select("doc_id", "lang", "n_chars").filter(F.col("n_chars") >= 500)


@query("A6", f"""WITH {NESTED_TEXT}
SELECT image_id, sha256(text) AS digest FROM nested_texts""")
def nested_annotation_scan(t):
    path = fresh_path(t.spark, "annotations")
    record = F.struct("image_id", "paragraphs")
    wrapped = F.to_json(F.struct(F.array(record).alias("annotations")))
    # Both published shapes: user messages as a list of annotations, others as single records.
    several = F.col("image_id").endswith("0")
    t.nested().select(F.when(several, wrapped).otherwise(F.to_json(record)).alias("value")).write.option("compression", "gzip").text(path)
    read = read_annotations(t.spark, path, multi_line=False)
    return read.select("image_id", F.sha2(nested_text("paragraphs"), 256).alias("digest"))


@query("A6", f"""WITH {NESTED_TEXT}
SELECT image_id, sha256(text) AS digest FROM nested_texts""")
def large_annotation_files(t):
    """Each file is one object with all its records, on many lines; records are read one by one."""
    path = fresh_path(t.spark, "annotations")
    record, role = F.to_json(F.struct("image_id", "paragraphs")), F.substring("image_id", -1, 1)
    parts = t.nested().select(role.alias("file"), record.alias("record")).groupBy("file").agg(F.concat_ws(",\n", F.collect_list("record")).alias("records"))
    whole = F.concat(F.lit('{"info": {"annotations": [1]},\n"annotations": [\n'), "records", F.lit("\n], \"end\": 0}"))
    parts.select("file", whole.alias("value")).repartition("file").write.partitionBy("file").option("compression", "gzip").text(path)
    read = read_array_records(t.spark, path, "annotations", f"image_id string, paragraphs {PARAGRAPHS}", single="image_id")
    return read.select("image_id", F.sha2(nested_text("paragraphs"), 256).alias("digest"))


@query("A7", "SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events")
def image_array_records(t):
    """The `images` array of a metadata file for each split."""
    path = fresh_path(t.spark, "images")
    record = F.to_json(F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    parts = t.table("events").select(F.pmod("user_id", F.lit(3)).alias("file"), record.alias("record")).groupBy("file").agg(F.concat_ws(", ", F.collect_list("record")).alias("records"))
    whole = F.concat(F.lit('{"images": ['), "records", F.lit("]}"))
    parts.select("file", whole.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return read_array_records(t.spark, path, "images", "event_id bigint, event_type string, k bigint")


@query("A7", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def image_records(t):
    return parse_records(t.table("events"), "props", "k bigint", keep=["event_id"])


@query("A8", "SELECT DISTINCT lang AS folder FROM documents")
def directory_scan(t):
    path = fresh_path(t.spark, "files")
    t.documents().select("doc_id", "lang", "source").write.partitionBy("lang").option("header", True).csv(path)
    found = scan_files(t.spark, path, suffixes=(".csv",), recursive=True)
    return found.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("folder")).distinct()


@query("A9", f"WITH {BEST_FUSION} SELECT alpha, n, tp, fn, fp, tn FROM best_fusion")
def report_sink(t):
    best = calibrate_fusion(t.scored(), "y", "direct", "class_bill", OPERATING_TARGET, digits=9, auc=False)
    path = fresh_path(t.spark, "report")
    write_report(best.select(F.struct("alpha", F.struct("n", "tp", "fn", "fp", "tn").alias("metrics")).alias("calibration")), path)
    read = t.spark.read.schema(
        "calibration struct<alpha: double, metrics: struct<n: bigint, tp: bigint, fn: bigint, fp: bigint, tn: bigint>>").json(path)
    return read.select("calibration.alpha", "calibration.metrics.*")


@query("A9", f"""WITH {SCORED}
SELECT '{{"split":"' || split || '","n":' || count(*) || '}}' AS report FROM scored GROUP BY split""")
def report_as_json(t):
    counted = t.scored().groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return report_json(counted.select("split", "n"))


@query("A10", f"WITH {BEST_FUSION} SELECT alpha, threshold FROM best_fusion")
def operating_point(t):
    best = calibrate_fusion(t.scored(), "y", "direct", "class_bill", OPERATING_TARGET, digits=9, auc=False)
    path = fresh_path(t.spark, "point")
    write_report(best.select(F.struct(
        F.col("alpha").alias("alpha_direct_head"), (1 - F.col("alpha")).alias("alpha_class_bill_head"), "threshold").alias("calibration")), path)
    return read_operating_point(t.spark, path)


@query("A11", f"""WITH {ARRIVALS}
SELECT event_id, source_object, digest FROM arrivals
WHERE source_object <> 'click' AND digest NOT IN (SELECT digest FROM arrivals WHERE arrived < TIMESTAMP '2024-01-02 00:00:00')""")
def resume_arrivals(t):
    rows = t.arrivals()
    # Seen before: the whole click shard, and everything of the first day.
    first_day = rows.filter(F.col("arrived") < F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    shard = rows.filter(F.col("source_object") == "click").select("source_object")
    fresh = new_arrivals(new_arrivals(rows, shard, "source_object"), first_day, "digest")
    return fresh.select("event_id", "source_object", "digest")


@query("A11, S2", f"""WITH {ARRIVALS}
SELECT event_id, source_object, digest FROM arrivals
WHERE digest NOT IN (SELECT digest FROM arrivals WHERE arrived < TIMESTAMP '2024-01-02 00:00:00')""")
def resume_by_index(t):
    """The history is an index in buckets with filter pages, built by two deliveries."""
    rows, root = t.arrivals(), fresh_path(t.spark, "history")
    before = lambda at: F.col("arrived") < F.lit(at).cast("timestamp_ntz")
    remember(rows.filter(before("2024-01-01 12:00:00")), root, "digest")
    remember(rows.filter(before("2024-01-02 00:00:00") & ~before("2024-01-01 12:00:00")), root, "digest")
    return unseen(rows, root, "digest").select("event_id", "source_object", "digest")
