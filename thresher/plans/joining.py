"""Lookups, lineage repair, semi- and anti-joins, set operations."""

from pyspark.sql import functions as F

from thresher.functions.labels import map_label
from thresher.operators import lineage as G, manifests as M
from thresher.operators.calibration import fusion_grid
from thresher.plans.expressions import FUSED_SQL, SOURCE_MAP
from thresher.plans.registry import query
from thresher.plans.views import EXAMPLES, LINEAGE, SCORED, SOURCE_LABEL, SPLIT_EXAMPLES, text
from thresher.session import fresh_path
from thresher.sources.files import scan_files


@query("C1", f"""WITH {EXAMPLES} SELECT e.id, d.n_chars FROM examples e JOIN documents d ON d.doc_id = e.id""")
def mandatory_lookup(t):
    sizes = t.documents().select(F.col("doc_id").alias("id"), "n_chars")
    return G.lookup(t.examples().select("id"), sizes, "id", "n_chars")


@query("C2", f"""WITH {LINEAGE},
classes AS (SELECT filepath, source_doc, CASE WHEN predicted_class IN ('en', 'fr') THEN 'invoice' ELSE 'natural_photo' END AS class_name FROM lineage),
fixes AS (SELECT doc_id::VARCHAR AS filepath, CASE WHEN toxic = 1 THEN 'narrative_document' ELSE 'structured_document' END AS fix FROM labels WHERE quality = 0)
SELECT c.filepath, CASE WHEN class_name IN ('receipt', 'invoice') THEN coalesce(o.fix, r.fix, class_name) ELSE class_name END AS class_name
FROM classes c LEFT JOIN fixes o ON o.filepath = c.filepath LEFT JOIN fixes r ON r.filepath = c.source_doc""")
def repair_by_lineage(t):
    classes = t.lineage().select("filepath", "source_doc", F.when(
        F.col("predicted_class").isin("en", "fr"), "invoice").otherwise("natural_photo").alias("class_name"))
    fixes = t.table("labels").filter(F.col("quality") == 0).select(
        text("doc_id").alias("filepath"), F.when(F.col("toxic") == 1, "narrative_document").otherwise("structured_document").alias("class_name"))
    return G.repair_classes(classes, fixes, "filepath", "source_doc", "class_name").select("filepath", "class_name")


INHERITED = LINEAGE + f""",
inherited AS (
  SELECT l.filepath, l.source_doc, {SOURCE_LABEL.format('r.source')} AS invoice_label,
    CASE WHEN l.source NOT LIKE 'synthetic%' THEN l.source WHEN {SOURCE_LABEL.format('r.source')} = 1 THEN 'synthetic_hard_pos' ELSE 'synthetic_hard_neg' END AS source
  FROM lineage l JOIN lineage r ON r.filepath = l.source_doc)"""


def labelled_lineage(t):
    """The lineage view with labels: roots by source, copies not yet known."""
    derived = F.col("source").startswith("synthetic_")
    return t.lineage().withColumn("invoice_label", F.when(~derived, map_label("source", on_unknown="null")))


def inherited(t):
    return G.inherit_label(labelled_lineage(t), "filepath", "source_doc", "invoice_label", "source")


@query("C3", f"WITH {INHERITED} SELECT filepath, source, invoice_label FROM inherited")
def inherit_from_root(t):
    return inherited(t).select("filepath", "source", "invoice_label")


@query("C4", f"""WITH {SPLIT_EXAMPLES} SELECT id, split, (substr(source, 4)::INT < 10)::INT AS invoice_label FROM split_examples""")
def refresh_copied_labels(t):
    splits = t.split_examples().select("id", "split", "invoice_label")
    repaired = t.examples().select("id", map_label("source", SOURCE_MAP).alias("invoice_label"))
    return G.refresh_labels(splits, repaired, "id", "invoice_label")


@query("C5", f"WITH {EXAMPLES} SELECT id, source FROM examples WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def mined_semi_join(t):
    mined = t.table("labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return G.listed(t.examples().select("id", "source"), mined, "id")


LATE = "substr(source, 4)::INT >= 10"


def early_and_late(t):
    number = F.expr("substring(source, 4)").cast("int")
    rows = t.examples().select("id", "source", "source_doc")
    return rows.filter(number < 10), rows.filter(number >= 10)


@query("C6", f"""WITH {EXAMPLES} SELECT id, source_doc FROM examples WHERE NOT ({LATE})
  AND source_doc NOT IN (SELECT source_doc FROM examples WHERE {LATE})""")
def exclude_known_content(t):
    early, late = early_and_late(t)
    return G.exclude_content(early, late, "source_doc").select("id", "source_doc")


@query("C6", f"""WITH {EXAMPLES}, known AS (SELECT DISTINCT source_doc FROM examples WHERE {LATE})
SELECT count(*) FILTER (k.source_doc IS NULL) AS kept, count(*) FILTER (k.source_doc IS NOT NULL) AS excluded
FROM examples e LEFT JOIN known k ON k.source_doc = e.source_doc WHERE NOT ({LATE})""")
def known_content_counts(t):
    return G.content_overlap(*early_and_late(t), "source_doc")


@query("C7", f"""WITH {SPLIT_EXAMPLES} SELECT id, split FROM split_examples
WHERE split <> 'train' OR id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def keep_selected_train(t):
    chosen = t.table("labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return G.keep_selected(t.split_examples().select("id", "split"), chosen, "id")


@query("C8, T14", f"WITH {SCORED} SELECT id, y, direct AS score_a, router AS score_b FROM scored")
def pair_two_models(t):
    scored = t.scored()
    return G.pair_models(scored.select("id", "y", F.col("direct").alias("s")), scored.select("id", F.col("router").alias("s")), "id", "s")


@query("C9", f"""WITH {SCORED}, grid AS (SELECT (i / 4.0)::DOUBLE AS alpha FROM range(5) t(i)),
fused AS (SELECT alpha, y, round({FUSED_SQL.format(a='alpha')}, 9) AS score FROM scored, grid),
cut AS (SELECT alpha, list_sort(list(score))[(count(*) - ceil(0.9::DOUBLE * count(*)) + 1)::INT] AS threshold FROM fused WHERE y = 1 GROUP BY alpha)
SELECT f.alpha, c.threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp
FROM fused f JOIN cut c ON c.alpha = f.alpha GROUP BY f.alpha, c.threshold""")
def scores_by_grid(t):
    return fusion_grid(t.scored(), "y", "direct", "class_bill", 0.9, steps=5, digits=9).select("alpha", "threshold", "tp", "fp")


@query("C10, A8", """SELECT DISTINCT lang || '_' || source || '.csv' AS filepath FROM documents
WHERE lang || '_' || source NOT IN (SELECT lang || '_' || source FROM documents WHERE n_chars >= 3000)""")
def manifest_without_files(t):
    # The manifest expects a folder per language and source; only long documents are written.
    path = fresh_path(t.spark, "present")
    rows = t.documents().select("doc_id", F.concat_ws("_", "lang", "source").alias("folder"), "n_chars")
    rows.filter(F.col("n_chars") >= 3000).select("doc_id", "folder").write.partitionBy("folder").csv(path)
    name = F.concat(F.regexp_extract("path", "folder=([^/]+)/", 1), F.lit(".csv"))
    listing = scan_files(t.spark, path, (".csv",), recursive=True).select(name.alias("filepath")).distinct()
    wanted = rows.select(F.concat("folder", F.lit(".csv")).alias("filepath")).distinct()
    return G.missing_files(wanted, listing, "filepath")


@query("H1", f"""WITH {EXAMPLES} SELECT 'a/' || id AS filepath, source FROM examples
UNION ALL SELECT 'b/' || page_id, 'page' FROM pages""")
def concatenated_manifests(t):
    a = t.examples().select(F.concat(F.lit("a/"), text("id")).alias("filepath"), "source")
    b = t.table("pages").select(F.concat(F.lit("b/"), text("page_id")).alias("filepath"), F.lit("page").alias("source"))
    return M.concat_unique(a, b, key="filepath")


@query("H2", f"""WITH {EXAMPLES} SELECT source_doc FROM examples WHERE NOT ({LATE}) INTERSECT SELECT source_doc FROM examples WHERE {LATE}""")
def content_in_both(t):
    return M.overlap(*early_and_late(t), "source_doc")


@query("H2", "SELECT page_id + 1000000000 AS id FROM pages")
def disjoint_additions(t):
    return M.assert_disjoint(t.examples().select("id"), t.table("pages").select((F.col("page_id") + 1000000000).alias("id")), "id")


@query("H3", f"""WITH {SPLIT_EXAMPLES} SELECT 'base/' || id AS filepath, split, source_doc FROM split_examples
UNION ALL SELECT 'mined/' || id, split, source_doc FROM split_examples WHERE split = 'train'""")
def add_mined_train(t):
    rows = t.split_examples()
    named = lambda p: rows.withColumn("filepath", F.concat(F.lit(p), text("id")))
    mined = named("mined/").withColumn("selection", F.when(F.col("split") == "train", "category_top_score").otherwise("external_holdout"))
    return M.add_train_only(named("base/"), mined, "filepath", ["filepath", "split", "source_doc"])


@query("H4", """SELECT doc_id::VARCHAR AS filepath, source, lang AS predicted_class, NULL::VARCHAR AS forced_split FROM documents
UNION ALL SELECT url, 'target_hard_negative', 'user_labeled_non_bill', 'train' FROM pages""")
def one_shape(t):
    shape = ["filepath", "source", "predicted_class", "forced_split"]
    documents = (t.documents(), {"filepath": text("doc_id"), "predicted_class": F.col("lang"), "forced_split": F.lit(None).cast("string")})
    pages = (t.table("pages"), {"filepath": F.col("url"), "source": "target_hard_negative", "predicted_class": "user_labeled_non_bill", "forced_split": "train"})
    return M.union_conformed(shape, documents, pages)


@query("H5", "SELECT count(*) AS rows_before, count(*) AS rows_after, 1 AS preserved FROM documents")
def rows_preserved(t):
    return M.row_counts(t.documents().select("doc_id"), inherited(t))


@query("H5", "SELECT doc_id, lower(lang) AS lang FROM documents")
def rows_preserved_in_one_pass(t):
    """Rows are counted while they pass, not by a second scan."""
    return M.transform_preserving(t.documents().select("doc_id", "lang"), lambda rows: rows.withColumn("lang", F.lower("lang")))
