"""Manifests assembled from several operators, as the curation steps publish them."""

from pyspark.sql import functions as F

from thresher.fixed_values import CLASS_NAMES, FIELDS, UI_CONTEXTS
from thresher.functions import labels as L
from thresher.functions.hashing import hash_choice, seeded, short_name, split_70_15_15, split_80_10_10
from thresher.functions.text import nested_text, text_eligible
from thresher.operators import lineage as G, manifests as M, metrics as D, ranking as E, sampling as P
from thresher.operators.ordering import guard
from thresher.plans.registry import query
from thresher.plans.views import DOC_PAGES, LINEAGE, NESTED_TEXT, SCORED, number_sql, split_10_sql, text

PAGE_MAP = {"user": (2, "structured_document"), "assistant": (3, "narrative_document"), "system": (3, "narrative_document")}


@query("E5, B13, B14, B18, B20, D23", f"""WITH {DOC_PAGES},
dealt AS (SELECT *, row_number() OVER (PARTITION BY category, doc_name ORDER BY sha256('20260820:' || category || ':' || doc_name || ':' || page_no), page_no) AS page_rank FROM doc_pages WHERE category IN ('user', 'assistant')),
picked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page_rank, sha256('20260820:' || category || ':' || doc_name), doc_name) AS pick FROM dealt WHERE page_rank <= 2)
SELECT 'page_train_' || substr(sha256('train:' || category || ':' || doc_name || ':' || page_no), 1, 20) || '.png' AS filepath, 'train' AS split,
  'doc:' || doc_name AS source_doc, CASE category WHEN 'user' THEN 2 ELSE 3 END::INT AS class_index,
  CASE category WHEN 'user' THEN 'structured_document' ELSE 'narrative_document' END AS class_name, 0 AS bill_label, category AS doc_category, doc_name, page_no
FROM picked WHERE pick <= 100""")
def page_manifest(t):
    """Document pages dealt evenly over documents, with class, identity name and lineage."""
    pages = t.doc_pages().filter(F.col("category").isin("user", "assistant"))
    picked = E.round_robin(pages, "category", "doc_name", "page_no", 2, 100, 20260820)
    identity = L.lineage_key(F.lit("train"), "category", "doc_name", "page_no")
    return picked.select(
        F.concat(short_name("page_train_", identity, 20), F.lit(".png")).alias("filepath"), F.lit("train").alias("split"),
        L.lineage_key(F.lit("doc"), "doc_name").alias("source_doc"), L.page_class("category", PAGE_MAP).alias("c"), F.lit(0).alias("bill_label"),
        F.col("category").alias("doc_category"), "doc_name", "page_no").select(
        "filepath", "split", "source_doc", "c.class_index", "c.class_name", "bill_label", "doc_category", "doc_name", "page_no")


GROUP_SPLIT = f"""placed AS (SELECT *, {split_10_sql('source_doc')} AS split, predicted_class = 'en' AS bill FROM lineage)"""


@query("E6, D14, G11, B5, B20", f"""WITH {LINEAGE}, {GROUP_SPLIT},
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, source_doc ORDER BY filepath <> source_doc, contains(source, 'syn_hard_neg'), filepath) AS place FROM placed WHERE bill) WHERE place = 1)
SELECT 'shot/' || substr(sha256('20260820:' || split || ':' || source_doc), 1, 24) || '.jpg' AS filepath, split, filepath AS parent_filepath, source_doc,
  list_extract(['gallery', 'pdf_viewer', 'email_attachment', 'chat_attachment'], ({number_sql("'20260820:' || split || ':' || source_doc", 17, 8)} % 4 + 1)::INT) AS context FROM chosen""")
def screenshot_positive_manifest(t):
    """One representative per bill source with its context; a source in two splits fails."""
    bills = t.stored(t.lineage()).withColumn("split", split_80_10_10("source_doc")).filter(F.col("predicted_class") == "en")
    prefer = [F.col("filepath") != F.col("source_doc"), F.col("source").contains("syn_hard_neg")]
    chosen = E.representative(bills, ["split", "source_doc"], prefer, "filepath")
    leaked = D.leaks(bills, "source_doc", "split").agg(F.count(F.lit(1)).alias("n"))
    identity = seeded(20260820, "split", "source_doc")
    named = chosen.select(
        F.concat(short_name("shot/", identity, 24), F.lit(".jpg")).alias("filepath"), "split", F.col("filepath").alias("parent_filepath"),
        "source_doc", hash_choice(identity, UI_CONTEXTS).alias("context"))
    return guard(named, leaked, "bill sources cross splits")


@query("E4, B11, B12, B15, B19, B20, G1, G8", f"""WITH {NESTED_TEXT},
classed AS (SELECT 'neg_' || lang || '_' || substr(sha256(text), 1, 16) AS name, 'targeted_' || lang AS source, 'class:' || lang || ':' || substr(sha256(text), 1, 16) AS source_doc,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents WHERE lang IN ('en', 'fr', 'de')),
eligible AS (SELECT image_id FROM nested_texts WHERE NOT contains(text, 'and') AND NOT contains(text, 'que')
  AND CASE WHEN trim(text) = '' THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) END >= 20),
scenes AS (SELECT image_id, 'scene:' || image_id AS source_doc FROM eligible ORDER BY sha256('42:' || image_id) LIMIT 20)
SELECT name || '.jpg' AS filepath, source, {split_10_sql('source_doc')} AS split, source_doc FROM classed WHERE place <= 50
UNION ALL SELECT 'scene/' || image_id || '.jpg', 'text_scene', {split_10_sql('source_doc')}, source_doc FROM scenes""")
def public_negative_manifest(t):
    """The first rows of each targeted class and a seeded sample of eligible scenes."""
    rows = t.documents().filter(F.col("lang") != "es").select("doc_id", "lang", short_name("", "text", 16).alias("name"))
    classed = E.first_per_key(rows, "lang", "doc_id", 50).select(
        F.concat(F.lit("neg_"), "lang", F.lit("_"), "name", F.lit(".jpg")).alias("filepath"), F.concat(F.lit("targeted_"), "lang").alias("source"),
        L.lineage_key(F.lit("class"), "lang", "name").alias("source_doc"))
    texts = t.nested().select("image_id", nested_text("paragraphs").alias("text"))
    eligible = texts.filter(text_eligible("text", 20, ("and", "que"))).select("image_id")
    scenes = P.seeded_sample(eligible, 20, "image_id", 42).select(
        F.concat(F.lit("scene/"), "image_id", F.lit(".jpg")).alias("filepath"), F.lit("text_scene").alias("source"),
        L.lineage_key(F.lit("scene"), "image_id").alias("source_doc"))
    whole = classed.unionByName(scenes).withColumn("split", split_80_10_10("source_doc"))
    return whole.select(*FIELDS["public_negatives"])


@query("B3, B6, B9, C1, C2, H5", f"""WITH {LINEAGE}, {GROUP_SPLIT},
classes AS (SELECT *, CASE WHEN predicted_class IN ('en', 'fr') THEN 'invoice' WHEN predicted_class = 'de' THEN 'structured_document' ELSE 'natural_photo' END AS class_name FROM placed),
fixes AS (SELECT doc_id::VARCHAR AS f, CASE WHEN toxic = 1 THEN 'narrative_document' ELSE 'structured_document' END AS fix FROM labels WHERE quality = 0),
fixed AS (SELECT c.*, CASE WHEN class_name = 'invoice' THEN coalesce(o.fix, r.fix, class_name) ELSE class_name END AS final FROM classes c
  LEFT JOIN fixes o ON o.f = c.filepath LEFT JOIN fixes r ON r.f = c.source_doc)
SELECT filepath, CASE final WHEN 'invoice' THEN 1 WHEN 'structured_document' THEN 2 WHEN 'narrative_document' THEN 3 ELSE 6 END::INT AS class_index, final AS class_name,
  CASE WHEN filepath LIKE '1%' THEN 'train' ELSE split END AS split, source_doc FROM fixed""")
def aligned_class_splits(t):
    """Classes attached to an unchanged split, repaired along lineage, one prefix forced to train."""
    manifest = t.stored(t.lineage())
    splits = manifest.select("filepath", "source_doc", L.force_prefix(split_80_10_10("source_doc"), "filepath", "1").alias("split"))
    named = F.when(F.col("predicted_class").isin("en", "fr"), "invoice").when(F.col("predicted_class") == "de", "structured_document").otherwise("natural_photo")
    classed = G.lookup(splits, manifest.select("filepath", named.alias("class_name")), "filepath", "class_name")
    fixes = t.table("labels").filter(F.col("quality") == 0).select(
        text("doc_id").alias("filepath"), L.taxonomy(F.when(F.col("toxic") == 1, "memo").otherwise("form")).alias("class_name"))
    fixed = t.stored(G.repair_classes(classed, fixes, "filepath", "source_doc", "class_name"))
    checked = M.preserve_count(splits, fixed)
    return checked.withColumn("class_index", L.class_position("class_name")).select(*FIELDS["class_splits"])


FAMILY_SQL = "CASE " + " ".join(f"WHEN fix IN ({', '.join(repr(m) for m in members)}) THEN '{family}'" for family, members in L.FAMILIES_WITH_SCENES.items()) + f" ELSE '{L.DEFAULT_FAMILY}' END"


@query("C2, B8", f"""WITH {LINEAGE}, taught AS (SELECT filepath, CASE WHEN filepath LIKE '%7' THEN ' Memo' WHEN filepath LIKE '%3' THEN 'form' ELSE 'Invoice' END AS predicted
  FROM lineage WHERE source = 'rvlcdip_invoice'),
fixes AS (SELECT t.filepath, coalesce(CASE WHEN l.quality = 0 THEN CASE WHEN l.toxic = 1 THEN 'memo' ELSE 'form' END END,
  CASE WHEN lower(trim(predicted)) <> 'invoice' THEN lower(trim(predicted)) END) AS fix FROM taught t LEFT JOIN labels l ON l.doc_id::VARCHAR = t.filepath)
SELECT filepath, {FAMILY_SQL} AS class_name FROM fixes WHERE fix IS NOT NULL""")
def derived_fixes(t):
    """Class fixes of one source: reviewed labels first, then the teacher's disagreement."""
    path = F.col("filepath")
    taught = F.when(path.endswith("7"), " Memo\t").when(path.endswith("3"), "form").otherwise("Invoice")
    reviewed = t.table("labels").filter(F.col("quality") == 0).select(
        text("doc_id").alias("filepath"), F.when(F.col("toxic") == 1, "memo").otherwise("form").alias("label"))
    return G.derive_fixes(t.lineage().withColumn("predicted_class", taught), reviewed, "rvlcdip_invoice", "invoice")


@query("E3, C7, B10, H1, G2", f"""WITH {SCORED}, shots AS (SELECT id, direct, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT id, direct, {number_sql('id::VARCHAR')} % 100 AS b FROM scored)),
train AS (SELECT * FROM shots WHERE split = 'train'), hard AS (SELECT id FROM train ORDER BY direct DESC, id LIMIT 45),
easy AS (SELECT id FROM train WHERE id NOT IN (SELECT id FROM hard) ORDER BY sha256('20260820:' || id), id LIMIT 5)
SELECT 'base/' || doc_id AS filepath, 2 AS class_index, 'structured_document' AS class_name, 'train' AS split, 'base:' || doc_id AS source_doc FROM documents
UNION ALL SELECT 'shot/' || id, 4, 'advertisement_presentation', split, 'shots:shard:' || id || ':0' FROM shots WHERE split <> 'train' OR id IN (SELECT id FROM hard UNION ALL SELECT id FROM easy)""")
def screenshot_training_splits(t):
    """Base rows plus the hardest and a few random train screenshots and all held-out ones."""
    shots = t.scored().select("id", "direct").withColumn("split", split_70_15_15(text("id")))
    chosen = E.hard_plus_random(shots.filter(F.col("split") == "train"), 50, 5, "direct", "id", 20260820)
    kept = G.keep_selected(shots, t.stored(chosen.select("id", "part")), "id")
    fields = FIELDS["class_splits"]
    base = M.conform(t.documents(), fields, {
        "filepath": F.concat(F.lit("base/"), text("doc_id")), "class_index": 2, "class_name": CLASS_NAMES[2], "split": "train",
        "source_doc": L.lineage_key(F.lit("base"), "doc_id")})
    added = M.conform(kept, fields, {
        "filepath": F.concat(F.lit("shot/"), text("id")), "class_index": 4, "class_name": CLASS_NAMES[4],
        "source_doc": L.lineage_key(F.lit("shots"), F.lit("shard"), "id", F.lit(0))})
    return M.concat_unique(base, added, key="filepath")
