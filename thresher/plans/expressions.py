"""Projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from thresher.fixed_values import JPEG_MAGIC, PNG_MAGIC, UI_CONTEXTS
from thresher.functions import labels as L, scores as S
from thresher.functions.hashing import digest, hash_choice, seeded, short_name
from thresher.functions.text import basename, clean_utf8, nested_text, sniff_type, stem, text_eligible
from thresher.operators.lineage import derive_class, override
from thresher.operators.ordering import attach_reference
from thresher.plans.registry import query
from thresher.plans.views import EXAMPLES, LINEAGE, NESTED_TEXT, SCORED, SCORED_BIG, SOURCE_LABEL

SOURCE_MAP = {f"src{i}": int(i < 10) for i in range(20)}
SOURCE_MAP_SQL = "(substr(source, 4)::INT < 10)::INT"


@query("B1", f"WITH {EXAMPLES} SELECT id, source, {SOURCE_MAP_SQL} AS label FROM examples")
def map_source_label(t):
    return t.examples().select("id", "source", L.map_label("source", SOURCE_MAP).alias("label"))


@query("B2", f"WITH {LINEAGE} SELECT filepath, {SOURCE_LABEL.format('source')} AS label, (predicted_class = 'en')::INT AS teacher "
             "FROM lineage WHERE source NOT LIKE 'synthetic%'")
def teacher_beside_truth(t):
    real = t.lineage().filter(~F.col("source").startswith("synthetic"))
    return real.select("filepath", L.map_label("source").alias("label"), L.teacher_flag("predicted_class", "en").alias("teacher"))


TYPE_FAMILIES = {"narrative_document": ("medium", "large"), "advertisement_presentation": ("promo",), "text_scene": ("economy",)}


@query("B3", """SELECT p_partkey, CASE WHEN lower(trim(replace(p_type, '_', ' '))) IN ('medium', 'large') THEN 'narrative_document'
  WHEN lower(trim(p_type)) = 'promo' THEN 'advertisement_presentation' WHEN lower(trim(p_type)) = 'economy' THEN 'text_scene'
  ELSE 'structured_document' END AS family FROM part""")
def label_family(t):
    return t.table("part").select("p_partkey", L.taxonomy("p_type", TYPE_FAMILIES).alias("family"))


@query("B4", f"""WITH {LINEAGE},
labelled AS (SELECT l.*, CASE WHEN r.source IN ('cord_receipts', 'sroie_receipts', 'rvlcdip_invoice') THEN 1 ELSE 0 END AS invoice_label,
    r.source AS root_source, r.predicted_class AS root_class
  FROM lineage l JOIN lineage r ON r.filepath = l.source_doc)
SELECT filepath, CASE WHEN invoice_label = 1 THEN CASE WHEN source = 'cord_receipts' THEN 'receipt' ELSE 'invoice' END
  WHEN root_source = 'coco_photos' THEN 'natural_photo' ELSE 'structured_document' END AS class_name FROM labelled""")
def derive_classes(t):
    rows = t.stored(t.lineage())
    roots = rows.filter(~F.col("source").startswith("synthetic_"))
    labelled = attach_reference(rows, roots.select("filepath", L.map_label("source").alias("invoice_label")), "source_doc",
                                ["invoice_label"], "filepath")
    return derive_class(labelled).select("filepath", "class_name")


@query("B5", f"WITH {SCORED} SELECT id, (class_index IN (0, 1))::INT AS bill FROM scored")
def bill_flag(t):
    return t.scored().select("id", L.bill_label("class_index").alias("bill"))


@query("B6", """SELECT doc_id, (list_position(['en', 'fr', 'de', 'es'], lang) - 1)::INT AS class_index FROM documents""")
def class_index(t):
    return t.documents().select("doc_id", L.class_position("lang", ("en", "fr", "de", "es")).alias("class_index"))


@query("B7", """SELECT page_id, CASE WHEN url LIKE 'https://m.%' OR url LIKE 'http://m.%' THEN 'screenshot' ELSE 'direct' END AS context FROM pages""")
def context_of_path(t):
    prefixes = ("https://m.", "http://m.")
    return t.table("pages").select("page_id", L.capture_context("url", prefixes).alias("context"))


@query("B8", f"WITH {SCORED} SELECT s.id, coalesce(l.toxic, s.class_index)::INT AS class_index FROM scored s LEFT JOIN labels l ON l.doc_id = s.id")
def manual_override(t):
    table = t.table("labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("class_index"))
    return override(t.scored().select("id", "class_index"), table, "id", "class_index").select("id", F.col("class_index").cast("int"))


@query("B9", "SELECT p.page_id, CASE WHEN url LIKE 'https://%' THEN 'train' ELSE 'test' END AS split FROM pages p")
def forced_prefix(t):
    return t.table("pages").select("page_id", L.force_prefix(F.lit("test"), "url", "https://").alias("split"))


@query("B10", """SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS source_doc,
  'screenshot:' || l_shipmode || ':' || l_orderkey AS copy_doc FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)""")
def composite_keys(t):
    return t.table("lineitem").select(
        L.lineage_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("source_doc"),
        L.lineage_key(F.lit("screenshot"), "l_returnflag", "l_orderkey").alias("copy_doc"))


@query("B11", f"WITH {NESTED_TEXT} SELECT image_id, text FROM nested_texts")
def annotation_text(t):
    return t.nested().select("image_id", nested_text("paragraphs").alias("text"))


@query("B12, T15", r"""SELECT doc_id FROM documents
WHERE CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END >= 20
  AND NOT (contains(text, 'and') OR contains(text, 'que'))""")
def eligible_text(t):
    return t.documents().filter(text_eligible("text", 20, ("and", "que"))).select("doc_id")


@query("B13", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'system')")
def required_categories(t):
    return t.table("conversations").filter(F.col("role").isin("user", "system")).select("conv_id", "turn")


@query("B14", """SELECT conv_id, turn, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 END::INT AS class_index,
  CASE role WHEN 'user' THEN 'structured_document' WHEN 'assistant' THEN 'narrative_document' END AS class_name FROM conversations""")
def category_class(t):
    mapping = {"user": (2, "structured_document"), "assistant": (3, "narrative_document")}
    return t.table("conversations").select("conv_id", "turn", L.page_class("role", mapping).alias("c")).select("conv_id", "turn", "c.*")


@query("B15", f"WITH {EXAMPLES} SELECT id FROM examples WHERE category <> 'en'")
def excluded_label(t):
    return t.examples().filter(F.col("category") != "en").select("id")


@query("B16", """SELECT lang, CASE lang WHEN 'en' THEN 'png' WHEN 'fr' THEN 'jpg' WHEN 'de' THEN 'raw' END AS type, count(*) AS n
FROM documents GROUP BY ALL""")
def content_type(t):
    body = F.encode("text", "UTF-8")
    lead = lambda magic: F.concat(F.unhex(F.lit(magic)), body)
    content = F.when(F.col("lang") == "en", lead(PNG_MAGIC)).when(F.col("lang") == "fr", lead(JPEG_MAGIC)).otherwise(body)
    sized = t.documents().select("lang", content.alias("content"), F.octet_length(body).alias("bytes"))
    # Spanish rows claim four channels, which their length does not bear out.
    channels = F.when(F.col("lang") == "de", 1).otherwise(4)
    return sized.select("lang", sniff_type("content", "bytes", F.lit(1), channels).alias("type")).groupBy("lang", "type").agg(
        F.count(F.lit(1)).alias("n"))


@query("B17", "SELECT doc_id, sha256(text || chr(65533) || lang) AS digest FROM documents")
def decoded_bytes(t):
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("00FF")), F.encode("lang", "UTF-8"))
    return t.documents().select("doc_id", raw.alias("raw")).select("doc_id", F.sha2(clean_utf8("raw"), 256).alias("digest"))


@query("B18", r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file,
  CASE WHEN regexp_extract(url, '([^/]*)$', 1) ~ '^.+\..*$' THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')
    ELSE regexp_extract(url, '([^/]*)$', 1) END AS stem FROM pages""")
def path_names(t):
    return t.table("pages").select("page_id", basename("url").alias("file"), stem("url").alias("stem"))


@query("B19", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(t):
    return t.documents().select("doc_id", digest("text").alias("digest"))


@query("B20", """SELECT doc_id, 'img_' || substr(sha256(text), 1, 16) AS n16, 'page_' || substr(sha256(text), 1, 20) AS n20,
  substr(sha256(text), 1, 24) AS n24 FROM documents""")
def short_names(t):
    return t.documents().select("doc_id", short_name("img_", "text", 16).alias("n16"), short_name("page_", "text", 20).alias("n20"),
                                short_name("", "text", 24).alias("n24"))


LOGIT_SQL = "ln(greatest(1e-6::DOUBLE, least(1.0::DOUBLE - 1e-6::DOUBLE, {0})) / (1.0::DOUBLE - greatest(1e-6::DOUBLE, least(1.0::DOUBLE - 1e-6::DOUBLE, {0}))))"


@query("B21", f"""WITH {SCORED} SELECT id, round({LOGIT_SQL.format('direct')}, 9) AS logit,
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-{LOGIT_SQL.format('direct')})), 9) AS back FROM scored""")
def logit_and_back(t):
    return t.scored().select("id", F.round(S.logit("direct"), 9).alias("logit"), F.round(S.sigmoid(S.logit("direct")), 9).alias("back"))


FUSED_SQL = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({{a}} * {LOGIT_SQL.format('direct')} + (1.0::DOUBLE - {{a}}) * {LOGIT_SQL.format('class_bill')})))"


@query("B22, T1", f"WITH {SCORED} SELECT id, round({FUSED_SQL.format(a='0.8::DOUBLE')}, 9) AS fused FROM scored")
def fusion_in_logit_space(t):
    return t.scored().select("id", F.round(S.fuse_logit("direct", "class_bill", 0.8), 9).alias("fused"))


@query("B23, T1", f"WITH {SCORED} SELECT id, 0.8::DOUBLE * direct + 0.2::DOUBLE * class_bill AS fused FROM scored")
def fusion_linear(t):
    return t.scored().select("id", S.fuse_linear("direct", "class_bill").alias("fused"))


@query("B24", """SELECT vec_id, embedding[1]::DOUBLE + embedding[2]::DOUBLE AS bill,
  (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings""")
def vector_scores(t):
    return t.table("embeddings").select("vec_id", S.bill_probability("embedding").alias("bill"), S.argmax_class("embedding").alias("best"))


@query("B25", f"WITH {SCORED_BIG} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (s1 >= 0.5)::INT AS said FROM scored_big")
def decision(t):
    return t.scored_big().select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.decide("s1", 0.5).alias("said"))


@query("B26, T5", f"""WITH {SCORED} SELECT id, (direct >= 0.5 AND class_bill >= 0.45)::INT AS said,
  CASE WHEN direct >= 0.5 THEN class_bill ELSE -1.0 END::DOUBLE AS masked, direct * class_bill AS product FROM scored""")
def cascade(t):
    return t.scored().select(
        "id", S.cascade_decision("direct", 0.5, "class_bill", 0.45).alias("said"),
        S.cascade_score("direct", 0.5, "class_bill").alias("masked"), S.cascade_score("direct", 0.5, "class_bill", "product").alias("product"))


@query("B27", f"""WITH {SCORED} SELECT id, CASE WHEN router >= 0.55 THEN 1 WHEN router >= 0.45 THEN (direct >= 0.5)::INT ELSE 0 END::INT AS predicted,
  (router >= 0.45 AND router < 0.55)::INT AS uncertain FROM scored""")
def two_threshold_route(t):
    predicted, uncertain = S.route("router", "direct", 0.45, 0.55, 0.5)
    return t.scored().select("id", predicted.cast("int").alias("predicted"), uncertain.alias("uncertain"))


@query("B28", f"""WITH {SCORED_BIG} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN split <> 'train' THEN 'external_holdout'
  WHEN s1 >= 0.9 THEN 'baseline_false_positive' ELSE 'category_top_score' END AS selection FROM scored_big""")
def selection_flag(t):
    return t.scored_big().select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.mined_flag("s1", 0.9, "split").alias("selection"))


@query("G11", f"""SELECT doc_id, list_extract(['gallery', 'pdf_viewer', 'email_attachment', 'chat_attachment'],
  (('0x' || substr(sha256('20260820:train:' || doc_id), 17, 8))::BIGINT % 4 + 1)::INT) AS context FROM documents""")
def deterministic_context(t):
    return t.documents().select("doc_id", hash_choice(seeded(20260820, F.lit("train"), "doc_id"), UI_CONTEXTS).alias("context"))
