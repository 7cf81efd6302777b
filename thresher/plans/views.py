"""The views queries bind to, as DataFrames and as SQL common table expressions.

All of them are row-level projections of the given tables, except `lineage`, which
needs the first document of every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.functions.hashing import split_70_15_15, split_80_10_10
from thresher.functions.scores import argmax_class
from thresher.operators.ordering import attach
from thresher.session import pinned

BIG_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def text(column):
    return F.col(column).cast("string")


class Tables:
    """The tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name) -> str:
        return f"{self.folder}/{name}.parquet"

    def stored(self, df: DataFrame) -> DataFrame:
        """A manifest between two steps, written once and read by both."""
        return pinned(df)

    def documents(self) -> DataFrame:
        return self.table("documents")

    def examples(self) -> DataFrame:
        """Documents as a labelled manifest; exact copies share a source_doc."""
        labels = self.table("labels").select("doc_id", F.col("quality").alias("invoice_label"))
        # The digest is taken before the join, so that no text is shuffled.
        rows = self.documents().select("doc_id", "source", "lang", F.sha2("text", 256).alias("source_doc"))
        return rows.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"), "source", F.col("lang").alias("category"), "invoice_label", "source_doc")

    def split_examples(self) -> DataFrame:
        """Examples with the 80/10/10 split of their lineage group."""
        return self.examples().withColumn("split", split_80_10_10("source_doc"))

    def scored(self) -> DataFrame:
        """Embeddings as a score table of three models."""
        score = lambda i: (F.element_at("embedding", i).cast("double") + 1.0) / 2.0
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("label").alias("class_index"),
            F.col("label").isin(0, 1).cast("int").alias("y"),
            score(1).alias("direct"), score(2).alias("class_bill"), score(3).alias("router"),
            argmax_class(F.slice("embedding", 1, 10)).alias("predicted_class"),
            split_80_10_10(text("vec_id")).alias("split"))

    def scored_big(self) -> DataFrame:
        """Line items as a score table with heavy ties."""
        return self.table("lineitem").select(
            *BIG_ID, (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("s1"),
            (F.col("l_discount") * 10).alias("s2"), F.col("l_returnflag").alias("category"),
            split_80_10_10(text("l_orderkey")).alias("split"))

    def doc_pages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("role").alias("category"), F.col("conv_id").alias("doc_name"), F.col("turn").alias("page_no"))

    def nested(self) -> DataFrame:
        """One annotation record per message: a paragraph per line of text.

        Even paragraphs carry their text on the line, odd ones on its words.
        """
        pieces = F.filter(F.split("text", "\n"), lambda p: p != "")
        word = lambda w: F.struct(w.alias("text"))
        whole = lambda p: F.struct(p.alias("text"), F.array().cast("array<struct<text:string>>").alias("words"))
        apart = lambda p: F.struct(F.lit(None).cast("string").alias("text"), F.transform(F.split(p, " "), word).alias("words"))
        line = lambda p, i: F.when(i % 2 == 0, whole(p)).otherwise(apart(p))
        paragraphs = F.transform(pieces, lambda p, i: F.struct(F.array(line(p, i)).alias("lines")))
        return self.table("conversations").select(
            F.concat_ws(":", text("conv_id"), text("turn")).alias("image_id"), paragraphs.alias("paragraphs"))

    def arrivals(self, events=None) -> DataFrame:
        """Events as arriving records; also over a stream of events."""
        return (self.table("events") if events is None else events).select(
            "event_id", F.col("ts").alias("arrived"), F.col("user_id").alias("episode"),
            F.col("event_type").alias("source_object"),
            F.sha2(F.concat_ws("|", text("user_id"), "event_type"), 256).alias("digest"), F.col("props").alias("payload"),
            split_70_15_15(text("user_id")).alias("split"))

    def lineage(self) -> DataFrame:
        """Documents as a manifest in which later copies of a text derive from the first.

        Roots keep a source of the label map (by language), copies are synthetic.
        """
        rows = self.documents().select(F.col("doc_id"), "lang", F.sha2("text", 256).alias("digest"))
        groups = rows.groupBy("digest").agg(F.min("doc_id").alias("root"), F.count(F.lit(1)).alias("size"))
        placed = attach(rows, groups, "digest", "size", ["root"])
        real = F.when(F.col("lang") == "en", "rvlcdip_invoice").when(F.col("lang") == "fr", "cord_receipts").when(
            F.col("lang") == "de", "rvlcdip_other").otherwise("coco_photos")
        return placed.select(
            text("doc_id").alias("filepath"),
            F.when(F.col("doc_id") == F.col("root"), real).otherwise("synthetic_hard_neg").alias("source"),
            F.col("lang").alias("predicted_class"), text("root").alias("source_doc"))


# --- the same views as SQL ----------------------------------------------------------


def number_sql(value, start=1, length=8):
    return f"('0x' || substr(sha256({value}), {start}, {length}))::BIGINT"


def split_10_sql(value):
    bucket = f"{number_sql(value)} % 10"
    return f"CASE WHEN {bucket} < 1 THEN 'val' WHEN {bucket} < 2 THEN 'test' ELSE 'train' END"


def split_100_sql(value):
    bucket = f"{number_sql(value)} % 100"
    return f"CASE WHEN {bucket} < 70 THEN 'train' WHEN {bucket} < 85 THEN 'val' ELSE 'test' END"


EXAMPLES = """examples AS (
  SELECT d.doc_id AS id, d.source, d.lang AS category, l.quality AS invoice_label, sha256(d.text) AS source_doc
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

SPLIT_EXAMPLES = EXAMPLES + f""",
split_examples AS (SELECT *, {split_10_sql('source_doc')} AS split FROM examples)"""

SCORED = f"""scored AS (
  SELECT vec_id AS id, label AS class_index, (label IN (0, 1))::INT AS y,
    (embedding[1]::DOUBLE + 1) / 2 AS direct, (embedding[2]::DOUBLE + 1) / 2 AS class_bill,
    (embedding[3]::DOUBLE + 1) / 2 AS router,
    (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INT AS predicted_class,
    {split_10_sql('vec_id::VARCHAR')} AS split
  FROM embeddings)"""

SCORED_BIG = f"""scored_big AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_returnflag = 'R')::INT AS y,
    l_quantity / 50 AS s1, l_discount * 10 AS s2, l_returnflag AS category,
    {split_10_sql('l_orderkey::VARCHAR')} AS split
  FROM lineitem)"""

DOC_PAGES = """doc_pages AS (SELECT role AS category, conv_id AS doc_name, turn AS page_no FROM conversations)"""

NESTED_TEXT = """nested_texts AS (
  SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS image_id,
    lower(array_to_string(list_filter(string_split(text, chr(10)), lambda p: p <> ''), ' ')) AS text
  FROM conversations)"""

ARRIVALS = f"""arrivals AS (
  SELECT event_id, ts AS arrived, user_id AS episode, event_type AS source_object,
    sha256(user_id::VARCHAR || '|' || event_type) AS digest, props AS payload,
    {split_100_sql('user_id::VARCHAR')} AS split
  FROM events)"""

LINEAGE = """lineage AS (
  SELECT doc_id::VARCHAR AS filepath,
    CASE WHEN doc_id <> root THEN 'synthetic_hard_neg' WHEN lang = 'en' THEN 'rvlcdip_invoice'
      WHEN lang = 'fr' THEN 'cord_receipts' WHEN lang = 'de' THEN 'rvlcdip_other' ELSE 'coco_photos' END AS source,
    lang AS predicted_class, root::VARCHAR AS source_doc
  FROM (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY sha256(text)) AS root FROM documents))"""

SOURCE_LABEL = "CASE WHEN {0} IN ('cord_receipts', 'sroie_receipts', 'rvlcdip_invoice') THEN 1 ELSE 0 END"


def confusion_sql(y, said, keys=""):
    """The columns of the confusion report over rows with `y` and `said` (SQL expressions)."""
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return lambda source: f"""
  SELECT {lead}n, positive, negative, tp, fn, fp, tn, tp / nullif(positive, 0)::DOUBLE AS recall,
    fp / nullif(negative, 0)::DOUBLE AS fpr, tp / nullif(tp + fp, 0)::DOUBLE AS precision,
    (tp + tn) / nullif(n, 0)::DOUBLE AS accuracy, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1
  FROM (SELECT {lead}count(*) AS n, count(*) FILTER ({y} = 1) AS positive, count(*) FILTER ({y} <> 1) AS negative,
      count(*) FILTER ({y} = 1 AND {said}) AS tp, count(*) FILTER ({y} = 1 AND NOT {said}) AS fn,
      count(*) FILTER ({y} <> 1 AND {said}) AS fp, count(*) FILTER ({y} <> 1 AND NOT {said}) AS tn
    FROM {source}{tail})"""


def auc_sql(source, y, score, keys=""):
    """The exact AUC by midranks."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    group = f"{lead}{score}"
    return f"""
  SELECT {lead}sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * sum(q)::DOUBLE, 0) AS auc
  FROM (SELECT {lead}p, q, coalesce(sum(q) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
    FROM (SELECT {lead}{score} AS s, count(*) FILTER ({y} = 1)::DOUBLE AS p, count(*) FILTER ({y} <> 1)::DOUBLE AS q
      FROM {source} GROUP BY {group})){tail}"""
