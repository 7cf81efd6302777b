"""Counts, metrics, weights, integrity reports."""

from pyspark.sql import functions as F

from thresher.fixed_values import (
    ROUTER_BALANCE_CAPS, ROUTER_FACTOR_CAP, ROUTER_FACTORS, V2_PREFIX_FACTORS, V2_WEIGHT_CAPS,
)
from thresher.functions.hashing import split_80_10_10
from thresher.functions.scores import cascade_score, decide, fuse_linear
from thresher.operators import fingerprints, metrics as D, points
from thresher.operators.lineage import pair_models
from thresher.plans.calibrating import curve_sql, recall_cut_sql
from thresher.plans.joining import LATE
from thresher.plans.registry import query
from thresher.session import fresh_path
from thresher.plans.views import (
    DOC_PAGES, EXAMPLES, SCORED, SCORED_BIG, SPLIT_EXAMPLES, auc_sql, confusion_sql, text,
)


@query("D1", f"WITH {SCORED} SELECT split, class_index, count(*) AS n FROM scored GROUP BY split, class_index")
def counts_by_split_and_class(t):
    return D.counts_by(t.scored(), ["split", "class_index"])


@query("D1", f"""WITH {SCORED_BIG} SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS counts
FROM (SELECT split || '/' || category AS k, count(*) AS n FROM scored_big GROUP BY ALL)""")
def counts_as_map(t):
    whole = D.counts_map(t.scored_big(), ["split", "category"])
    return whole.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("D2", f"""WITH {SPLIT_EXAMPLES} SELECT split, count(*) AS n, count(*) FILTER (invoice_label = 1) AS bills,
  count(*) FILTER (category = 'en') AS screenshots, count(*) FILTER (invoice_label = 1 AND category = 'en') AS screenshot_bills
FROM split_examples GROUP BY split""")
def conditional_counts(t):
    bill, shot = F.col("invoice_label") == 1, F.col("category") == "en"
    return D.conditional_counts(t.split_examples(), ["split"], {"bills": bill, "screenshots": shot, "screenshot_bills": bill & shot})


@query("D3", """SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agree, count(*) FILTER (quality <> toxic) AS disagree FROM labels""")
def teacher_agreement(t):
    return D.agreement(t.table("labels"), "quality", "toxic")


@query("D4", f"WITH {SCORED_BIG} {confusion_sql('y', 's1 >= 0.5', 'split, category')('scored_big')}")
def confusion_by_split_and_category(t):
    return D.confusion(t.scored_big().withColumn("said", decide("s1", 0.5)), "y", "said", ["split", "category"])


@query("D4, T4", f"""WITH {SCORED_BIG} SELECT c.*, round((SELECT auc FROM ({auc_sql('scored_big', 'y', 's2')})), 9) AS auc
FROM ({confusion_sql('y', 's2 >= 0.5')('scored_big')}) c""")
def classification_report(t):
    return D.classification(t.scored_big(), "y", "s2", 0.5).withColumn("auc", F.round("auc", 9))


@query("D5", f"WITH {SCORED_BIG} SELECT round(auc, 9) AS auc FROM ({auc_sql('scored_big', 'y', 's1')})")
def roc_area(t):
    return D.roc_auc(t.scored_big(), "y", "s1").select(F.round("auc", 9).alias("auc"))


@query("D5", f"WITH {SCORED_BIG} SELECT split, round(auc, 9) AS auc FROM ({auc_sql('scored_big', 'y', 's1', 'split')})")
def roc_area_by_split(t):
    return D.roc_auc(t.scored_big(), "y", "s1", ["split"]).select("split", F.round("auc", 9).alias("auc"))


@query("D6", f"WITH {SCORED_BIG}, {curve_sql('scored_big', 's1')} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, precision, recall FROM curve")
def precision_recall_curve(t):
    return D.pr_curve(t.scored_big(), "y", "s1")


@query("D7", f"""WITH {SCORED}, classes AS (SELECT class_index AS c FROM scored UNION SELECT predicted_class FROM scored),
cells AS (SELECT c, count(*) FILTER (class_index = c AND predicted_class = c) AS tp,
    count(*) FILTER ((class_index = c) <> (predicted_class = c)) AS miss FROM classes, scored GROUP BY c)
SELECT (SELECT count(*) FROM scored) AS n, (SELECT avg((class_index = predicted_class)::INT) FROM scored) AS accuracy,
  round(avg(2 * tp / nullif(2 * tp + miss, 0)::DOUBLE), 9) AS macro_f1 FROM cells""")
def multiclass_report(t):
    return D.multiclass_report(t.scored(), "class_index", "predicted_class").withColumn("macro_f1", F.round("macro_f1", 9))


def summary_sql(source, score, threshold, probabilities, keys="", tail="max"):
    lead, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    quantiles = ", ".join(f"round(quantile_cont({score}, {p}::DOUBLE), 9) AS p{int(round(p * 100)):02d}" for p in probabilities)
    return f"""SELECT {lead}count(*) AS n, count(*) FILTER ({score} >= {threshold}) AS at_or_over,
  count(*) FILTER ({score} >= {threshold}) / count(*)::DOUBLE AS rate, round(avg({score}), 9) AS mean, {quantiles}, {tail}({score}) AS {tail}
FROM {source}{group}"""


def rounded(df):
    exact = {"max", "min", "rate"}
    return df.select(*[F.round(f.name, 9).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in exact else F.col(f.name) for f in df.schema])


@query("D8", f"WITH {SCORED_BIG} {summary_sql('scored_big', 's1', 0.9, (0.5, 0.9, 0.95, 0.99), 'split')}")
def negative_score_summary(t):
    return rounded(D.score_summary(t.scored_big(), "s1", 0.9, ["split"]))


@query("D8", f"WITH {SCORED} {summary_sql('scored', 'direct', 0.55, (0.5, 0.9, 0.95, 0.99))}")
def continuous_score_summary(t):
    return rounded(D.score_summary(t.scored(), "direct", 0.55))


@query("D9", f"WITH {SCORED_BIG} {summary_sql('(SELECT * FROM scored_big WHERE y = 1)', 's1', 0.1, (0.05,), 'split', 'min')}")
def positive_low_tail(t):
    positives = t.scored_big().filter(F.col("y") == 1)
    return rounded(D.score_summary(positives, "s1", 0.1, ["split"], (0.05,), tail="low"))


@query("D10", f"""WITH {SCORED_BIG} {summary_sql('scored_big', 's1', 0.9, (0.5, 0.9, 0.95), 'split, category').replace('SELECT split, category,', 'SELECT split, category, 1 AS level,')}
UNION ALL {summary_sql('scored_big', 's1', 0.9, (0.5, 0.9, 0.95), 'split').replace('SELECT split,', 'SELECT split, NULL::VARCHAR AS category, 0 AS level,')}""")
def summary_with_totals(t):
    return rounded(D.summary_with_totals(t.scored_big(), "s1", 0.9, "split", "category"))


@query("D11", f"""WITH judged AS (SELECT coalesce(nullif(d.lang, 'es'), 'unknown') AS context, l.quality AS y, (d.n_chars >= 500)::INT AS said
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id) {confusion_sql('y', 'said = 1', 'context')('judged')}""")
def metrics_by_context(t):
    rows = t.documents().join(t.table("labels"), "doc_id").select(
        F.nullif(F.col("lang"), F.lit("es")).alias("context"), F.col("quality").alias("y"), (F.col("n_chars") >= 500).cast("int").alias("said"))
    return D.context_metrics(rows, "context", "y", "said")


@query("D12", f"""WITH {SCORED_BIG}, g AS (SELECT *, CASE WHEN s2 >= 0.5 THEN 'screenshot' ELSE 'direct' END || '_' ||
    CASE WHEN y = 1 THEN 'bill' ELSE 'nonbill' END AS "group", (s1 >= 0.5)::INT AS said FROM scored_big)
SELECT "group", count(*) AS n, count(*) FILTER (y = said) AS correct, count(*) FILTER (y = said) / count(*)::DOUBLE AS rate FROM g GROUP BY "group" """)
def four_masked_groups(t):
    return D.masked_groups(t.scored_big().withColumn("said", decide("s1", 0.5)), "y", "said", F.col("s2") >= 0.5)


@query("D13", f"WITH {DOC_PAGES} SELECT category, count(DISTINCT doc_name) AS documents FROM doc_pages GROUP BY category")
def documents_per_category(t):
    return D.distinct_documents(t.doc_pages(), "category", "doc_name")


@query("D14, T12", f"""WITH {EXAMPLES}, by_id AS (SELECT source_doc, ('0x' || substr(sha256(id::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM examples),
s AS (SELECT source_doc, CASE WHEN b < 1 THEN 'val' WHEN b < 2 THEN 'test' ELSE 'train' END AS split FROM by_id)
SELECT source_doc, count(DISTINCT split) AS splits, count(*) AS n FROM s GROUP BY source_doc HAVING count(DISTINCT split) > 1""")
def leaking_groups(t):
    return D.leaks(t.examples().withColumn("split", split_80_10_10(text("id"))), "source_doc", "split")


@query("D15", f"WITH {EXAMPLES} SELECT source_doc, count(*) AS n FROM examples GROUP BY source_doc HAVING count(*) > 1")
def duplicate_keys(t):
    return D.duplicates(t.examples(), "source_doc")


@query("D16", f"WITH {SCORED} SELECT class_index, count(*) AS n, (SELECT count(*) FROM scored)::DOUBLE / (10 * count(*)) AS weight FROM scored GROUP BY class_index")
def class_weights(t):
    return D.class_weights(t.scored(), "class_index", classes=10)


@query("D16", f"""WITH {SCORED_BIG}, w AS (SELECT y, (SELECT count(*) FROM scored_big)::DOUBLE / (2 * count(*)) AS weight FROM scored_big GROUP BY y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, weight FROM scored_big s JOIN w ON w.y = s.y""")
def row_weights(t):
    return D.weigh_rows(t.scored_big(), "y", classes=2).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "weight")


@query("D17", f"""WITH {EXAMPLES}, e AS (SELECT * FROM examples WHERE invoice_label IS NOT NULL),
w AS (SELECT invoice_label, least((SELECT count(*) FROM e)::DOUBLE / (2 * count(*)), 5.0) AS w FROM e GROUP BY invoice_label),
a AS (SELECT id, category, CASE WHEN e.source IN ('src1', 'src11') THEN least(w * 2.0, 6.0) ELSE w END AS w FROM e JOIN w ON w.invoice_label = e.invoice_label)
SELECT id, CASE WHEN category = 'en' THEN least(w * 1.15, 6.0) ELSE w END::DOUBLE AS weight FROM a""")
def router_weights(t):
    rows = t.examples().filter(F.col("invoice_label").isNotNull())
    factors = [(F.col("source").isin("src1", "src11"), ROUTER_FACTORS["protected"]), (F.col("category") == "en", ROUTER_FACTORS["screenshot"])]
    return D.weigh_rows(rows, "invoice_label", cap=ROUTER_BALANCE_CAPS["bill"], factors=factors, factor_cap=ROUTER_FACTOR_CAP).select("id", "weight")


@query("D17", f"""WITH {EXAMPLES}, w AS (SELECT category, (SELECT count(*) FROM examples)::DOUBLE / (4 * count(*)) AS w FROM examples GROUP BY category)
SELECT id, least(CASE WHEN e.source IN ('src1', 'src11') THEN w * 1.5 ELSE w END, 5.0)::DOUBLE AS weight FROM examples e JOIN w ON w.category = e.category""")
def class_head_weights(t):
    factors = [(F.col("source").isin("src1", "src11"), factor) for factor in V2_PREFIX_FACTORS["class"].values()]
    return D.weigh_rows(t.examples(), "category", classes=4, factors=factors, factor_cap=("end", V2_WEIGHT_CAPS["class"])).select("id", "weight")


@query("D18", f"""WITH {SCORED}, d AS (SELECT y, direct >= 0.5 AS was, router >= 0.5 AS now FROM scored)
SELECT count(*) AS n, count(*) FILTER (y = 0 AND was AND NOT now) AS negatives_fixed, count(*) FILTER (y = 0 AND NOT was AND now) AS negatives_regressed,
  count(*) FILTER (y = 1 AND was AND NOT now) AS bills_lost, count(*) FILTER (y = 1 AND NOT was AND now) AS bills_recovered FROM d""")
def paired_changes(t):
    scored = t.scored()
    pairs = pair_models(scored.select("id", "y", F.col("direct").alias("s")), scored.select("id", F.col("router").alias("s")), "id", "s")
    return D.paired_changes(pairs.select("y", decide("score_a", 0.5).alias("was"), decide("score_b", 0.5).alias("now")), "y", "was", "now")


@query("D18", f"""WITH {SCORED}, d AS (SELECT split, y, direct >= 0.5 AS was, router >= 0.5 AS now FROM scored)
SELECT split, count(*) AS n, count(*) FILTER (y = 0 AND was AND NOT now) AS negatives_fixed, count(*) FILTER (y = 0 AND NOT was AND now) AS negatives_regressed,
  count(*) FILTER (y = 1 AND was AND NOT now) AS bills_lost, count(*) FILTER (y = 1 AND NOT was AND now) AS bills_recovered FROM d GROUP BY split""")
def paired_changes_by_population(t):
    scored = t.scored()
    pairs = pair_models(scored.select("id", "split", "y", F.col("direct").alias("s")), scored.select("id", F.col("router").alias("s")), "id", "s")
    return D.paired_changes(pairs.select("split", "y", decide("score_a", 0.5).alias("was"), decide("score_b", 0.5).alias("now")), "y", "was", "now", ["split"])


@query("D19", f"""WITH {SCORED}, p AS (SELECT direct AS a, 0.8::DOUBLE * direct + 0.2::DOUBLE * class_bill AS b FROM scored)
SELECT count(*) AS checked, round(max(abs(a - b)), 9) AS max_error, count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS flips FROM p""")
def score_parity(t):
    scored = t.scored()
    pairs = pair_models(scored.select("id", F.col("direct").alias("s")), scored.select("id", fuse_linear("direct", "class_bill").alias("s")), "id", "s")
    return D.score_parity(pairs, 0.5, on_flip="report").withColumn("max_error", F.round("max_error", 9))


@query("D20", f"""WITH {EXAMPLES}, known AS (SELECT DISTINCT source_doc FROM examples WHERE {LATE}),
j AS (SELECT e.source AS folder, k.source_doc IS NULL AS judged, (d.n_chars >= 500) = (e.category = 'en') AS correct
  FROM examples e JOIN documents d ON d.doc_id = e.id LEFT JOIN known k ON k.source_doc = e.source_doc WHERE NOT (substr(e.source, 4)::INT >= 10))
SELECT folder, count(*) FILTER (judged AND correct) AS correct, count(*) FILTER (judged) AS evaluated, count(*) FILTER (NOT judged) AS skipped_duplicates FROM j GROUP BY folder""")
def folder_regression(t):
    rows = t.documents().select(
        F.col("source").alias("folder"), F.sha2("text", 256).alias("digest"), (F.col("n_chars") >= 500).alias("predicted"), (F.col("lang") == "en").alias("expected"))
    late = F.expr("substring(folder, 4)").cast("int") >= 10
    return D.folder_regression(rows.filter(~late), "folder", "predicted", "expected", "digest", rows.filter(late))


@query("D21", """SELECT count(*) AS n, coalesce(sum(('0x' || substr(sha256(sha256(doc_id::VARCHAR) || '|' || coalesce(sha256(quality::VARCHAR), '-') || '|' || coalesce(sha256(toxic::VARCHAR), '-')), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS fingerprint FROM labels""")
def table_fingerprint(t):
    return D.fingerprint(t.table("labels"), ["doc_id", "quality", "toxic"])


@query("D21", "SELECT doc_id, quality, toxic FROM labels")
def fingerprint_checked(t):
    labels = t.table("labels")
    return D.check_fingerprint(labels, labels.columns, D.fingerprint(labels.orderBy(F.desc("doc_id")), labels.columns))


@query("D22", f"""WITH {SCORED_BIG} SELECT split, recall, (recall >= 0.95)::INT AS released FROM ({confusion_sql('y', 's1 >= 0.06', 'split')('scored_big')})""")
def release_gate(t):
    cells = D.confusion(t.scored_big().withColumn("said", decide("s1", 0.06)), "y", "said", ["split"])
    return D.release_gate(cells).select("split", "recall", "released")


@query("D23", f"""WITH {DOC_PAGES}, targets AS (SELECT category, 2 * count(DISTINCT doc_name) AS requested FROM doc_pages GROUP BY category),
got AS (SELECT category, count(*) AS n FROM doc_pages GROUP BY category)
SELECT t.category, requested, coalesce(n, 0) AS obtained, greatest(requested - coalesce(n, 0), 0) AS missing FROM targets t LEFT JOIN got g ON g.category = t.category""")
def category_shortfall(t):
    pages = t.doc_pages()
    targets = D.distinct_documents(pages, "category", "doc_name").select("category", (2 * F.col("documents")).alias("requested"))
    return D.shortfall(targets, pages, "category")


@query("D20", f"""WITH {EXAMPLES}, known AS (SELECT DISTINCT source_doc FROM examples WHERE {LATE})
SELECT d.doc_id, (k.source_doc IS NOT NULL)::INT AS skipped, CASE WHEN k.source_doc IS NULL THEN ((d.n_chars >= 500) = (d.lang = 'en'))::INT END AS correct
FROM documents d LEFT JOIN known k ON k.source_doc = sha256(d.text) WHERE NOT ({LATE})""")
def folder_details(t):
    rows = t.documents().select(
        "doc_id", "source", F.sha2("text", 256).alias("digest"), (F.col("n_chars") >= 500).alias("predicted"), (F.col("lang") == "en").alias("expected"))
    late = F.expr("substring(source, 4)").cast("int") >= 10
    return D.folder_details(rows.filter(~late), "predicted", "expected", "digest", rows.filter(late)).select("doc_id", "skipped", "correct")


@query("D9, D11", f"""WITH bills AS (SELECT coalesce(nullif(d.lang, 'es'), 'unknown') AS context, d.n_chars / 1000.0::DOUBLE AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1) {summary_sql('bills', 'score', 0.2, (0.05,), 'context', 'min')}""")
def low_tail_by_context(t):
    bills = t.documents().join(t.table("labels").filter(F.col("quality") == 1), "doc_id").select(
        F.nullif(F.col("lang"), F.lit("es")).alias("context"), (F.col("n_chars") / F.lit(1000.0)).alias("score"))
    return rounded(D.context_summary(bills, "context", "score", 0.2))


@query("B26, D4, T5", f"""WITH {SCORED}, parts AS (SELECT 'gate' AS part, y, direct AS score, 0.5::DOUBLE AS cut, direct AS rank FROM scored
  UNION ALL SELECT 'verifier', y, class_bill, 0.45, class_bill FROM scored
  UNION ALL SELECT 'cascade', y, CASE WHEN direct >= 0.5 THEN class_bill ELSE -1.0 END, 0.45, CASE WHEN direct >= 0.5 THEN class_bill ELSE -1.0 END FROM scored),
areas AS ({auc_sql('parts', 'y', 'rank', 'part')})
SELECT c.*, round(a.auc, 9) AS auc, (SELECT round(auc, 9) FROM ({auc_sql('(SELECT y, direct * class_bill AS s FROM scored)', 'y', 's')})) AS product_auc
FROM ({confusion_sql('y', 'score >= cut', 'part')('parts')}) c JOIN areas a ON a.part = c.part""")
def cascade_report(t):
    """Gate, verifier and cascade side by side, in one pass over the three scores."""
    scored = t.scored()
    parts = F.explode(F.array(
        F.struct(F.lit("gate").alias("part"), F.col("direct").alias("score"), F.lit(0.5).alias("cut")),
        F.struct(F.lit("verifier").alias("part"), F.col("class_bill").alias("score"), F.lit(0.45).alias("cut")),
        F.struct(F.lit("cascade").alias("part"), cascade_score("direct", 0.5, "class_bill").alias("score"), F.lit(0.45).alias("cut"))))
    long = scored.select("y", parts.alias("p")).select("y", "p.*")
    report = D.classification(long, "y", "score", F.col("cut"), ["part", "cut"]).drop("cut")
    product = D.roc_auc(scored.select("y", cascade_score("direct", 0.5, "class_bill", "product").alias("s")), "y", "s")
    return report.withColumn("auc", F.round("auc", 9)).withColumn("product_auc", F.round(product.scalar(), 9))


@query("D21", """WITH l AS (SELECT count(*) AS n, coalesce(sum(('0x' || substr(sha256(sha256(doc_id::VARCHAR) || '|' || coalesce(sha256(quality::VARCHAR), '-') || '|' || coalesce(sha256(toxic::VARCHAR), '-')), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS f FROM labels),
r AS (SELECT count(*) AS n, coalesce(sum(('0x' || substr(sha256(sha256(page_id::VARCHAR) || '|' || coalesce(sha256(url), '-')), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS f FROM pages)
SELECT 42 AS seed, 'epochs=8' AS args, l.n AS manifest_rows, l.f AS manifest, r.n AS splits_rows, r.f AS splits FROM l, r""")
def run_record(t):
    run = D.run_fingerprint(42, {"epochs": 8}, manifest=t.table("labels"), splits=t.table("pages").select("page_id", "url"))
    args = F.array_join(F.transform(F.map_entries("args"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return run.select("seed", args.alias("args"), F.col("manifest.n").alias("manifest_rows"), F.col("manifest.fingerprint").alias("manifest"),
                      F.col("splits.n").alias("splits_rows"), F.col("splits.fingerprint").alias("splits"))


POINTS = "split string, s1 double, p bigint, n bigint"


def delivered(t):
    """Three deliveries of the scored rows, the second one twice."""
    root, rows = fresh_path(t.spark, "points"), t.scored_big()
    for shard in (0, 1, 1, 2):
        points.add_delivery(rows.filter(F.pmod("l_orderkey", F.lit(3)) == shard), root, f"shard {shard}", "y", "s1", ["split"])
    return points.stored_points(t.spark, root, POINTS)


@query("D5, D6", f"WITH {SCORED_BIG} SELECT split, round(auc, 9) AS auc FROM ({auc_sql('scored_big', 'y', 's1', 'split')})")
def roc_area_of_deliveries(t):
    return points.area(delivered(t), "s1", ["split"]).select("split", F.round("auc", 9).alias("auc"))


@query("K1", f"WITH {SCORED_BIG} {recall_cut_sql('scored_big', 's1', 0.95, 'split', 'ceil')}")
def recall_threshold_of_deliveries(t):
    return points.threshold(delivered(t), "s1", 0.95, "ceil", ["split"])


LABEL_DIGEST = """substr(sha256(sha256(doc_id::VARCHAR)), 1, 3) AS range, ('0x' || substr(sha256(sha256(doc_id::VARCHAR) || '|' || coalesce(sha256(quality::VARCHAR), '-') || '|' || coalesce(sha256(toxic::VARCHAR), '-')), 1, 15))::BIGINT::HUGEINT AS number"""


@query("D21", f"SELECT range, count(*) AS n, sum(number)::VARCHAR AS fingerprint FROM (SELECT {LABEL_DIGEST} FROM labels) GROUP BY range")
def fingerprint_by_range(t):
    return fingerprints.range_fingerprints(t.table("labels"), "doc_id", ["doc_id", "quality", "toxic"])


@query("D21", """SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'removed' ELSE 'changed' END AS change FROM labels WHERE doc_id % 97 = 0 OR doc_id % 89 = 0
UNION ALL SELECT -1, 'added'""")
def changed_rows_by_range(t):
    """A table with some rows changed, removed and added; the rows are read from the ranges that tell."""
    labels, columns = t.table("labels"), ["doc_id", "quality", "toxic"]
    other = labels.filter(F.col("doc_id") % 97 != 0).withColumn("toxic", F.when(F.col("doc_id") % 89 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).select(*columns)
    other = other.unionByName(t.spark.range(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic")))
    tables = []
    for rows in (labels, other):
        path = fresh_path(t.spark, "ranged")
        fingerprints.write_by_range(rows, path, "doc_id")
        tables.append(t.spark.read.schema("doc_id bigint, quality int, toxic int, range string").parquet(path))
    before, after = (fingerprints.range_fingerprints(rows.drop("range"), "doc_id", columns) for rows in tables)
    return fingerprints.differing_rows(*tables, fingerprints.differing_ranges(before, after), "doc_id", columns)
