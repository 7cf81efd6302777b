"""The three whole flows, each from raw tables to its published result."""

from pyspark.sql import functions as F

from thresher.fixed_values import CLASS_NAMES, OPERATING_TARGET
from thresher.functions.scores import decide, fuse_logit
from thresher.operators import calibration as K, lineage as G, manifests as M, metrics as D, ranking as E, sampling as P
from thresher.plans.calibrating import BEST_FUSION, FUSION_CELLS
from thresher.plans.expressions import FUSED_SQL
from thresher.plans.joining import INHERITED, inherited
from thresher.plans.registry import query
from thresher.plans.selecting import MINED_SQL
from thresher.plans.views import BIG_ID, SCORED, SCORED_BIG, auc_sql, confusion_sql, text

GROUPED = INHERITED + """,
g AS (SELECT source_doc, count(*) AS n, (SELECT invoice_label FROM inherited i WHERE i.source_doc = o.source_doc
    GROUP BY invoice_label ORDER BY count(*) DESC, invoice_label LIMIT 1) AS stratum FROM inherited o GROUP BY source_doc),
h AS (SELECT source_doc, sum(n) OVER (PARTITION BY stratum ORDER BY sha256('42:' || source_doc), source_doc)::DOUBLE / sum(n) OVER (PARTITION BY stratum) AS share FROM g),
placed AS (SELECT i.*, CASE WHEN share <= 0.8 THEN 'train' WHEN share <= 0.9 THEN 'val' ELSE 'test' END AS split FROM inherited i JOIN h ON h.source_doc = i.source_doc),
thinned AS (SELECT *, row_number() OVER (PARTITION BY split, source ORDER BY sha256('42:' || filepath), filepath) AS place, count(*) OVER (PARTITION BY split, source) AS size FROM placed)"""


@query("C3, G3, G5, G6, T7", f"""WITH {GROUPED}
SELECT filepath, source, invoice_label, split, source_doc FROM thinned, range(3) t(i)
WHERE (split <> 'train' OR source <> 'rvlcdip_other' OR place <= greatest(1, round_even(size * 0.35, 0)))
  AND (i = 0 OR (split = 'train' AND source = 'synthetic_hard_neg'))""")
def build_training_table(t):
    """Labels from lineage, a group split, thinned and replayed train rows."""
    placed = t.stored(P.stratified_group_split(t.stored(inherited(t)), "source_doc", "invoice_label", 42))
    train = F.col("split") == "train"
    rows = P.thin_by_source(placed.filter(train), "source", 0.35, "filepath", 42, F.col("source") == "rvlcdip_other")
    rows = P.oversample(rows, F.col("source") == "synthetic_hard_neg", 3).unionByName(placed.filter(~train))
    return rows.select("filepath", "source", "invoice_label", "split", "source_doc")


@query("E2, B28, D1, H1, H2, H3", f"""WITH {SCORED_BIG}, {MINED_SQL},
base AS (SELECT id, CASE class_index WHEN 0 THEN 'receipt' WHEN 1 THEN 'invoice' WHEN 2 THEN 'structured_document' WHEN 3 THEN 'narrative_document'
    WHEN 4 THEN 'advertisement_presentation' WHEN 5 THEN 'text_scene' ELSE 'natural_photo' END AS class_name, split FROM ({'WITH ' + SCORED + ' SELECT * FROM scored'}))
SELECT split, class_name, count(*) AS n FROM (SELECT split, class_name FROM base
  UNION ALL SELECT split, 'structured_document' FROM mined WHERE split = 'train' AND y = 0) GROUP BY split, class_name""")
def mine_into_training_manifest(t):
    """Counts of a manifest after the mined train negatives were added to it."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    base = t.scored().select(
        F.concat(F.lit("base/"), text("id")).alias("filepath"),
        F.element_at(names, F.least(F.col("class_index"), F.lit(6)) + 1).alias("class_name"), "split")
    mined = E.hardest_per_group(t.scored_big(), 200, ["category"], "s1", BIG_ID, 0.9).filter(F.col("y") == 0)
    pages = mined.select(
        F.concat_ws("/", F.lit("mined"), *BIG_ID).alias("filepath"), F.lit("structured_document").alias("class_name"), "split", "selection")
    fields = ["filepath", "class_name", "split"]
    grown = M.add_train_only(base, t.stored(pages), "filepath", fields)
    return D.counts_by(grown.filter(F.col("filepath").isNotNull()), ["split", "class_name"])


VALIDATED = f"""all_scored AS ({'WITH ' + SCORED + ' SELECT * FROM scored'}),
scored AS (SELECT * FROM all_scored WHERE split <> 'test'), """
BEST_ON_VALIDATION = VALIDATED + FUSION_CELLS + BEST_FUSION[BEST_FUSION.index(",\nbest_fusion"):]


@query("K4, D4, C8, D18, K8", f"""WITH {BEST_ON_VALIDATION},
test AS (SELECT y, router, (SELECT alpha FROM best_fusion) AS a, direct, class_bill FROM all_scored WHERE split = 'test'),
judged AS (SELECT y, router, round({FUSED_SQL.format(a='a')}, 9) AS score, (SELECT threshold FROM best_fusion) AS cut FROM test)
SELECT (SELECT alpha FROM best_fusion) AS alpha, (SELECT threshold FROM best_fusion) AS threshold, c.*, round((SELECT auc FROM ({auc_sql('judged', 'y', 'score')})), 9) AS auc,
  (SELECT count(*) FROM judged WHERE y = 0 AND router >= 0.5 AND score < cut) AS negatives_fixed, (SELECT count(*) FROM judged WHERE y = 0 AND router < 0.5 AND score >= cut) AS negatives_regressed,
  (SELECT count(*) FROM judged WHERE y = 1 AND router >= 0.5 AND score < cut) AS bills_lost, (SELECT count(*) FROM judged WHERE y = 1 AND router < 0.5 AND score >= cut) AS bills_recovered
FROM ({confusion_sql('y', 'score >= cut')('judged')}) c""")
def calibrate_and_compare(t):
    """Fusion chosen off the test split, its test metrics, and what changes against the router."""
    scored = t.scored()
    point = K.calibrate_fusion(scored.filter(F.col("split") != "test"), "y", "direct", "class_bill", OPERATING_TARGET, digits=9, auc=False).first()
    fused = F.round(fuse_logit("direct", "class_bill", point["alpha"]), 9)
    test = scored.filter(F.col("split") == "test").select("id", "y", "router", fused.alias("score"))
    report = D.classification(test, "y", "score", point["threshold"]).withColumn("auc", F.round("auc", 9))
    pairs = G.pair_models(test.select("id", "y", F.col("router").alias("s")), test.select("id", F.col("score").alias("s")), "id", "s")
    changes = D.paired_changes(pairs.select("y", decide("score_a", 0.5).alias("was"), decide("score_b", point["threshold"]).alias("now")), "y", "was", "now")
    packed = changes.select(F.struct("negatives_fixed", "negatives_regressed", "bills_lost", "bills_recovered").alias("c")).scalar()
    return report.withColumn("_changes", packed).select(
        F.lit(point["alpha"]).alias("alpha"), F.lit(point["threshold"]).alias("threshold"), *report.columns, "_changes.*")
