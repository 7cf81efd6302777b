"""Batch scoring and training; checked by rows and by unit tests, not by SQL."""

from pyspark.sql import functions as F

from thresher.operators import learning as J, staging
from thresher.operators.metrics import confusion, roc_auc
from thresher.plans.registry import query
from thresher.plans.views import text
from thresher.functions.hashing import split_80_10_10
from thresher.functions.scores import argmax_class, decide

# A fixed direction in the 64 components; scoring does not depend on any fit.
DIRECTION = [((i * 7) % 13 - 6) / 6.0 for i in range(64)]


def vectors(t):
    return t.table("embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("class_index"),
        F.col("label").isin(0, 1).cast("int").alias("y"), split_80_10_10(text("vec_id")).alias("split"))


DOT = " + ".join(f"embedding[{i + 1}]::DOUBLE * {repr(w)}::DOUBLE" for i, w in enumerate(DIRECTION))


@query("J1", f"SELECT vec_id AS id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({DOT} + 0.25::DOUBLE))), 6) AS score FROM embeddings")
def batch_scores(t):
    scored = J.score_batches(vectors(t), "embedding", J.linear_scorer(DIRECTION, 0.25), len(DIRECTION))
    return scored.select("id", F.round("score", 6).alias("score"))


# A second fixed direction, for the model that is asked in doubt.
SECOND = [((i * 5) % 11 - 5) / 5.0 for i in range(64)]
DOT_SECOND = " + ".join(f"embedding[{i + 1}]::DOUBLE * {repr(w)}::DOUBLE" for i, w in enumerate(SECOND))
TWO_MODELS = f"""two_models AS (
  SELECT vec_id AS id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({DOT} + 0.25::DOUBLE))), 6) AS one,
    round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({DOT_SECOND} - 0.1::DOUBLE))), 6) AS two FROM embeddings)"""


def two_models():
    return (J.linear_scorer(DIRECTION, 0.25), len(DIRECTION)), (J.linear_scorer(SECOND, -0.1), len(SECOND))


@query("J1, B27", f"""WITH {TWO_MODELS}
SELECT id, one AS router, CASE WHEN one >= 0.4 AND one < 0.7 THEN two END AS large,
  CASE WHEN one >= 0.7 THEN 1 WHEN one >= 0.4 THEN (two >= 0.5)::INT ELSE 0 END AS predicted, (one >= 0.4 AND one < 0.7)::INT AS uncertain FROM two_models""")
def routed_scores(t):
    """The second model scores rows between the two thresholds only."""
    router, large = two_models()
    return staging.score_routed(vectors(t).select("id", "embedding"), "embedding", router, large, 0.4, 0.7, 0.5, digits=6)


@query("J1, B26", f"""WITH {TWO_MODELS}
SELECT id, one AS gate, CASE WHEN one >= 0.6 THEN two END AS verifier, (one >= 0.6 AND two >= 0.5)::INT AS predicted,
  CASE WHEN one >= 0.6 THEN two ELSE -1 END AS ranking FROM two_models""")
def cascaded_scores(t):
    """The verifier scores what passes the gate only."""
    gate, verifier = two_models()
    return staging.score_cascaded(vectors(t).select("id", "embedding"), "embedding", gate, verifier, 0.6, 0.5, digits=6)


@query("J1", f"""WITH {TWO_MODELS}
SELECT count(*) AS n, count(*) FILTER (one >= 0.4 AND one < 0.7) AS second_runs, count(*) FILTER (one >= 0.4 AND one < 0.7) / count(*)::DOUBLE AS second_rate FROM two_models""")
def second_model_runs(t):
    router, large = two_models()
    routed = staging.score_routed(vectors(t).select("id", "embedding"), "embedding", router, large, 0.4, 0.7, 0.5, digits=6)
    return staging.stage_report(routed, ("router", "large"))


@query("J2")
def weighted_classifier(t):
    """Test metrics of a binary classifier trained with balancing weights."""
    rows = vectors(t)
    model = J.train_weighted(rows.filter(F.col("split") == "train"), "embedding", "y", classes=2)
    scored = J.apply_model(model, rows.filter(F.col("split") != "train"), "embedding")
    judged = scored.withColumn("score", F.element_at("probability", 2)).withColumn("said", decide("score", 0.5))
    return confusion(judged, "y", "said", ["split"]).join(roc_auc(judged, "y", "score", ["split"]), "split")


@query("J3")
def multiclass_classifier(t):
    """Per-row class of a ten-class classifier with class weights, on the held-out splits."""
    rows = vectors(t)
    model = J.train_weighted(rows.filter(F.col("split") == "train"), "embedding", "class_index", "multinomial", classes=10)
    scored = J.apply_model(model, rows.filter(F.col("split") != "train"), "embedding")
    return scored.select("id", "class_index", argmax_class("probability").alias("predicted_class"))


@query("J4")
def mine_replay_retrain(t):
    """Mined negatives with their scores before and after the replayed training."""
    rows = vectors(t)
    before, mined, after = J.mine_replay_retrain(rows, "embedding", "y", "id", k=40, repeat=5)
    again = J.apply_model(after, rows.join(mined.select("id", F.col("score").alias("score_before")), "id"), "embedding")
    return again.select("id", "score_before", F.element_at("probability", 2).alias("score_after"))
