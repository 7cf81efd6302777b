"""Score arithmetic: fusion, cascades, routes and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.fixed_values import BILL_CLASSES, BINARY_THRESHOLD, LINEAR_WEIGHTS, LOGIT_CLIP
from thresher.functions.hashing import as_column


def logit(score, clip=LOGIT_CLIP):
    clipped = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), as_column(score)))
    return F.log(clipped / (F.lit(1.0) - clipped))


def sigmoid(value):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(value)))


def fuse_logit(direct, class_bill, alpha):
    """Weighted mean in logit space. The threshold of a calibration belongs to this form."""
    alpha = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return sigmoid(alpha * logit(direct) + (F.lit(1.0) - alpha) * logit(class_bill))


def fuse_linear(direct, class_bill, weights=LINEAR_WEIGHTS):
    """Weighted mean of the scores themselves.

    The single-score export uses this form; it flips decisions near a threshold
    that was calibrated on :func:`fuse_logit`.
    """
    return F.lit(weights[0]) * as_column(direct) + F.lit(weights[1]) * as_column(class_bill)


def bill_probability(vector, classes=BILL_CLASSES):
    """Sum of the bill classes of a probability vector."""
    total = None
    for index in classes:
        term = F.element_at(as_column(vector), index + 1).cast("double")
        total = term if total is None else total + term
    return total


def argmax_class(vector):
    """Position of the largest component; the first of equals."""
    vector = as_column(vector)
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def decide(score, threshold=BINARY_THRESHOLD):
    """1 where the score reaches the threshold (inclusive)."""
    threshold = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return (as_column(score) >= threshold).cast("int")


def cascade_decision(gate, gate_threshold, verifier, verifier_threshold):
    return ((as_column(gate) >= gate_threshold) & (as_column(verifier) >= verifier_threshold)).cast("int")


def cascade_score(gate, gate_threshold, verifier, form="mask"):
    """Ranking score of a cascade: `mask` gives gated-out rows -1, `product` multiplies."""
    if form == "product":
        return as_column(gate) * as_column(verifier)
    if form != "mask":
        raise ValueError(f"unknown cascade form {form!r}")
    return F.when(as_column(gate) >= gate_threshold, as_column(verifier)).otherwise(F.lit(-1.0))


def route(router, large, low, high, large_threshold):
    """(predicted, uncertain) of the two-threshold route.

    At or above `high` the router says yes, below `low` no; between them the
    large model decides.
    """
    router, large = as_column(router), as_column(large)
    uncertain = (router >= low) & (router < high)
    predicted = F.when(router >= high, 1).when(uncertain, (large >= large_threshold).cast("int")).otherwise(0)
    return predicted, uncertain.cast("int")


def mined_flag(score, threshold, split):
    """Why a row is in a mined manifest."""
    return (
        F.when(as_column(split) != "train", "external_holdout")
        .when(as_column(score) >= threshold, "baseline_false_positive")
        .otherwise("category_top_score")
    )
