"""Thresholds, fusion weights and routes chosen on scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from thresher.fixed_values import CUT_STEPS, FUSION_STEPS, RECALL_TARGETS, ROUTE_CAPS
from thresher.functions.labels import or_error
from thresher.functions.scores import fuse_logit, route
from thresher.operators.metrics import (
    aggregate, classify_points, confusion, count_where, labelled_points, pr_curve, rank_area, ratio, roc_auc,
)
from thresher.operators.ordering import (
    as_list, bucketed, covers, guard, quantile_rows, score_points,
)
from thresher.session import pinned


def recall_rank(target, method, total="_n_total"):
    """0-based rank, among ascending positives, of the threshold for a recall."""
    n, target = F.col(total), F.lit(float(target))
    if method == "misses":
        misses = F.floor((F.lit(1.0) - target) * n + F.lit(1e-12))
        return F.least(F.greatest(misses, F.lit(0)), n - 1)
    if method == "ceil":
        return n - F.ceil(target * n)
    raise ValueError(f"unknown method {method!r}")


def threshold_for_recall(df: DataFrame, y, score, target, method="misses", keys=()) -> DataFrame:
    """The highest positive score that still gives the target recall.

    `misses` allows floor((1 - target) * n) misses, kept within the positives; `ceil`
    counts the ceil(target * n) positives to keep. They differ by rounding at exact
    multiples. The result is the score itself: for doubles, `>= score` equals `>=` the
    next lower double.
    """
    keys = as_list(keys)
    points = score_points(df.filter(F.col(y) == 1), score, {"_n": F.count(F.lit(1))}, keys)
    rank = recall_rank(target, method)
    return aggregate(points, keys, F.max(F.when(covers(rank), F.col(score))).alias("threshold"),
                     F.max("_n_total").alias("positives"))


def threshold_from_curve(df: DataFrame, y, score, targets=RECALL_TARGETS, keys=(), required=False) -> DataFrame:
    """Per recall target the curve point of best precision, ties to the highest threshold.

    Unreachable targets have no row, or fail the query if `required`.
    """
    keys = as_list(keys)
    curve = pr_curve(df, y, score, keys)
    grid = F.explode(F.array(*[F.lit(float(t)) for t in targets]))
    reached = curve.withColumn("target", grid).filter(F.col("recall") >= F.col("target"))
    best = F.max(F.struct("precision", "threshold", "recall"))
    rows = aggregate(reached, [*keys, "target"], best.alias("best")).select(*keys, "target", "best.threshold", "best.recall", "best.precision")
    if required:
        wanted = curve.select(*keys, F.lit(len(set(targets))).alias("_n")).distinct() if keys else None
        total = wanted.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar() if keys else F.lit(len(set(targets)))
        rows = guard(rows, rows.agg((total - F.count(F.lit(1))).alias("missing")), "a recall target is unreachable")
    return rows


def fusion_grid(df: DataFrame, y, direct, class_bill, target, steps=FUSION_STEPS, method="ceil", digits=None) -> DataFrame:
    """Per alpha: the threshold at the target recall and the confusion metrics there.

    Only positives are multiplied by the grid before a shuffle. The metrics pass expands
    all rows too, but each task reduces them to one row per alpha before anything moves.
    `digits` rounds fused scores, for comparison across math libraries.
    """
    alphas = [i / (steps - 1) for i in range(steps)]
    fused = fuse_logit(direct, class_bill, F.col("alpha"))
    fused = F.round(fused, digits) if digits is not None else fused

    def expanded(rows):
        slim = rows.select(y, direct, class_bill)
        return slim.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas]))).withColumn("score", fused)

    points = score_points(expanded(df.filter(F.col(y) == 1)), "score", {"_n": F.count(F.lit(1))}, ["alpha"])
    thresholds = points.groupBy("alpha").agg(F.max(F.when(covers(recall_rank(target, method)), F.col("score"))).alias("threshold"))
    cuts = F.broadcast(thresholds.withColumnRenamed("alpha", "_alpha"))  # `steps` rows
    judged = expanded(df).join(cuts, F.col("alpha") == F.col("_alpha"))
    hit, said = F.col(y) == 1, F.col("score") >= F.col("threshold")
    cells = judged.groupBy("alpha", "threshold").agg(
        F.count(F.lit(1)).alias("n"), count_where(said & hit).alias("tp"), count_where(~said & hit).alias("fn"),
        count_where(said & ~hit).alias("fp"), count_where(~said & ~hit).alias("tn"))
    tp, fp = F.col("tp"), F.col("fp")
    return cells.select(
        "*", ratio(tp, tp + F.col("fn")).alias("recall"), ratio(fp, fp + F.col("tn")).alias("fpr"), ratio(tp, tp + fp).alias("precision"))


def calibrate_fusion(df: DataFrame, y, direct, class_bill, target, steps=FUSION_STEPS, method="ceil", digits=None, auc=True) -> DataFrame:
    """The alpha of lowest FPR, then highest precision, then lowest alpha; with its AUC."""
    grid = fusion_grid(df, y, direct, class_bill, target, steps, method, digits)
    best = grid.orderBy(F.col("fpr").asc(), F.col("precision").desc_nulls_last(), F.col("alpha").asc()).limit(1)
    if not auc:
        return best
    # One row of parameters comes to the driver. The AUC plays no part in the choice, so
    # only the winner pays for it.
    chosen = best.collect()
    point = df.sparkSession.createDataFrame(chosen, best.schema)
    if not chosen:
        return point.withColumn("auc", F.lit(None).cast("double"))
    fused = fuse_logit(direct, class_bill, chosen[0]["alpha"])
    fused = F.round(fused, digits) if digits is not None else fused
    return point.withColumn("auc", roc_auc(df.select(y, fused.alias("_fused")), y, "_fused").scalar())


def cut_points(df: DataFrame, score, steps=CUT_STEPS) -> DataFrame:
    """Distinct exact quantiles on an even grid, and both infinities: column `cut`."""
    grid = [i / (steps - 1) for i in range(steps)]
    points = score_points(df, score, {"_n": F.count(F.lit(1))})
    cuts = quantile_rows(points, score, grid).select(F.col("quantile").alias("cut")).distinct()
    ends = df.sparkSession.range(1).select(F.explode(F.array(F.lit(float("-inf")), F.lit(float("inf")))).alias("cut"))
    return ends.unionByName(cuts)


def route_grid(df: DataFrame, y, router, large, large_threshold, steps=CUT_STEPS) -> DataFrame:
    """Every pair low <= high of cut points with its metrics and route rate.

    One pass puts each row between two cut points; whatever the pair, its counts are
    sums over those ranges. The cut points (at most `steps + 2`) come to the driver.
    """
    cuts = sorted(r["cut"] for r in cut_points(df, router, steps).collect())
    inner = cuts[1:-1]
    placed = bucketed(df.filter(F.col(router).isNotNull()), router, inner, "slot")
    hit, yes = F.col(y) == 1, F.col(large) >= large_threshold
    slots = placed.groupBy(F.col("slot").cast("int").alias("slot")).agg(
        count_where(hit).alias("p"), count_where(~hit).alias("q"),
        count_where(hit & yes).alias("py"), count_where(~hit & yes).alias("qy"))
    frame = df.sparkSession.createDataFrame(list(enumerate(cuts)), "slot int, cut double")
    # From here on there are at most `steps + 2` rows, then their pairs.
    filled = frame.join(slots, "slot", "left").na.fill(0)
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = filled.select(
        "slot", "cut", *[F.sum(c).over(above).alias(c) for c in ("p", "q", "py", "qy")],
        F.sum("p").over(whole).alias("positive"), F.sum("q").over(whole).alias("negative"))
    low = sums.select(
        F.col("cut").alias("low"), *[F.col(c).alias(f"low_{c}") for c in ("p", "q", "py", "qy")], "positive", "negative",
        F.explode(F.sequence(F.col("slot"), F.lit(len(cuts) - 1))).alias("slot"))
    high = sums.select("slot", F.col("cut").alias("high"), *[F.col(c).alias(f"high_{c}") for c in ("p", "q", "py", "qy")])
    pairs = low.join(high, "slot")
    tp = F.col("high_p") + F.col("low_py") - F.col("high_py")
    fp = F.col("high_q") + F.col("low_qy") - F.col("high_qy")
    routed = F.col("low_p") - F.col("high_p") + F.col("low_q") - F.col("high_q")
    counted = pairs.select("low", "high", tp.alias("tp"), fp.alias("fp"), (F.col("positive") - tp).alias("fn"),
                           (F.col("negative") - fp).alias("tn"), routed.alias("routed"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counted.select(
        "*", ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"),
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"), ratio(tp + tn, n).alias("accuracy"),
        ratio(F.col("routed"), n).alias("route_rate"))


def pick(df: DataFrame, order, keys=()) -> DataFrame:
    """The first row by sort columns, per key; for small tables."""
    place = F.row_number().over(Window.partitionBy(*(as_list(keys) or [F.lit(0)])).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def accuracy_first(grid: DataFrame, target) -> DataFrame:
    """Among pairs reaching the recall: lowest FPR, route rate, then highest precision.

    A recall that no pair reaches fails the query.
    """
    none = grid.agg(F.when(F.count_if(F.col("recall") >= target) == 0, 1).otherwise(0).alias("none"))
    return guard(pick(grid.filter(F.col("recall") >= target), [
        F.col("fpr").asc(), F.col("route_rate").asc(), F.col("precision").desc(), F.col("low").asc(), F.col("high").asc()]), none, "no route reaches the recall")


def speed_profiles(grid: DataFrame, target, caps=ROUTE_CAPS) -> DataFrame:
    """Per route-rate cap: lowest FPR among pairs reaching the recall, or best recall if none does."""
    capped = grid.withColumn("cap", F.explode(F.array(*[F.lit(float(c)) for c in caps]))).filter(
        F.col("route_rate") <= F.col("cap") + F.lit(1e-12))
    reached = F.col("recall") >= target
    return pick(capped, [
        reached.desc(), F.when(reached, F.col("fpr")).otherwise(-F.col("recall")).asc(),
        F.when(reached, -F.col("recall")).otherwise(F.col("fpr")).asc(), F.col("low").asc(), F.col("high").asc()], ["cap"])


def calibrate_route(df: DataFrame, y, router, large, large_threshold, target, steps=CUT_STEPS, caps=ROUTE_CAPS) -> DataFrame:
    """The recommended pair and one pair per cap, in one table with a `profile` column."""
    grid = route_grid(df, y, router, large, large_threshold, steps)
    first = accuracy_first(grid, target).withColumn("profile", F.lit("accuracy_first"))
    name = F.concat(F.lit("route_cap_"), (F.col("cap") * 100).cast("int").cast("string"), F.lit("pct"))
    return first.unionByName(speed_profiles(grid, target, caps).withColumn("profile", name).drop("cap"))


def evaluate_route(df: DataFrame, y, router, large, low, high, large_threshold, keys=()) -> DataFrame:
    """Metrics and route rate of a fixed operating point; its numbers may be columns."""
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    predicted, uncertain = route(router, large, low, high, large_threshold)
    routed = df.withColumn("_said", predicted).withColumn("_routed", uncertain)
    return confusion(routed, y, "_said", keys, [F.avg("_routed").alias("route_rate")])


def evaluate_routes(df: DataFrame, y, router, large, points: DataFrame, large_threshold, name="profile") -> DataFrame:
    """Metrics and route rate of several fixed points, for a handful of calibrated profiles.

    `points` has (name, low, high), one row per profile. Each task reduces its rows to one
    row per profile.
    """
    table = points.select(name, "low", "high").collect()
    choices = F.array(*[F.struct(F.lit(r[0]).alias("name"), F.lit(r[1]).alias("low"), F.lit(r[2]).alias("high")) for r in table])
    judged = df.select(y, router, large, F.explode(choices).alias("_point"))
    predicted, uncertain = route(router, large, F.col("_point.low"), F.col("_point.high"), large_threshold)
    flat = judged.select(y, F.col("_point.name").alias(name), predicted.alias("_said"), uncertain.alias("_routed"))
    return confusion(flat, y, "_said", [name], [F.avg("_routed").alias("route_rate")])


def select_candidate(df: DataFrame, candidate, position, y, score, target) -> DataFrame:
    """Of several scored candidates: threshold at the recall, then lowest FPR, highest AUC, earliest.

    `df` is long: one row per candidate and example; `position` orders the candidates.
    Threshold, rates and AUC all come from one table of distinct scores.
    """
    keys = [candidate, position]
    points = labelled_points(df, y, score, keys)
    rank = recall_rank(target, "misses", "_p_total")
    at = F.max(F.when(covers(rank, "_p"), F.struct(
        F.col(score).alias("threshold"), (F.col("_p_total") - F.col("_p_upto") + F.col("_p")).alias("tp"),
        (F.col("_q_total") - F.col("_q_upto") + F.col("_q")).alias("fp"))))
    rows = points.groupBy(*keys).agg(at.alias("at"), F.max("_p_total").alias("_p"), F.max("_q_total").alias("_q"), rank_area().alias("auc"))
    rows = rows.select(*keys, "at.threshold", ratio(F.col("at.tp"), F.col("_p")).alias("recall"), ratio(F.col("at.fp"), F.col("_q")).alias("fpr"), "auc")
    best = rows.orderBy(F.round("fpr", 12).asc_nulls_last(), F.col("auc").desc(), F.col(position).asc()).limit(1)
    return best.select(candidate, "threshold", "recall", "fpr", "auc")


def select_then_report(validation: DataFrame, test: DataFrame, y, score, target, extra_threshold=0.5) -> DataFrame:
    """Chooses a threshold on validation and reports validation, test and test at a fixed one.

    Both splits become one table of points per part; the curve and all reports are read
    off it. The two columns needed are written first, as they are read three times.
    """
    both = pinned(validation.select(F.lit("validation").alias("part"), y, score).unionByName(
        test.select(F.lit("test").alias("part"), y, score)))
    points = labelled_points(both, y, score, ["part"])
    tp = F.col("_p_total") - F.col("_p_upto") + F.col("_p")
    fp = F.col("_q_total") - F.col("_q_upto") + F.col("_q")
    curve = points.filter(F.col("part") == "validation").select(
        F.col(score).alias("threshold"), ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("_p_total")).alias("recall"))
    best = curve.filter(F.col("recall") >= target).agg(F.max(F.struct("precision", "threshold")).getField("threshold").alias("threshold"))
    chosen = best.select(or_error(F.col("threshold"), "the recall target is unreachable")).scalar()
    fixed = F.lit(float(extra_threshold))
    parts = F.when(F.col("part") == "validation", F.array(F.struct(F.lit("validation").alias("name"), chosen.alias("at")))).otherwise(
        F.array(F.struct(F.lit("test").alias("name"), chosen.alias("at")), F.struct(F.lit("test_fixed").alias("name"), fixed.alias("at"))))
    judged = points.withColumn("_report", F.explode(parts)).select(
        score, "_p", "_q", "_p_upto", "_q_upto", "_p_total", "_q_total", F.col("_report.name").alias("part"), F.col("_report.at").alias("threshold"))
    report = classify_points(judged, score, F.col("threshold"), ["part", "threshold"])
    return report.select("part", "threshold", "n", "positive", "accuracy", "precision", "recall", "auc")


def expected_cost(df: DataFrame, routed, router_cost, large_cost) -> DataFrame:
    """Mean cost of the two-stage route: the router always, the large model where routed."""
    return df.agg(
        F.avg(router_cost).alias("router_cost"), F.avg(large_cost).alias("large_cost"), F.avg(F.col(routed).cast("double")).alias("route_rate"),
    ).withColumn("expected_cost", F.col("router_cost") + F.col("route_rate") * F.col("large_cost"))
