"""Counts, classification metrics, score summaries, weights and integrity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.fixed_values import (
    CLASS_NAMES, PROTECTED_PREFIX, RECALL_FLOOR, ROUTER_BALANCE_CAPS, ROUTER_FACTOR_CAP, ROUTER_FACTORS, V2_PREFIX_FACTORS, V2_WEIGHT_CAPS,
)
from thresher.operators.ordering import (
    as_list, attach_reference, guard, join_small, quantile_columns, quantile_from, score_points,
)


def ratio(a, b):
    """a / b as double; null for an empty denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))

# Most entries of a report's map.
MAP_ENTRIES = 10_000


def count_where(test):
    return F.coalesce(F.sum(test.cast("bigint")), F.lit(0).cast("bigint"))


def aggregate(df: DataFrame, keys, *columns) -> DataFrame:
    keys = as_list(keys)
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def counts_by(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("n"))


def counts_map(df: DataFrame, keys) -> DataFrame:
    """One row, one map `"a/b" -> n`, for reports over fixed enumerations.

    A null key reads "null", as a text of that name does. More than MAP_ENTRIES entries are an error.
    """
    named = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in as_list(keys)]
    counted = counts_by(df.select(F.concat_ws("/", *named).alias("key")), "key")
    counted = guard(counted, counted.agg(F.when(F.count(F.lit(1)) > MAP_ENTRIES, 1).otherwise(0).alias("n")), "too many keys for one map")
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))


def conditional_counts(df: DataFrame, keys, conditions) -> DataFrame:
    """Row count and one count per named condition."""
    return aggregate(df, keys, F.count(F.lit(1)).alias("n"), *[count_where(c).alias(name) for name, c in conditions.items()])


def agreement(df: DataFrame, a, b, keys=()) -> DataFrame:
    """How often two columns agree; rows with a null are in neither count."""
    return conditional_counts(df, keys, {"agree": F.col(a) == F.col(b), "disagree": F.col(a) != F.col(b)})


def confusion(df: DataFrame, y, predicted, keys=(), extra=()) -> DataFrame:
    """Confusion counts and rates in one pass; a rate with an empty denominator is null.

    `extra` are further aggregates of the same pass.
    """
    hit, said = F.col(y) == 1, F.col(predicted) == 1
    cells = aggregate(
        df, keys, F.count(F.lit(1)).alias("n"), count_where(hit).alias("positive"), count_where(~hit).alias("negative"),
        count_where(said & hit).alias("tp"), count_where(~said & hit).alias("fn"),
        count_where(said & ~hit).alias("fp"), count_where(~said & ~hit).alias("tn"), *extra)
    return rates(cells)


def labelled_points(df: DataFrame, y, score, keys=(), descending=False) -> DataFrame:
    """Distinct scores with their positive (_p) and negative (_q) counts and running totals."""
    hit = F.col(y) == 1
    return score_points(df.filter(F.col(y).isNotNull()), score,
                        {"_p": count_where(hit), "_q": count_where(~hit)}, keys, descending)


def roc_auc(df: DataFrame, y, score, keys=()) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. Null with one class only."""
    return aggregate(labelled_points(df, y, score, keys), keys, rank_area().alias("auc"))


def pr_curve(df: DataFrame, y, score, keys=()) -> DataFrame:
    """One row per distinct score taken as an inclusive threshold."""
    points = labelled_points(df, y, score, keys, descending=True)
    tp, fp = F.col("_p_upto"), F.col("_q_upto")
    return points.select(
        *as_list(keys), F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("_p_total")).alias("recall"))


def rank_area():
    """AUC as an aggregate over :func:`labelled_points`."""
    below = (F.col("_q_upto") - F.col("_q")).cast("double")
    area = F.sum(F.col("_p").cast("double") * (below + F.col("_q").cast("double") / 2.0))
    return F.try_divide(area, F.max("_p_total").cast("double") * F.max("_q_total").cast("double"))


def rates(cells: DataFrame) -> DataFrame:
    """Adds the rates to tp, fn, fp, tn; a rate with an empty denominator is null."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return cells.withColumns({
        "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "precision": ratio(tp, tp + fp),
        "accuracy": ratio(tp + tn, tp + fn + fp + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def classify_points(points: DataFrame, score, threshold, keys=()) -> DataFrame:
    """Confusion metrics at a threshold and the AUC, both from one table of points."""
    threshold = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    said = F.col(score) >= threshold
    total = lambda m, test: F.coalesce(F.sum(F.when(test, F.col(m))), F.lit(0).cast("bigint"))
    cells = aggregate(
        points, keys, (F.sum("_p") + F.sum("_q")).alias("n"), F.sum("_p").alias("positive"), F.sum("_q").alias("negative"),
        total("_p", said).alias("tp"), total("_p", ~said).alias("fn"), total("_q", said).alias("fp"), total("_q", ~said).alias("tn"),
        rank_area().alias("auc"))
    return rates(cells)


def classification(df: DataFrame, y, score, threshold, keys=()) -> DataFrame:
    """Confusion metrics at a threshold, and the AUC, in one pass over the rows."""
    return classify_points(labelled_points(df, y, score, keys), score, threshold, keys)


def multiclass_report(df: DataFrame, y, predicted) -> DataFrame:
    """n, accuracy and macro-F1 over the classes seen on either side.

    Rows shrink to one per (true, predicted) pair before anything else happens.
    """
    pairs = df.groupBy(F.col(y).alias("t"), F.col(predicted).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("t") == F.col("s")
    zero = F.lit(0).cast("bigint")
    sides = pairs.select("n", same.alias("same"), F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.when(same, F.col("n")).otherwise(zero).alias("tp"), F.when(same, zero).otherwise(F.col("n")).alias("miss")),
        F.struct(F.col("s").alias("c"), zero.alias("tp"), F.when(same, zero).otherwise(F.col("n")).alias("miss")))).alias("side"))
    classes = sides.groupBy("side.c").agg(F.sum("side.tp").alias("tp"), F.sum("side.miss").alias("miss"))
    scores = classes.agg(
        F.sum("tp").alias("right"), (F.sum("tp") + (F.sum("miss") / 2).cast("bigint")).alias("n"),
        F.avg(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("miss"))).alias("macro_f1"))
    return scores.select("n", ratio(F.col("right"), F.col("n")).alias("accuracy"), "macro_f1")


def quantile_name(p):
    return f"p{int(round(p * 100)):02d}"


def summarize_points(points: DataFrame, score, threshold, keys, probabilities, tail) -> DataFrame:
    value, n = F.col(score), F.col("_n")
    over = F.coalesce(F.sum(F.when(value >= threshold, n)), F.lit(0).cast("bigint"))
    ends = {"high": F.max(score).alias("max"), "low": F.min(score).alias("min")}
    rows = aggregate(
        points, keys, F.sum(n).alias("count"), over.alias("at_or_over"), (F.sum(value * n) / F.sum(n)).alias("mean"),
        ends[tail], F.max("_n_total").alias("_total"), *quantile_columns(score, probabilities))
    rate = ratio(F.col("at_or_over"), F.col("count"))
    named = [rate.alias("rate"), "mean"]
    named += [quantile_from(i, p, "_total").alias(quantile_name(p)) for i, p in enumerate(probabilities)]
    return rows.select(*as_list(keys), F.col("count").alias("n"), "at_or_over", *named, "max" if tail == "high" else "min")


def score_summary(df: DataFrame, score, threshold, keys=(), probabilities=(0.5, 0.9, 0.95, 0.99), tail="high") -> DataFrame:
    """n, rows at or over the threshold and their rate, mean, exact quantiles, extreme.

    For negatives the rate is the false-positive rate; for positives use `tail="low"`
    with low quantiles, and the rate is the recall.
    """
    points = score_points(df, score, {"_n": F.count(F.lit(1))}, keys)
    return summarize_points(points, score, threshold, keys, probabilities, tail)


def summary_with_totals(df: DataFrame, score, threshold, key, category, probabilities=(0.5, 0.9, 0.95), tail="high") -> DataFrame:
    """Summaries per key and per (key, category) in one report; `category` is null overall.

    Rows are reduced to distinct scores before they are doubled for the two levels.
    `level` is 0 for the overall rows, which keeps them apart from a null category.
    """
    slim = df.filter(F.col(score).isNotNull()).groupBy(key, category, score).agg(F.count(F.lit(1)).alias("_c"))
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.lit(None).cast(df.schema[category].dataType).alias("category")),
        F.struct(F.lit(1).alias("level"), F.col(category).alias("category"))))
    doubled = slim.select(key, score, "_c", levels.alias("_at")).select(
        key, F.col("_at.level").alias("level"), F.col("_at.category").alias(category), score, "_c")
    points = score_points(doubled, score, {"_n": F.sum("_c")}, [key, "level", category])
    return summarize_points(points, score, threshold, [key, "level", category], probabilities, tail)


def context_metrics(df: DataFrame, context, y, predicted, missing="unknown") -> DataFrame:
    """Confusion metrics per context; a missing context is a context of its own."""
    named = df.withColumn(context, F.coalesce(F.nullif(F.col(context), F.lit("")), F.lit(missing)))
    return confusion(named, y, predicted, [context])


def context_summary(df: DataFrame, context, score, threshold, probabilities=(0.05,), tail="low", missing="unknown") -> DataFrame:
    """Score summaries per context; a missing context is a context of its own."""
    named = df.withColumn(context, F.coalesce(F.nullif(F.col(context), F.lit("")), F.lit(missing)))
    return score_summary(named, score, threshold, [context], probabilities, tail)


def masked_groups(df: DataFrame, y, predicted, screenshot) -> DataFrame:
    """Correct decisions in the four groups direct/screenshot x bill/nonbill."""
    side = F.when(screenshot, "screenshot").otherwise("direct")
    group = F.concat_ws("_", side, F.when(F.col(y) == 1, "bill").otherwise("nonbill"))
    counted = df.groupBy(group.alias("group")).agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col(y) == F.col(predicted)).alias("correct"))
    return counted.withColumn("rate", ratio(F.col("correct"), F.col("n")))


def distinct_documents(df: DataFrame, category, document) -> DataFrame:
    return df.groupBy(category).agg(F.count_distinct(document).alias("documents"))


def leaks(df: DataFrame, group, split) -> DataFrame:
    """Groups that occur in more than one split.

    Map-side sets hold split names only, so one shuffle of small states is enough.
    """
    seen = df.groupBy(group).agg(F.size(F.collect_set(split)).cast("bigint").alias("splits"), F.count(F.lit(1)).alias("n"))
    return seen.filter(F.col("splits") > 1)


def duplicates(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*as_list(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def class_weights(df: DataFrame, column, classes=None, cap=None) -> DataFrame:
    """Balancing weight n / (k * n_c) per class.

    k is `classes` if given, otherwise the number of classes present.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("present"))).scalar()
    k = F.lit(classes) if classes else whole.getField("present")
    weight = whole.getField("total").cast("double") / (k * F.col("n"))
    return counts.withColumn("weight", F.least(weight, F.lit(float(cap))) if cap else weight)


def weigh_rows(df: DataFrame, column, name="weight", classes=None, cap=None, factors=(), factor_cap=None) -> DataFrame:
    """Adds the class weight to each row, then multiplies it by rule.

    `factors` is a list of (condition, factor); after each matching rule the weight is
    capped by `factor_cap`, or once at the end with `factor_cap=("end", cap)`.
    """
    table = class_weights(df, column, classes, cap).select(column, F.col("n").alias("_rows"), F.col("weight").alias(name))
    rows = join_small(df, table, [column], "_rows", how="left")
    at_end = isinstance(factor_cap, tuple)
    for condition, factor in factors:
        grown = F.col(name) * factor
        if factor_cap is not None and not at_end:
            grown = F.least(grown, F.lit(float(factor_cap)))
        rows = rows.withColumn(name, F.when(condition, grown).otherwise(F.col(name)))
    if at_end:
        rows = rows.withColumn(name, F.least(F.col(name), F.lit(float(factor_cap[1]))))
    return rows


def verifier_weights(df: DataFrame, path, bill, class_index) -> DataFrame:
    """Adds `bill_weight` and `class_weight` with the published prefixes, factors and caps."""
    for column, name, k in ((bill, "bill", 2), (class_index, "class", len(CLASS_NAMES))):
        factors = [(F.col(path).startswith(prefix), factor) for prefix, factor in V2_PREFIX_FACTORS[name].items()]
        df = weigh_rows(df, column, f"{name}_weight", k, factors=factors, factor_cap=("end", V2_WEIGHT_CAPS[name]))
    return df


def router_weights(df: DataFrame, path, bill, class_index, context) -> DataFrame:
    """Adds `bill_weight`, `class_weight` and `context_weight` of the router training."""
    factors = [(F.col(path).startswith(PROTECTED_PREFIX), ROUTER_FACTORS["protected"]), (F.col(context) == 1, ROUTER_FACTORS["screenshot"])]
    df = weigh_rows(df, bill, "bill_weight", cap=ROUTER_BALANCE_CAPS["bill"], factors=factors, factor_cap=ROUTER_FACTOR_CAP)
    df = weigh_rows(df, class_index, "class_weight", cap=ROUTER_BALANCE_CAPS["class"])
    return weigh_rows(df, context, "context_weight", cap=ROUTER_BALANCE_CAPS["context"])


def paired_changes(pairs: DataFrame, y, before, after, keys=()) -> DataFrame:
    """Decisions that changed between two models on the same rows, by population if `keys` name it."""
    hit, was, now = F.col(y) == 1, F.col(before) == 1, F.col(after) == 1
    return conditional_counts(pairs, keys, {
        "negatives_fixed": ~hit & was & ~now, "negatives_regressed": ~hit & ~was & now,
        "bills_lost": hit & was & ~now, "bills_recovered": hit & ~was & now})


def score_parity(pairs: DataFrame, threshold, on_flip="error") -> DataFrame:
    """Largest difference of `score_a` and `score_b`, and decisions that flip.

    Any flip fails the query unless `on_flip="report"`.
    """
    flips = count_where((F.col("score_a") >= threshold) != (F.col("score_b") >= threshold))
    report = pairs.agg(
        F.count(F.lit(1)).alias("checked"), F.max(F.abs(F.col("score_a") - F.col("score_b"))).alias("max_error"), flips.alias("flips"))
    if on_flip == "error":
        failing = F.when(F.col("flips") > 0, F.raise_error(F.concat(F.col("flips").cast("string"), F.lit(" decisions changed"))))
        report = report.withColumn("flips", failing.otherwise(F.col("flips")))
    return report


def folder_details(df: DataFrame, predicted, expected, digest, exclude: DataFrame | None = None) -> DataFrame:
    """Adds `skipped` and `correct` (null if skipped) to regression rows.

    Rows whose digest occurs in `exclude` are skipped, not judged.
    """
    if exclude is None:
        flagged = df.withColumn("_known", F.lit(None).cast("int"))
    else:
        known = exclude.select(F.col(digest).alias("_other")).distinct().withColumn("_known", F.lit(1))
        flagged = attach_reference(df, known, digest, ["_known"], "_other")
    skipped = F.col("_known").isNotNull()
    correct = F.when(~skipped, (F.col(predicted) == F.col(expected)).cast("int"))
    return flagged.withColumn("skipped", skipped.cast("int")).withColumn("correct", correct).drop("_known")


def folder_regression(df: DataFrame, folder, predicted, expected, digest, exclude: DataFrame | None = None) -> DataFrame:
    """Correct, evaluated and skipped rows per folder."""
    return folder_details(df, predicted, expected, digest, exclude).groupBy(folder).agg(
        count_where(F.col("correct") == 1).alias("correct"), count_where(F.col("skipped") == 0).alias("evaluated"),
        count_where(F.col("skipped") == 1).alias("skipped_duplicates"))


def fingerprint(df: DataFrame, columns) -> DataFrame:
    """Row count and an order-free digest sum that change when any value changes."""
    # Each cell is a digest of its own or a dash, so no value can reach into the next one.
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in as_list(columns)]
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("fingerprint"))


def run_fingerprint(seed, arguments, **tables) -> DataFrame:
    """One row that identifies a run: seed, arguments as a map, and a fingerprint per table."""
    row = None
    for name, table in tables.items():
        mark = fingerprint(table, table.columns).select(F.struct("n", "fingerprint").alias(name))
        row = mark if row is None else row.withColumn(name, mark.scalar())
    entries = [F.lit(str(v)) for pair in sorted(arguments.items()) for v in pair]
    return row.select(F.lit(seed).alias("seed"), F.create_map(*entries).alias("args"), *tables)


def check_fingerprint(df: DataFrame, columns, expected: DataFrame, allow_mismatch=False) -> DataFrame:
    """`df`, refused when its fingerprint is not the recorded one (a one-row table).

    An absent record cannot be checked and passes.
    """
    if allow_mismatch:
        return df
    recorded = expected.select("fingerprint").scalar()
    changed = fingerprint(df, columns).select(
        F.when(recorded.isNotNull() & (F.col("fingerprint") != recorded), 1).otherwise(0).alias("changed"))
    return guard(df, changed, "the table is not the one recorded with the model")


def release_gate(metrics: DataFrame, floor=RECALL_FLOOR, on_fail="report") -> DataFrame:
    """Adds `released`: the recall reaches the floor. A null recall does not."""
    passed = F.coalesce(F.col("recall") >= floor, F.lit(False))
    if on_fail == "error":
        return metrics.withColumn("released", F.when(passed, 1).otherwise(F.raise_error(F.lit("recall is below the floor"))))
    return metrics.withColumn("released", passed.cast("int"))


def shortfall(targets: DataFrame, got: DataFrame, key) -> DataFrame:
    """Requested, obtained and missing rows per key, for every requested key."""
    counted = got.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    joined = targets.join(counted, F.col(key) == F.col("_key"), "left")
    obtained = F.coalesce("_n", F.lit(0))
    return joined.select(
        key, "requested", obtained.alias("obtained"), F.greatest(F.col("requested") - obtained, F.lit(0)).alias("missing"))
