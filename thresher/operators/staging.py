"""Two models in stages: the second one sees only the rows that the first one leaves to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.functions.scores import cascade_score, route
from thresher.operators.learning import score_batches
from thresher.session import fresh_path, parallelism


def score_staged(df: DataFrame, features, first, second, asks, names=("first", "second"), digits=None, keep_features=False) -> DataFrame:
    """Adds the scores of two models; the second is null where it was not asked.

    `first` and `second` are (make_model, width) as :func:`score_batches` takes them, and
    `asks` makes a condition of the first score: rows that meet it go to the second model.
    A null score asks nothing.

    The first scores are written once, in one part for the rows that go on and one for the
    others, and only the former carry features. So the first model runs once, the
    second scan reads nothing of the others, and the few rows that go on are dealt out again:
    they may all stand in one corner of the table. With `keep_features` all rows carry them.
    Scores are rounded to `digits` before they are judged, if given.
    """
    rounded = lambda name: F.round(name, digits) if digits is not None else F.col(name)
    (make_first, first_width), (make_second, second_width) = first, second
    scored = score_batches(df, features, make_first, first_width, name=names[0]).withColumn(names[0], rounded(names[0]))
    marked = scored.withColumn("_asked", F.coalesce(asks(F.col(names[0])), F.lit(False)))
    if not keep_features:
        marked = marked.withColumn(features, F.when(F.col("_asked"), F.col(features)))
    path = fresh_path(df.sparkSession, "staged")
    marked.write.partitionBy("_asked").parquet(path)
    written = df.sparkSession.read.schema(marked.schema).parquet(path)
    going_on = written.filter("_asked").repartition(parallelism(df.sparkSession))
    asked = score_batches(going_on, features, make_second, second_width, name=names[1]).withColumn(names[1], rounded(names[1]))
    others = written.filter("not _asked").withColumn(names[1], F.lit(None).cast("double"))
    both = asked.unionByName(others).drop("_asked")
    return both if keep_features else both.drop(features)


def score_routed(df: DataFrame, features, router, large, low, high, large_threshold, digits=None, keep_features=False) -> DataFrame:
    """Adds `router`, `large`, `predicted` and `uncertain`: the large model scores uncertain rows only.

    The decision is that of :func:`thresher.functions.scores.route`.
    """
    asks = lambda s: (s >= low) & (s < high)
    scored = score_staged(df, features, router, large, asks, ("router", "large"), digits, keep_features)
    predicted, uncertain = route("router", "large", low, high, large_threshold)
    return scored.withColumns({"predicted": predicted, "uncertain": uncertain})


def score_cascaded(df: DataFrame, features, gate, verifier, gate_threshold, verifier_threshold, digits=None, keep_features=False) -> DataFrame:
    """Adds `gate`, `verifier`, `predicted` and `ranking`: the verifier scores what passes the gate only."""
    scored = score_staged(df, features, gate, verifier, lambda s: s >= gate_threshold, ("gate", "verifier"), digits, keep_features)
    passed = F.coalesce(F.col("verifier") >= verifier_threshold, F.lit(False))
    return scored.withColumns({"predicted": passed.cast("int"), "ranking": cascade_score("gate", gate_threshold, "verifier")})


def stage_report(scored: DataFrame, names=("first", "second")) -> DataFrame:
    """(n, second_runs, second_rate): how much work the second model had."""
    counted = scored.agg(F.count(F.lit(1)).alias("n"), F.count(names[1]).alias("second_runs"))
    return counted.withColumn("second_rate", F.col("second_runs") / F.nullif("n", F.lit(0)))
