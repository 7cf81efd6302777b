"""Score points kept by delivery, so that a new shard updates curves and thresholds without a rescan.

A delivery of scored rows is reduced to one row per key and score with its positives and
negatives, and published under its name. A delivery that comes again replaces itself. Curves,
areas and thresholds are totals of points, so they equal those of all rows together.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.operators.calibration import recall_rank
from thresher.operators.metrics import aggregate, classify_points, count_where, rank_area
from thresher.operators.ordering import as_list, covers, score_points
from thresher.sources.versions import Files, NoVersion, commit_folder, publish, versions
from thresher.sources.versions import DIGITS


def add_delivery(df: DataFrame, root, delivery, y, score, keys=()) -> None:
    """Publishes the points (keys, score, p, n) of a delivery."""
    known = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    points = known.groupBy(*as_list(keys), score).agg(count_where(F.col(y) == 1).alias("p"), count_where(F.col(y) != 1).alias("n"))
    publish(points, f"{root.rstrip('/')}/{quote(delivery, safe='')}")


def stored_points(spark: SparkSession, root, schema) -> DataFrame:
    """The points of the newest version of every delivery, as they were stored."""
    root, paths = root.rstrip("/"), []
    files = Files(spark, root)
    for name in files.names(root):  # one commit file a delivery
        known = versions(spark, f"{root}/{name}")
        if known:
            paths.append(f"{root}/{name}/" + files.read(f"{commit_folder(f'{root}/{name}')}/{known[-1]:0{DIGITS}d}").split(" ")[1])
    if not paths:
        raise NoVersion(f"{root} has no delivery")
    return spark.read.schema(schema).parquet(*paths)


def merged_points(points: DataFrame, score, keys=(), descending=False) -> DataFrame:
    """Stored points as :func:`thresher.operators.metrics.labelled_points` makes them of rows."""
    return score_points(points, score, {"_p": F.sum("p"), "_q": F.sum("n")}, keys, descending)


def area(points: DataFrame, score, keys=()) -> DataFrame:
    """The AUC of stored points."""
    return aggregate(merged_points(points, score, keys), keys, rank_area().alias("auc"))


def report(points: DataFrame, score, threshold, keys=()) -> DataFrame:
    """Confusion metrics at a threshold and the AUC of stored points."""
    return classify_points(merged_points(points, score, keys), score, threshold, keys)


def threshold(points: DataFrame, score, target, method="misses", keys=()) -> DataFrame:
    """The highest positive score that still gives the target recall."""
    merged = score_points(points.filter("p > 0"), score, {"_n": F.sum("p")}, as_list(keys))
    return aggregate(merged, keys, F.max(F.when(covers(recall_rank(target, method)), F.col(score))).alias("threshold"), F.max("_n_total").alias("positives"))


def merge_deliveries(spark: SparkSession, root, schema, score, keys, into) -> None:
    """Writes the points of all deliveries as one delivery below the folder `into`."""
    merged = stored_points(spark, root, schema).groupBy(*as_list(keys), score).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    publish(merged, f"{into.rstrip('/')}/merged")
