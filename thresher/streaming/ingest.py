"""Incremental shard ingest with exact deduplication, digest splits and quotas."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.functions.hashing import split_70_15_15
from thresher.operators.ranking import arrival_caps, first_per_key
from thresher.session import parallelism
from thresher.sources.history import commit_state, merged_folders, read_state, unseen, write_keys


def stream_ingest(spark: SparkSession, path, schema, form="parquet", max_files=None) -> DataFrame:
    """Shards of a folder (or glob) as a stream; the checkpoint of the query remembers what was read."""
    reader = spark.readStream.schema(schema).format(form)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_dedup(df: DataFrame, digest) -> DataFrame:
    """One row per digest over all shards and runs.

    The state grows with the number of distinct digests and is never dropped: a copy
    must be recognised however late it comes. A digest with very many copies is first
    deduplicated slice by slice, so that its copies do not all go to one task.
    """
    slices = F.lit(parallelism(df.sparkSession))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), slices))
    return sliced.dropDuplicates([digest, "_slice"]).dropDuplicates([digest]).drop("_slice")


def stream_split(df: DataFrame, key) -> DataFrame:
    """Adds the 70/15/15 split of a key; stateless."""
    return df.withColumn("split", split_70_15_15(F.col(key).cast("string")))


def run_to_table(df: DataFrame, path, checkpoint, form="parquet"):
    """Appends everything available now to a table and stops."""
    query = (df.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


class QuotasFull(Exception):
    """Ends the query before a batch that nothing is wanted of, so that its shards stay unread."""


class QuotasShort(ValueError):
    """The input is at an end and a target is not reached."""


def stream_quota_sink(df: DataFrame, targets, path, checkpoint, digest, order, split="split", on_short="report"):
    """Appends each micro-batch until the split targets are reached, and then stops.

    A batch that comes when all targets are reached is not committed: a later run with
    higher targets begins with its shards. Targets that the input cannot reach are an
    error with `on_short="error"`.

    Per batch: first occurrence per digest, minus digests taken before, then as many rows per
    split, in arrival order, as the target still allows. What was taken before is kept as state
    beside the rows: totals by split and a history of digests (see :mod:`thresher.sources.history`), so
    a batch does not read what earlier ones wrote. Rows, digests and totals count from the
    moment the state is committed; a batch that failed before that is written again, and one
    that comes again after it is passed over. A sink has one writer at a time.
    """
    spark, path = df.sparkSession, path.rstrip("/")

    def write(batch: DataFrame, batch_id):
        number, state = read_state(spark, path)
        if state["batches"].get(checkpoint, -1) >= batch_id:
            return
        left = {name: n - state["totals"].get(name, 0) for name, n in targets.items()}
        left = {name: n for name, n in left.items() if n > 0}
        if not left:
            raise QuotasFull("all targets are reached")
        fresh = unseen(first_per_key(batch, digest, order), path, digest, state)
        accepted, target = arrival_caps(fresh, split, order, left), rows_of_state(path, number + 1)
        accepted.write.mode("overwrite").parquet(target)
        written = spark.read.schema(accepted.schema).parquet(target)
        totals = dict(state["totals"])
        for row in written.groupBy(split).count().collect():  # one row per split
            totals[row[split]] = totals.get(row[split], 0) + row["count"]
        folders = merged_folders(spark, path, [*state["folders"], write_keys(written.select(digest), path)])
        commit_state(spark, path, number, {"folders": folders, "totals": totals, "batches": {**state["batches"], checkpoint: batch_id}})

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as ended:
        if QuotasFull.__name__ not in str(ended):
            raise
    if on_short == "error":
        got = read_state(spark, path)[1]["totals"]
        short = {name: n - got.get(name, 0) for name, n in targets.items() if n > got.get(name, 0)}
        if short:
            raise QuotasShort(f"rows missing by split: {short}")
    return query


def rows_of_state(path, number):
    return f"{path}/rows/state={number}"


def batches_done(spark, path) -> DataFrame:
    """The rows that the quota sink has committed; `state` tells with which batch."""
    path = path.rstrip("/")
    return spark.read.parquet(f"{path}/rows").filter(F.col("state") <= read_state(spark, path)[0])
