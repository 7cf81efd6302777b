"""Incremental ingest of the events table, run until nothing is left to read."""

from pyspark.sql import functions as F

from thresher.plans.registry import query
from thresher.plans.views import ARRIVALS, split_100_sql
from thresher.session import fresh_path
from thresher.streaming.ingest import (
    batches_done, run_to_table, stream_dedup, stream_ingest, stream_quota_sink, stream_split,
)


def arriving(t):
    """The events table as a stream of its files.

    The name is given as a pattern, since the file source takes folders and patterns
    but not the name of a single file.
    """
    path = t.path("events")
    return t.arrivals(stream_ingest(t.spark, path[:-1] + f"[{path[-1]}]", t.table("events").schema, max_files=1000))


def ingested(t, transform):
    out = fresh_path(t.spark, "ingested")
    run_to_table(transform(arriving(t)), out, fresh_path(t.spark, "progress"))
    return t.spark.read.parquet(out)


@query("S1", f"WITH {ARRIVALS} SELECT event_id, episode, source_object, digest FROM arrivals")
def stream_ingest_shards(t):
    return ingested(t, lambda s: s.select("event_id", "episode", "source_object", "digest"))


@query("S1", """SELECT event_id FROM events UNION ALL SELECT event_id + 1000000000 FROM events""")
def stream_resume(t):
    """Two runs over one checkpoint: the second reads only the shards added since."""
    shards, out, progress = (fresh_path(t.spark, name) for name in ("shards", "ingested", "progress"))
    rows = t.table("events").select("event_id", "user_id")
    rows.write.parquet(shards)
    run_to_table(stream_ingest(t.spark, shards, rows.schema).select("event_id"), out, progress)
    rows.withColumn("event_id", F.col("event_id") + 1000000000).write.mode("append").parquet(shards)
    run_to_table(stream_ingest(t.spark, shards, rows.schema).select("event_id"), out, progress)
    return t.spark.read.parquet(out)


@query("S2", f"WITH {ARRIVALS} SELECT DISTINCT digest, episode, source_object FROM arrivals")
def stream_exact_dedup(t):
    return ingested(t, lambda s: stream_dedup(s, "digest").select("digest", "episode", "source_object"))


@query("S3", f"SELECT event_id, {split_100_sql('user_id::VARCHAR')} AS split FROM events")
def stream_hash_split(t):
    return ingested(t, lambda s: stream_split(s, "episode").select("event_id", "split"))


@query("S4", f"""WITH {ARRIVALS}, firsts AS (SELECT DISTINCT digest, split FROM arrivals)
SELECT split, least(count(*), CASE split WHEN 'train' THEN 350 WHEN 'val' THEN 75 ELSE 75 END) AS n FROM firsts GROUP BY split""")
def stream_with_quotas(t):
    out = fresh_path(t.spark, "quotas")
    stream = stream_split(arriving(t).drop("split"), "episode")
    stream_quota_sink(stream, {"train": 350, "val": 75, "test": 75}, out, fresh_path(t.spark, "progress"), "digest", ["arrived", "event_id"])
    return batches_done(t.spark, out).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
