"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession

# The paths that each open `settled` has seen pinned, the innermost last.
PASSING: ContextVar[list] = ContextVar("passing", default=[])

# Bytes of an Arrow batch that goes to a Python worker; what `slices` of thresher.llm.texts holds at once.
BATCH_BYTES = 4 << 20

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Digest state never expires, so it must not live on the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app="thresher", master=None, **settings) -> SparkSession:
    """A session with the settings the operators were tuned for; `settings` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local folder is made only for a local session that names none: on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="thresher-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark, label) -> str:
    """A path below the shared folder that nothing else uses.

    Everything a session writes lies below its application id, so that it can be removed
    when the session is over.
    """
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release(spark) -> None:
    """Deletes what this session wrote below the shared folder.

    For a caller that has read all results; tables and queries made before stop working.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def pinned(df):
    """`df` written to the shared folder and read back.

    Later steps read the table instead of repeating the work, a lost executor cannot
    change it, and its size is known: small ones are broadcast by Spark's own limit.
    """
    path = fresh_path(df.sparkSession, "pinned")
    for paths in PASSING.get()[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark, make):
    """What `make()` gives, pinned; the tables pinned on the way there are deleted.

    Only the result may be read afterwards, so `make` must hand out nothing else.
    """
    paths = []
    token = PASSING.set([*PASSING.get(), paths])
    try:
        made = make()
    finally:
        PASSING.reset(token)
    result = pinned(made)
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return result


def bounded_batches(spark) -> None:
    """Cuts Arrow batches at BATCH_BYTES from now on, unless the session names a limit of its own.

    Spark's own limits are 10,000 rows and 256 MB. A task's whole share of texts is one batch then, which the
    executor holds outside its heap while it is filled and the Python worker once more.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def parallelism(spark) -> int:
    """How many ways a shuffle is split; also how many slices hot groups get."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
