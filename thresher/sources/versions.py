"""Manifests that are replaced while others read them.

A manifest folder holds data folders, one a version, and a folder of commit files named by
number. A version is written whole, and then its commit file, which names the data folder, is
renamed into place; a rename that finds the name taken fails, so of two writers one
gets the number and the other takes the next. Readers look up the newest commit file once, when
they open the manifest: they never see a version being written, and go on reading theirs
when a newer one comes. All of it goes through Hadoop's file systems, so it works wherever
Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

DIGITS = 12


class NoVersion(FileNotFoundError):
    """The folder has no committed version, or not the one asked for."""


class Files:
    """The few file operations that commits need, on the file system of a folder."""

    def __init__(self, spark: SparkSession, folder):
        self.hadoop = spark._jvm.org.apache.hadoop
        self.gateway = spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self.hadoop.fs.Path(folder)
        self.system = root.getFileSystem(conf)
        self.context = self.hadoop.fs.FileContext.getFileContext(self.system.makeQualified(root).toUri(), conf)

    def path(self, name):
        return self.hadoop.fs.Path(name)

    def names(self, folder):
        if not self.system.exists(self.path(folder)):
            return []
        return [s.getPath().getName() for s in self.system.listStatus(self.path(folder))]

    def write(self, name, text):
        out = self.system.create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name):
        source = self.system.open(self.path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def claim(self, name, target) -> bool:
        """Renames a file unless the target exists."""
        none = self.gateway.new_array(self.gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.path(name), self.path(target), none)
        except Exception as failed:
            if "FileAlreadyExistsException" not in str(failed):
                raise
            return False
        return True

    def remove(self, name):
        self.system.delete(self.path(name), True)


def commit_folder(root):
    return f"{root.rstrip('/')}/_commits"


def versions(spark: SparkSession, root) -> list[int]:
    """The committed versions, oldest first."""
    return sorted(int(n) for n in Files(spark, root).names(commit_folder(root)) if n.isdigit())


def publish(df: DataFrame, root, form="parquet", expected=None, partition_by=(), **options) -> int:
    """Writes a table as the next version of a manifest and returns its number.

    Nothing is visible until all of it is written, and a write that fails leaves no version. With
    `expected` the newest version must still be that number (0: none): a writer who
    worked from an older one gets an error instead of undoing what came between.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    files = Files(spark, root)
    data = f"data-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).partitionBy(*partition_by).save(f"{root}/{data}")
    draft = f"{commit_folder(root)}/_draft-{uuid.uuid4().hex}"
    files.write(draft, f"{form} {data}")
    while True:
        newest = (versions(spark, root) or [0])[-1]
        if expected is not None and newest != expected:
            files.remove(draft)
            files.remove(f"{root}/{data}")
            raise ValueError(f"version {newest} has come after version {expected}")
        if files.claim(draft, f"{commit_folder(root)}/{newest + 1:0{DIGITS}d}"):
            return newest + 1


def open_version(spark: SparkSession, root, schema, number=None, **options) -> DataFrame:
    """The newest version of a manifest, or the numbered one, under a declared schema."""
    known = versions(spark, root)
    if not known or (number is not None and number not in known):
        raise NoVersion(f"{root} has no version {number or ''}".rstrip())
    form, data = Files(spark, root).read(f"{commit_folder(root)}/{number or known[-1]:0{DIGITS}d}").split(" ")
    return spark.read.format(form).schema(schema).options(**options).load(f"{root.rstrip('/')}/{data}")


def replace(spark: SparkSession, root, schema, change, form="parquet", attempts=5, **options) -> int:
    """Publishes `change(newest version)`; begins again from the newest when another writer was faster."""
    for _ in range(attempts):
        newest = (versions(spark, root) or [0])[-1]
        try:
            return publish(change(open_version(spark, root, schema, newest, **options)), root, form, expected=newest, **options)
        except PySparkException:
            raise
        except ValueError as late:
            if "has come after" not in str(late):
                raise
    raise ValueError(f"{root} was replaced by others {attempts} times")


def expire(spark: SparkSession, root, keep=2) -> None:
    """Forgets all but the newest versions, and data folders without a commit.

    For a time when no writer is at work and no reader holds an older version.
    """
    files, known = Files(spark, root), versions(spark, root)
    for number in known[:-keep] if keep else known:
        files.remove(f"{commit_folder(root)}/{number:0{DIGITS}d}")
    held = {files.read(f"{commit_folder(root)}/{n:0{DIGITS}d}").split(" ")[1] for n in versions(spark, root)}
    for name in files.names(root):
        if name.startswith("data-") and name not in held:
            files.remove(f"{root.rstrip('/')}/{name}")
