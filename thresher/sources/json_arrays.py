"""Records of one large array inside a JSON file, read one by one.

Spark reads a JSON file of several lines as one row, so an annotation file of some gigabytes
has to fit into a task, and its array into one cell. The reader here walks the file and
passes records on as it meets them: a task holds one record and one block of text, however large the
file is. Each file is a task of its own. Files are opened with Arrow's file
systems (local folders, HDFS, S3, Google and Azure stores); a suffix that Arrow knows
(`.gz`, `.bz2`, `.zst`) is decompressed on the way.
"""

from __future__ import annotations

import codecs
import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "json_array_records"
BLOCK = 1 << 20
# Records in an Arrow batch.
ROWS = 500


class Walker:
    """Values of a JSON text that comes in blocks."""

    def __init__(self, blocks):
        self.blocks, self.text, self.at = iter(blocks), "", 0
        self.decoder = json.JSONDecoder()

    def more(self) -> bool:
        """Lets go of what has been read and adds a block."""
        block = next(self.blocks, "")
        self.text, self.at = self.text[self.at:] + block, 0
        return bool(block)

    def sign(self):
        """The next character that is no blank; empty at the end. It stays unread."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n﻿":
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def take(self, sign) -> bool:
        """Reads the character if it is the next one."""
        found = self.sign() == sign
        self.at += found
        return found

    def need(self, sign):
        if not self.take(sign):
            raise ValueError(f"{sign!r} expected in a JSON text")

    def grow(self) -> bool:
        """Adds as much text again as is held."""
        held, parts, size = len(self.text) - self.at, [self.text[self.at:]], 0
        while size < max(held, 1) and (block := next(self.blocks, "")):
            parts.append(block)
            size += len(block)
        self.text, self.at = "".join(parts), 0
        return size > 0

    def value(self):
        """Reads one value; while its end is not in the text held, more is added."""
        self.sign()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.at)
            except json.JSONDecodeError:
                if not self.grow():
                    raise
                continue
            whole = end < len(self.text) or isinstance(found, (dict, list, str))  # a number might go on
            if whole or not self.grow():
                self.at = end if whole else self.decoder.raw_decode(self.text, self.at)[1]
                return found


def records(walker, key, single=None):
    """The elements of the array under `key` of the top object, one by one.

    An object without the key that has the key `single` is itself a record. What
    is neither gives none. As in any JSON reader, the last of several equal keys counts for a single record.
    """
    if walker.sign() != "{":
        if walker.sign():
            walker.value()
        return
    walker.need("{")
    lone, listed, first = {}, False, True
    while not walker.take("}"):
        if not first:
            walker.need(",")
        first = False
        name = walker.value()
        walker.need(":")
        if name == key and walker.sign() == "[":
            listed = True
            walker.need("[")
            begun = False
            while not walker.take("]"):
                if begun:
                    walker.need(",")
                begun = True
                found = walker.value()
                if isinstance(found, dict):
                    yield found
        else:
            found = walker.value()
            if single is not None and not listed:
                lone[name] = found
    if not listed and single is not None and lone.get(single) is not None:
        yield lone


class FilePart(InputPartition):
    def __init__(self, path):
        self.path = path


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.key, self.single = options["key"], options.get("single")

    def partitions(self):
        return [FilePart(p) for p in self.paths]

    def read(self, partition):
        for found in records(Walker(blocks_of(partition.path)), self.key, self.single):
            yield (json.dumps(found),)


class ArraySource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "record string"

    def reader(self, schema):
        return ArrayReader(self.options)


def blocks_of(path):
    """The text of a file in blocks."""
    from pyarrow import fs

    # Hadoop writes file:/a for a local path, Arrow file:///a.
    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    decoder = codecs.getincrementaldecoder("utf-8")()
    with system.open_input_stream(name) as source:
        while block := source.read(BLOCK):
            if text := decoder.decode(block):  # "" would be taken for the end
                yield text
        decoder.decode(b"", True)  # fails on half a character


def read_array_records(spark: SparkSession, path, key, schema, single=None) -> DataFrame:
    """One row for each element of the array `key` of every file of a path or pattern.

    `schema` is the schema of one element; what it does not name is left out. An element that is no
    object gives no row. Files are listed by Spark, so the path may be a folder or pattern.
    """
    spark.dataSource.register(ArraySource)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    paths = [r[0] for r in listing.filter(F.col("length") > 0).collect()]  # names of files, each large
    options = {"paths": json.dumps(sorted(paths)), "key": key, **({"single": single} if single else {})}
    if not paths:
        return spark.createDataFrame([], schema)
    texts = spark.read.format(NAME).options(**options).load()
    return texts.select(F.from_json("record", schema).alias("record")).select("record.*")
