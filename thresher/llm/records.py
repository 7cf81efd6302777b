"""Token ids as length-delimited binary records with an offset index.

A record file is a row of frames; a frame is

    length of the payload   8 bytes, little-endian
    masked CRC-32C of those 8 bytes   4 bytes
    payload   1 if there is a doc_id or else 0, doc_id as 8 bytes, then the ids as 2 bytes each
    masked CRC-32C of the payload   4 bytes

which is the framing of TFRecord files, so their readers can open the files. The mask
turns a checksum right by 15 bits and adds a constant, so that checksums of data that
holds checksums stay useful. Beside `x.records` lies `x.offsets`: per frame its place
in the file and its number of ids, 8 bytes each, for shuffled reads.

Each task writes its files under a name of its own and reports their chunks as rows;
only the rows of the attempt that Spark commits are kept, so a lost executor or a
speculative copy leaves at most files that nothing refers to.

Null texts are empty documents (the end id alone); empty tables give no files. Other
columns of the input are ignored. Repeated doc_ids stay separate records, and so do those without
a doc_id, which come first.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, slices
from thresher.llm.tokens import END_ID, ID_TYPE, encoder, vocabulary_path
from thresher.session import fresh_path, pinned

MASK = 0xA282EAD8
POLYNOMIAL = 0x82F63B78  # CRC-32C, bits reversed
BLOCK = 1024
HEADER = 12
FOOTER = 4
HEAD = 9  # of a payload
# Hadoop's names of stores and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
CHUNK_BYTES = 4 << 20
END = np.array([END_ID], ID_TYPE).tobytes()

CHUNKS = ("path string, part int, chunk int, first_byte long, bytes long, first_record long, records long, "
          "tokens_before long, tokens long")
READ = "doc_id long, part int, record long, start_in_part long, n_tokens long, ids_crc32 long, offset_ok boolean"


# --- checksums -----------------------------------------------------------------------


@lru_cache(maxsize=1)
def checksum_tables():
    """What each byte value adds to a checksum from each place of a block, and the shift by a block."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    places = np.empty((BLOCK, 256), np.uint32)
    places[BLOCK - 1] = table
    for i in range(BLOCK - 2, -1, -1):
        places[i] = (places[i + 1] >> 8) ^ table[places[i + 1] & 0xFF]
    # A checksum that a whole block follows: its four bytes meet the first four places.
    return places, places[:4]


def crc32c(payloads):
    """CRC-32C of each of many byte strings, block by block over all of them at once."""
    places, shift = checksum_tables()
    sizes = np.array([len(p) for p in payloads], np.int64)
    crc = np.zeros(len(payloads), np.uint32)
    if not len(payloads):
        return crc
    padded = np.maximum(1, -(-np.maximum(sizes, 4) // BLOCK)) * BLOCK
    ends = np.cumsum(padded)
    data = np.zeros(ends[-1], np.uint8)
    short = sizes < 4
    for payload, end, size in zip(payloads, ends, sizes):  # zeros in front change nothing
        data[end - size:end] = np.frombuffer(payload, np.uint8)
    for i in range(4):  # the usual start value
        spots = (ends - sizes + i)[~short]
        data[spots] ^= 0xFF
    blocks = data.reshape(-1, BLOCK)
    partial = np.empty(len(blocks), np.uint32)
    base = (np.arange(BLOCK, dtype=np.int64) * 256)[None, :]
    flat = places.ravel()
    for start in range(0, len(blocks), 256):
        partial[start:start + 256] = np.bitwise_xor.reduce(flat[base + blocks[start:start + 256]], axis=1)
    counts = padded // BLOCK
    firsts = np.cumsum(counts) - counts
    for step in range(int(counts.max())):
        on = np.flatnonzero(counts > step)
        c = crc[on]
        moved = shift[0][c & 0xFF] ^ shift[1][(c >> 8) & 0xFF] ^ shift[2][(c >> 16) & 0xFF] ^ shift[3][c >> 24]
        crc[on] = moved ^ partial[firsts[on] + step]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(short):
        c, table = 0xFFFFFFFF, places[BLOCK - 1]
        for byte in payloads[i]:
            c = (c >> 8) ^ int(table[(c ^ byte) & 0xFF])
        crc[i] = c ^ 0xFFFFFFFF
    return crc


def masked(crc):
    crc = crc.astype(np.uint64)
    return ((((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(MASK)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def frames(payloads):
    """The payloads framed."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    of_length, of_payload = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [n + a.tobytes() + p + b.tobytes() for n, a, p, b in zip(lengths, of_length, payloads, of_payload)]


def payloads_of(data, offsets):
    """The payloads of the frames at `offsets`; an error if a checksum differs."""
    lengths = [data[o:o + 8] for o in offsets]
    found = [data[o + HEADER:o + HEADER + int.from_bytes(n, "little")] for o, n in zip(offsets, lengths)]
    kept = np.array([[int.from_bytes(data[o + 8:o + 12], "little"), int.from_bytes(data[o + HEADER + len(p):o + HEADER + len(p) + 4], "little")]
                     for o, p in zip(offsets, found)], np.uint32).reshape(-1, 2)
    if (masked(crc32c(lengths)) != kept[:, 0]).any() or (masked(crc32c(found)) != kept[:, 1]).any():
        raise ValueError("a record is damaged: its checksum differs")
    return found


# --- files -----------------------------------------------------------------------------


def head_of(doc_id):
    """A payload begins with a byte that tells whether there is an id, and the id."""
    return bytes([doc_id is not None]) + int(doc_id or 0).to_bytes(8, "little", signed=True)


def id_of(payload):
    return int.from_bytes(payload[1:HEAD], "little", signed=True) if payload[0] else None


def file_system(path):
    """The file system of a path and the path on it; any store that Arrow knows, also by Hadoop's names for it."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")


def write_files(batches, folder, vocabulary):
    """Writes the texts of one task, in order, and yields its chunks."""
    from pyspark import TaskContext

    schema, part = arrow(CHUNKS), TaskContext.get().partitionId()
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    encode = encoder(vocabulary).encode_all
    rows, state = [], {"byte": 0, "record": 0, "tokens": 0}
    records = offsets = None

    def put(ids, counts):
        nonlocal records, offsets
        if records is None:
            records = system.open_output_stream(f"{place}.records")
            offsets = system.open_output_stream(f"{place}.offsets")
        framed = frames(ids)
        sizes = np.array([len(f) for f in framed], np.int64)
        spots = state["byte"] + np.cumsum(sizes) - sizes
        records.write(b"".join(framed))
        offsets.write(np.column_stack([spots, counts]).astype("<i8").tobytes())
        rows.append((path, part, len(rows), state["byte"], int(sizes.sum()), state["record"], len(framed), state["tokens"], int(counts.sum())))
        state["byte"] += int(sizes.sum())
        state["record"] += len(framed)
        state["tokens"] += int(counts.sum())

    waiting, held = [], 0
    for one in slices(batches):
        for doc_id, ids in zip(one.column(0).to_pylist(), encode(one.column(1).to_pylist())):
            waiting.append(head_of(doc_id) + ids + END)
            held += len(waiting[-1])
            if held >= CHUNK_BYTES:
                put(waiting, np.array([(len(w) - HEAD) // 2 for w in waiting], np.int64))
                waiting, held = [], 0
    if waiting:
        put(waiting, np.array([(len(w) - HEAD) // 2 for w in waiting], np.int64))
    if records is not None:
        records.close()
        offsets.close()
    yield batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))


def read_chunks(batches):
    """Reads the chunks that the rows name and yields what each record holds."""
    schema = arrow(READ)
    for one in batches:
        for row in one.to_pylist():
            system, place = file_system(row["path"])
            with system.open_input_file(f"{place}.records") as source:
                data = source.read_at(row["bytes"], row["first_byte"])
            with system.open_input_file(f"{place}.offsets") as source:
                index = np.frombuffer(source.read_at(16 * row["records"], 16 * row["first_record"]), "<i8").reshape(-1, 2)
            found = payloads_of(data, (index[:, 0] - row["first_byte"]).tolist())
            counts = np.array([(len(p) - HEAD) // 2 for p in found], np.int64)
            crc = [zlib.crc32(np.frombuffer(p, ID_TYPE, offset=HEAD).astype("<u4").tobytes()) for p in found]
            yield batch(
                schema, [id_of(p) for p in found], np.full(len(found), row["part"], np.int32),
                row["first_record"] + np.arange(len(found)), row["tokens_before"] + np.cumsum(counts) - counts, counts, crc,
                counts == index[:, 1])


def write_records(documents: DataFrame, folder=None, vocabulary=None) -> DataFrame:
    """Writes `documents` in ascending doc_id order; returns the chunks of the files.

    Rows are range-partitioned, so files follow each other in doc_id order and no task
    sees more than its range. The returned table is the only list of valid files.
    """
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "records")
    vocabulary = vocabulary or vocabulary_path()
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return pinned(ordered.mapInArrow(lambda batches: write_files(batches, folder, vocabulary), CHUNKS))


def read_records(chunks: DataFrame) -> DataFrame:
    """Per record its doc_id, place, number of ids and their CRC-32, read from the files.

    The parts, one row per task that wrote, are totalled in one window; records are not.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("tokens").alias("_tokens"))
    starts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))
    # A row here is megabytes of work, so their number and not their bytes decides how they are dealt.
    spread = chunks.repartition(max(1, chunks.count() // 2), "path", "chunk")
    read = spread.mapInArrow(read_chunks, READ)
    return read.join(starts, F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", "part", "record",
        "offset_ok")


def read_shuffled(chunks: DataFrame, seed=0, epoch=0) -> DataFrame:
    """The doc_id and ids of all records, in an order drawn from the seed and the epoch.

    Chunks are dealt to tasks by a digest and read through the offset index, and the
    records of a task are ordered by another, so no record is shuffled by Spark.
    """
    dealt = chunks.repartition(F.xxhash64(F.col("path"), F.col("chunk"), F.lit(seed), F.lit(epoch)))

    def read(batches):
        schema = arrow("doc_id long, ids array<int>")
        for one in batches:
            for row in one.to_pylist():
                system, place = file_system(row["path"])
                with system.open_input_file(f"{place}.offsets") as source:
                    index = np.frombuffer(source.read_at(16 * row["records"], 16 * row["first_record"]), "<i8").reshape(-1, 2)
                with system.open_input_file(f"{place}.records") as source:
                    data = source.read_at(row["bytes"], row["first_byte"])
                order = np.random.default_rng([seed, epoch, row["part"], row["chunk"]]).permutation(len(index))
                found = payloads_of(data, (index[order, 0] - row["first_byte"]).tolist())
                yield batch(schema, [id_of(p) for p in found],
                            [np.frombuffer(p, ID_TYPE, offset=HEAD).astype(np.int32) for p in found])

    return dealt.mapInArrow(read, "doc_id long, ids array<int>")


@query()
def op1_token_records(spark, sf_dir):
    """Every document's place in the record files, read back from them."""
    return read_records(write_records(table(spark, sf_dir, "documents")))
