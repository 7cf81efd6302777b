"""Words, shingles and Arrow batches inside tasks.

Words are `[^\\x20\\x09-\\x0D]+`, which is how Python splits bytes; lower-casing bytes
touches A-Z only. Hashes are 64 bits, kept as signed longs wherever Spark sees them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Odd multipliers of the shingle and of the finishing mix.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)


def words_of(text, lower=True):
    """The words of a text as bytes; none for a null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words):
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(values):
    """Spreads the bits of 64-bit values."""
    values = values ^ (values >> SHIFT)
    values = values * MIX_A
    values = values ^ (values >> SHIFT)
    values = values * MIX_B
    return values ^ (values >> SHIFT)


def shingles(hashes, size):
    """The hash of each window of `size` words, in order; of the whole text if it is shorter."""
    size = min(size, len(hashes))
    if not size:
        return np.empty(0, np.uint64)
    windows = len(hashes) - size + 1
    total = hashes[:windows].copy()
    for i in range(1, size):
        total = total * STEP + hashes[i:i + windows]
    return mix(total + np.uint64(size))


def digest(values) -> int:
    """A signed 64-bit hash of an array."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def signed(values):
    return np.ascontiguousarray(values).view(np.int64)


KINDS = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(),
         "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<string>": pa.list_(pa.string())}


def arrow(ddl):
    """The Arrow schema of `"name kind, ..."`."""
    return pa.schema([pa.field(*part.split(" ", 1)[:1], KINDS[part.split(" ", 1)[1]]) for part in ddl.split(", ")])


def batch(schema, *columns):
    """A record batch of columns in the order of the schema."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def slices(batches, limit=2_000, most=4 << 20):
    """Batches cut to at most `limit` rows and about `most` bytes of text, so that a task holds few texts at once.

    Workers outlive their tasks, so what Arrow keeps for later goes back at the end.
    """
    for one in batches:
        upto = np.zeros(one.num_rows + 1, np.int64)
        for column in one.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < one.num_rows:
            stop = min(start + limit, max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1))
            yield one.slice(start, stop - start)
            start = stop
    del batches
    pa.default_memory_pool().release_unused()
