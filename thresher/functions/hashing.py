"""Digests and everything decided by a digest: splits, choices, short names.

SHA-256 rather than Spark's own hash functions, so that a split can be reproduced
outside Spark and never changes with a release.
"""

from __future__ import annotations

from pyspark.sql import functions as F


def as_column(value):
    return F.col(value) if isinstance(value, str) else value


def digest(value, n=64):
    """First `n` hex digits of the SHA-256 of a string or binary column."""
    full = F.sha2(as_column(value), 256)
    return full if n >= 64 else F.substring(full, 1, n)


def short_name(prefix, value, n):
    """Content-addressed name: a prefix and the first `n` hex digits of the digest."""
    return F.concat(F.lit(prefix), digest(value, n))


def hash_number(value, start=0, length=8):
    """The hex digits [start, start+length) of the digest, as a number."""
    return F.conv(F.substring(F.sha2(as_column(value).cast("string"), 256), start + 1, length), 16, 10).cast("bigint")


def hash_split(value, modulus, bounds, default):
    """Split name by digest bucket: the first of `bounds` (name, upper) the bucket lies below.

    The names are listed per bucket, so that the digest is computed once per use.
    """
    named = [next((name for name, upper in bounds if bucket < upper), default) for bucket in range(modulus)]
    return F.element_at(F.array(*[F.lit(n) for n in named]), (hash_number(value) % modulus + 1).cast("int"))


def split_80_10_10(value):
    """Of ten buckets, the first is val, the second test, the rest train."""
    return hash_split(value, 10, (("val", 1), ("test", 2)), "train")


def split_70_15_15(value):
    """Of a hundred buckets, 70 are train, the next 15 val, the rest test."""
    return hash_split(value, 100, (("train", 70), ("val", 85)), "test")


def hash_choice(value, options):
    """One of `options`, chosen by hex digits 16..24 of the digest."""
    picked = F.pmod(hash_number(value, 16, 8), F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), picked + 1)


def seeded(seed, *parts):
    """`seed:part:part...`, the string that seeded orders hash; a null part is empty."""
    return F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts])
