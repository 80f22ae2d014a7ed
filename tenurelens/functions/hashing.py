"""Signed character hashing of a text column into a few integer columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tenurelens.functions.nullsafe import _column

SIGN_UNIT = 1024


def portable_hash(text: Column) -> Column:
    """First 32 bits of the MD5 digest as a bigint; the same on any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def char_hash(text: Column | str, buckets: int, prefix: str) -> list[Column]:
    """``prefix_0 .. prefix_{n-1}``: per bucket, the signed count of characters.

    A character adds +1 or -1 to the bucket its hash names. Empty and missing
    text give zeros.
    """
    chars = F.filter(F.split(F.coalesce(_column(text), F.lit("")), ""), lambda c: c != "")
    hashes = F.transform(chars, portable_hash)

    def step(acc: Column, h: Column) -> Column:
        sign = F.when((F.floor(h / SIGN_UNIT) % 2) == 0, 1).otherwise(-1)
        return F.struct(
            *[
                (acc[f"b{b}"] + F.when(h % buckets == b, sign).otherwise(0)).alias(f"b{b}")
                for b in range(buckets)
            ]
        )

    zero = F.struct(*[F.lit(0).alias(f"b{b}") for b in range(buckets)])
    counts = F.aggregate(hashes, zero, step)
    return [counts[f"b{b}"].alias(f"{prefix}_{b}") for b in range(buckets)]


def key_hash(salt: int, *keys: Column | str) -> Column:
    """Stable 32-bit hash of a row key, independent of partitioning."""
    parts = [F.coalesce(_column(k).cast("string"), F.lit("")) for k in keys]
    return portable_hash(reduce(lambda a, b: F.concat(a, F.lit("|"), b), parts, F.lit(str(salt))))


def key_bucket(modulus: int, salt: int, *keys: Column | str) -> Column:
    """Stable bucket 0..modulus-1 of a row key."""
    return (key_hash(salt, *keys) % modulus).cast("int")
