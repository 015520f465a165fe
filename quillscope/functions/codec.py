"""Fixed-width keys in hexadecimal, for exchange with stores that sort by bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_hash(tag: Column) -> Column:
    """The first eight bytes of the SHA-256 of a tag, in hexadecimal."""
    return F.substring(F.sha2(tag, 256), 1, 16)


def u32(x: Column) -> Column:
    """Four bytes, the highest first."""
    return F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")


def u8(x: Column) -> Column:
    return F.lpad(F.hex(x.bitwiseAND(F.lit(0xFF))), 2, "0")


def key(prefix: str, *parts: Column) -> Column:
    """A prefix of letters and parts of fixed width."""
    return F.concat(F.lit(prefix.encode().hex().upper()), *[F.upper(p) for p in parts])


def read_u32(hexed: Column, at: int) -> Column:
    """The number in the four bytes that start at byte ``at``."""
    return F.conv(F.substring(hexed, at * 2 + 1, 8), 16, 10).cast("bigint")


def prefix_end(hexed: Column) -> Column:
    """The least key over all keys with a prefix; null if there is none (no byte but FF)."""
    kept = F.regexp_replace(F.upper(hexed), "^((?:[0-9A-F]{2})*?)(?:FF)*$", "$1")
    last = F.conv(F.substring(kept, -2, 2), 16, 10).cast("bigint") + 1
    return F.when(kept != "", F.concat(F.substring(kept, F.lit(1), F.length(kept) - 2), F.lpad(F.hex(last), 2, "0")))


def u64(x: Column) -> Column:
    """Eight bytes, the highest first; negative numbers as their two's complement."""
    return F.lpad(F.hex(x.cast("bigint")), 16, "0")


def read_u64(hexed: Column, at: int) -> Column:
    """The signed number in the eight bytes that start at byte ``at``."""
    half = lambda i: F.conv(F.substring(hexed, i * 2 + 1, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(at), 32).bitwiseOR(half(at + 4))


def pair_value(num: Column, denom: Column) -> Column:
    """A ratio as sixteen bytes."""
    return F.concat(u64(num), u64(denom))


def read_pair(hexed: Column) -> Column:
    """struct(num, denom) of :func:`pair_value`; 0/1 if there are too few bytes, and a denominator of 0 is read as 1."""
    short, denom = F.length(hexed) < 32, read_u64(hexed, 8)
    return F.struct(F.when(short, 0).otherwise(read_u64(hexed, 0)).cast("bigint").alias("num"), F.when(short | (denom == 0), 1).otherwise(denom).cast("bigint").alias("denom"))


def health_value(occupied: Column, total: Column, num: Column, denom: Column) -> Column:
    """Two counts and a ratio as 24 bytes."""
    return F.concat(u32(occupied), u32(total), pair_value(num, denom))


def read_health(hexed: Column) -> Column:
    """struct(occupied, total, num, denom); zeros and 0/1 if there are too few bytes."""
    short = F.length(hexed) < 48
    ratio = read_pair(F.when(short, F.lit("")).otherwise(F.substring(hexed, 17, 32)))
    count = lambda at: F.when(short, 0).otherwise(read_u32(hexed, at)).cast("bigint")
    return F.struct(count(0).alias("occupied"), count(4).alias("total"), ratio["num"].alias("num"), ratio["denom"].alias("denom"))


def counts_value(*counts: Column) -> Column:
    """Counts of four bytes each."""
    return F.concat(*[u32(c) for c in counts])


def read_counts(hexed: Column, n: int) -> Column:
    """Array of ``n`` counts; zeros if there are too few bytes."""
    return F.when(F.length(hexed) < 8 * n, F.array_repeat(F.lit(0).cast("bigint"), n)).otherwise(F.array(*[read_u32(hexed, 4 * i) for i in range(n)]))
