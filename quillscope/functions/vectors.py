"""Vectors of eight channel counts: the Walsh-Hadamard transform and vector algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, bind

SIZE = 8


def walsh(v: Column) -> Column:
    """W[k] = sum over j of (-1)^popcount(k & j) * v[j], in natural order; its own inverse but for a factor of 8."""
    def of(v: Column) -> Column:
        sums = []
        for k in range(SIZE):
            total = at(v, 0)
            for j in range(1, SIZE):
                total = total - at(v, j) if (k & j).bit_count() % 2 else total + at(v, j)
            sums.append(total)
        return F.array(*sums)

    return bind(v, of)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, by: Column | int) -> Column:
    by = F.lit(by) if isinstance(by, int) else by
    return F.transform(v, lambda x: x * by)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)


def l1_norm(v: Column) -> Column:
    return total(F.transform(v, F.abs))


def dc(w: Column) -> Column:
    return at(w, 0)


def detail_energy(w: Column) -> Column:
    """Sum of the sizes of all coefficients but the first."""
    return l1_norm(F.slice(w, 2, SIZE - 1))


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def error_detect(observed: Column, reference: Column) -> Column:
    """(channel, error) where the vectors differ most, the first of ties; (-1, 0) where they are equal."""
    def of(d: Column) -> Column:
        sizes = F.transform(d, F.abs)
        k = (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int")
        none = F.array_max(sizes) == 0
        return F.struct(F.when(none, -1).otherwise(k).alias("channel"), F.when(none, 0).otherwise(F.get(d, k)).cast("bigint").alias("error"))

    return bind(sub(observed, reference), of)


def correct(observed: Column, channel: Column, value: Column) -> Column:
    """The vector with one channel replaced; unchanged for a channel that is none."""
    return F.transform(observed, lambda x, i: F.when(i == channel, value).otherwise(x))
