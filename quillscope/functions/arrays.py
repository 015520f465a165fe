"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def at(array: Column, i: int | Column) -> Column:
    return F.get(array, F.lit(i) if isinstance(i, int) else i)


def longs(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])
