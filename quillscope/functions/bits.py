"""States of three and of six lines as small integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(t: Column, i: int) -> Column:
    """Line ``i`` (0 bonding, 1 constraint, 2 energy) of a trigram."""
    return F.shiftright(t, i).bitwiseAND(F.lit(1)) == 1


def with_bit(t: Column, i: int, on: Column | bool) -> Column:
    on = F.lit(on) if isinstance(on, bool) else on
    return F.when(on, t.bitwiseOR(F.lit(1 << i))).otherwise(t.bitwiseAND(F.lit(7 & ~(1 << i))))


def flip(t: Column, i: Column) -> Column:
    """The trigram with line ``i`` turned; unchanged for a line over 2."""
    return F.when((i >= 0) & (i <= 2), t.bitwiseXOR(F.call_function("shiftleft", F.lit(1), i.cast("int")))).otherwise(t)


def hexagram(inner: Column, outer: Column) -> Column:
    return inner.bitwiseOR(F.shiftleft(outer, 3))


def inner(h: Column) -> Column:
    return h.bitwiseAND(F.lit(7))


def outer(h: Column) -> Column:
    return F.shiftright(h, 3).bitwiseAND(F.lit(7))


def move_line(h: Column, i: Column) -> Column:
    """The hexagram with line ``i`` (0 to 5, the inner ones first) turned."""
    return F.when((i >= 0) & (i <= 5), h.bitwiseXOR(F.call_function("shiftleft", F.lit(1), i.cast("int")))).otherwise(h)
