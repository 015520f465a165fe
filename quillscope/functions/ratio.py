"""Exact rational numbers as struct<num, denom>, reduced, with a denominator over 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid, in as many steps as numbers of this size can need (at most 93)."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    steps = (F.log2(F.least(F.abs(a), F.abs(b)).cast("double") + 1) * 1.4405).cast("int") + 2
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])


def new(num: Column | int, denom: Column | int) -> Column:
    """The reduced ratio; a denominator of 0 is an error."""
    def of(x: Column) -> Column:
        n, d = x["n"], x["d"]
        return bind(gcd(n, d), lambda g: F.struct(F.when(d < 0, -n).otherwise(n).alias("num"), d.alias("denom"), g.alias("g")))

    parts = F.struct(_long(num).alias("n"), _long(denom).alias("d"))
    safe = F.when(parts["d"] == 0, F.raise_error(F.lit("ratio with a denominator of 0")).cast("bigint")).otherwise(parts["d"])
    checked = F.struct(parts["n"].alias("n"), safe.alias("d"))
    return bind(bind(checked, of), lambda r: F.struct(F.call_function("div", r["num"], r["g"]).alias("num"), F.call_function("div", F.abs(r["denom"]), r["g"]).alias("denom")))


def add(a: Column, b: Column) -> Column:
    return new(a["num"] * b["denom"] + b["num"] * a["denom"], a["denom"] * b["denom"])


def sub(a: Column, b: Column) -> Column:
    return new(a["num"] * b["denom"] - b["num"] * a["denom"], a["denom"] * b["denom"])


def mul(a: Column, b: Column) -> Column:
    return new(a["num"] * b["num"], a["denom"] * b["denom"])


def div(a: Column, b: Column) -> Column:
    """An error if ``b`` is 0."""
    return new(a["num"] * b["denom"], a["denom"] * b["num"])


def neg(a: Column) -> Column:
    return F.struct((-a["num"]).alias("num"), a["denom"].alias("denom"))


def absolute(a: Column) -> Column:
    return F.struct(F.abs(a["num"]).alias("num"), a["denom"].alias("denom"))


def less(a: Column, b: Column) -> Column:
    return a["num"] * b["denom"] < b["num"] * a["denom"]


def less_eq(a: Column, b: Column) -> Column:
    return a["num"] * b["denom"] <= b["num"] * a["denom"]


def equal(a: Column, b: Column) -> Column:
    return a["num"] * b["denom"] == b["num"] * a["denom"]


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def is_zero(a: Column) -> Column:
    return a["num"] == 0


def is_positive(a: Column) -> Column:
    return a["num"] > 0


def is_negative(a: Column) -> Column:
    return a["num"] < 0


def to_double(a: Column) -> Column:
    return F.when(a["denom"] == 0, 0.0).otherwise(a["num"] / a["denom"])


def scale_int(a: Column, by: Column | int) -> Column:
    """floor towards 0 of a x by."""
    return F.call_function("div", a["num"] * _long(by), a["denom"])


def largest(a: Column, b: Column) -> Column:
    return F.when(less(a, b), b).otherwise(a)


def smallest(a: Column, b: Column) -> Column:
    return F.when(less(b, a), b).otherwise(a)


def clamp(a: Column, lo: Column, hi: Column) -> Column:
    return smallest(largest(a, lo), hi)


def text(a: Column) -> Column:
    return F.concat_ws("/", a["num"].cast("string"), a["denom"].cast("string"))
