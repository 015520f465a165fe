"""Tables of fixed thresholds, compiled into one projection."""

from __future__ import annotations

from functools import reduce
from operator import ge, gt, le, lt
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bind

__all__ = ["CHARS", "LINE_BREAKS", "Rule", "any_of", "bind", "count_chars", "failures", "fails", "measured", "words"]

LINE_BREAKS = r"[\r\n\x{85}\x{2028}\x{2029}]+"
_OPS = {"<": lt, "<=": le, ">": gt, ">=": ge}


class Rule(NamedTuple):
    """The text fails for ``reason`` if its ``statistic`` is beyond the bound, and ``least`` (a statistic and its least value) holds.

    ``source`` says where the threshold was published, or that it is this project's own.
    """

    reason: str
    statistic: str
    op: str
    bound: float
    source: str
    least: tuple[str, float] | None = None


def _test(rule: Rule, statistics: Column | dict[str, Column]) -> Column:
    test = _OPS[rule.op](statistics[rule.statistic], F.lit(rule.bound))
    return test if rule.least is None else (statistics[rule.least[0]] >= rule.least[1]) & test


def failures(rules: list[Rule], statistics: Column) -> Column:
    """The reasons for which the statistics (a struct) fail, in the order of the table; empty if none."""
    return F.filter(F.array(*[F.when(_test(r, statistics), F.lit(r.reason)) for r in rules]), lambda x: x.isNotNull())


def fails(rules: list[Rule], statistics: dict[str, Column]) -> Column:
    """Whether any rule of the table holds; later ones are not evaluated then."""
    return any_of([_test(r, statistics) for r in rules])


def measured(rules: list[Rule], statistics: Column, names: list[str]) -> Column:
    """An array of one struct: the statistics and ``reasons``. A generator over it makes the optimiser keep it as one evaluation a text."""
    with_reasons = lambda s: F.struct(*[s[n].alias(n) for n in names], F.when(s.isNull(), F.array(F.lit("null"))).otherwise(failures(rules, s)).alias("reasons"))
    return F.transform(F.array(statistics), with_reasons)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def words(text: Column) -> Column:
    """Maximal runs of letters or digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def count_chars(text: Column, others: str) -> Column:
    """Characters of the text that are in a class, given the pattern of all others."""
    return F.length(F.regexp_replace(text, others, ""))


#: Pattern of all characters but symbols and punctuation.
CHARS = r"[\p{L}\p{N}\s]+"
