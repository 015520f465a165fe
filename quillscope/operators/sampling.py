"""Deterministic samplers: every k-th row, and the first n of each group in a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import exclusive_sum


def every_kth(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Every k-th row by the whole number ``order``, k = max(1, rows / n), until there are ``n``."""
    k = max(1, rows.count() // max(n, 1))
    ranked = exclusive_sum(rows.withColumn("__one", F.lit(1).cast("bigint")), [], [order], {"__i": "__one"})
    return ranked.where(f"__i % {k} = 0 and __i div {k} < {n}").drop("__one", "__i")


def per_group(rows: DataFrame, group: str, key: Column, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of each group in the order of an MD5 of key and seed, the same in every engine.

    Rows are thinned in salted parts first, so a group of any size never meets in one task whole.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))))
    salted = hashed.withColumn("__s", F.substring("__h", -2, 2))
    part = Window.partitionBy(group, "__s").orderBy("__h")
    thin = salted.withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= n)
    whole = Window.partitionBy(group).orderBy("__h")
    return thin.withColumn("__n", F.row_number().over(whole)).where(F.col("__n") <= n).drop("__h", "__s", "__n")
