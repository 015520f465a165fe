"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import HOT_KEYS, TASK_ROWS, bitmap, with_maybe, with_salt
from ..session import Scratch


def exactly_once(new: DataFrame, key: Column, order: list[Column], stored: DataFrame | None = None, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of all stored and new messages: of each ``key`` the row that is first by ``order``.

    Identifiers are split by their counted frequency. The repeated ones are written, and a bitmap of their hashes is sent to
    the scan: rows it does not know are singletons and pass from there as they are, without a shuffle. All others
    are ranked by identifier (singletons that the bitmap took for repeated ones come out first of one), and both parts are
    united. Rows of an identifier with more than ``task_rows`` rows are ranked in parts first, and then the parts' winners.

    ``key`` and ``order`` are expressions over the input's columns. Defined results: a null key is no
    identifier, such rows are all kept; nulls in ``order`` come last; of rows equal in the whole order one
    is kept; both inputs may be empty; all columns, under any names, come out as they went in. ``stored``
    must have the columns of ``new``.
    """
    rows = new if stored is None else stored.unionByName(new)
    names = rows.columns
    counted = rows.select(F.xxhash64(key).alias("h"), key.alias("k")).where("k is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    repeated = Scratch(rows.sparkSession, "repeated").write(counted, "keys")
    flat = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.xxhash64(key).alias("h"), key.alias("__key"), F.struct(*[x for o in order for x in (o.isNull(), o)]).alias("__order"))
    split = with_maybe(flat, bitmap(repeated, "h"), ["h"])
    # Two identifiers with one hash count as repeated; the ranks tell them apart.
    passed = split.where("__key is null or not __maybe").select("__row")
    some = split.where("__key is not null and __maybe").select("__row", "h", "__key", "__order")
    top = repeated.where(F.col("n") > task_rows)
    best = Window.partitionBy("__key").orderBy("__order")
    if top.limit(1).count():
        salts = _salts(top, task_rows)
        parts = Window.partitionBy("__key", "__salt").orderBy("__order")
        local = with_salt(some, "h", salts, F.col("__order")).withColumn("__local", F.row_number().over(parts))
        ranked = local.where("__local = 1").withColumn("__rank", F.row_number().over(best))
        losers = local.where("__local > 1").select("__row")
        return passed.union(ranked.where("__rank = 1").select("__row")).select("__row.*"), ranked.where("__rank > 1").select("__row").union(losers).select("__row.*")
    ranked = some.withColumn("__rank", F.row_number().over(best))
    return passed.union(ranked.where("__rank = 1").select("__row")).select("__row.*"), ranked.where("__rank > 1").select("__row.*")


def _salts(top: DataFrame, task_rows: int) -> DataFrame:
    """The table of hot keys from counts already made: (__h of h, __salts)."""
    most = top.orderBy(F.desc("n")).limit(HOT_KEYS)
    return most.select(F.xxhash64("h").alias("__h"), F.ceil(F.col("n") / task_rows).cast("int").alias("__salts"))
