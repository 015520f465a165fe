"""Joins, ranks and running sums that stay balanced when one key holds a third of the rows.

Nothing here depends on the number of cores, and no bound turns rows away: where a side is too large to be broadcast, the
same result comes from a salted shuffle join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Rows of one key that one task may get; keys with more are spread over as many tasks as it takes.
TASK_ROWS = 100_000
#: Keys in a table of hot keys at most (12 bytes each); beyond, those with the fewest rows are not spread.
HOT_KEYS = 100_000
#: Rows up to which a lookup table may be broadcast; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
#: Pieces over which an input is spread that its scan cuts into fewer.
PIECES = 16
#: Bits of a bitmap of key hashes at most: 16 MB, whatever the data.
BITMAP_BITS = 1 << 27
_WORD = 1 << 15


def spread(df: DataFrame) -> DataFrame:
    """The rows over :data:`PIECES` tasks, if the scan gives fewer; larger inputs stay where they lie.

    Only the layout changes; no result may depend on it.
    """
    return df.repartition(PIECES) if df.rdd.getNumPartitions() < PIECES else df


def _names(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def hot_keys(df: DataFrame, key: str | list[str], task_rows: int = TASK_ROWS) -> DataFrame | None:
    """(__h, __salts): hashes of the keys with more than ``task_rows`` rows, and over how many tasks to spread each; None if there are none.

    One pass with map-side aggregation over the key columns only.
    """
    names = _names(key)
    known = df.where(" and ".join(f"`{n}` is not null" for n in names))
    counts = known.groupBy(F.xxhash64(*names).alias("__h")).agg(F.count("*").alias("n")).where(F.col("n") > task_rows)
    top = counts.orderBy(F.desc("n")).limit(HOT_KEYS).collect()
    return df.sparkSession.createDataFrame([(r["__h"], -(-r["n"] // task_rows)) for r in top], "__h bigint, __salts int") if top else None


def with_salt(df: DataFrame, key: str | list[str], hot: DataFrame | None, by: Column) -> DataFrame:
    """Adds ``__salt``: which part of its key a row belongs to, by the hash of ``by``; 0 for keys that are not hot."""
    if hot is None:
        return df.withColumn("__salt", F.lit(0))
    marked = df.withColumn("__h", F.xxhash64(*_names(key))).join(F.broadcast(hot), "__h", "left")  # at most HOT_KEYS rows
    return marked.withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__h", "__salts")


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str, hot: DataFrame | None, by: Column) -> DataFrame:
    """Equi-join on ``key`` where rows of ``left`` with a hot key are spread over several tasks.

    ``right`` must hold few rows a key (an index); only its hot rows are copied, once for each part.
    ``by`` is any expression of ``left`` that varies within a key. ``how``: inner, left, left_semi, left_anti.
    """
    names = _names(key)
    if hot is None:
        return left.join(right, names, how)
    copies = right.withColumn("__h", F.xxhash64(*names)).join(F.broadcast(hot), "__h", "left")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__h", "__salts")
    return with_salt(left, names, hot, by).join(copies, [*names, "__salt"], how).drop("__salt")


def lookup(df: DataFrame, table: DataFrame, on: str | list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a lookup table of few rows a key: broadcast when a count proves it small, else by a salted shuffle."""
    if table.limit(most + 1).count() <= most:
        return df.join(F.broadcast(table), on, how)
    names = _names(on)
    varies = F.struct(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    return salted_join(df, table, names, how, hot_keys(df, names), varies)


class Bitmap(NamedTuple):
    """Which hashes of keys occur, in pieces of 4 KB."""

    pieces: DataFrame
    bits: int


def bitmap(keys: DataFrame, *columns: str) -> Bitmap:
    """A bitmap of the hashes of ``columns``, of 16 bits a row up to :data:`BITMAP_BITS`: at most 16 MB, whatever the number of keys.

    The rows are counted first, so they should be a written table.
    """
    bits = _WORD
    rows = 16 * keys.count()
    while bits < min(rows, BITMAP_BITS):
        bits *= 2
    place = keys.select(F.pmod(F.xxhash64(*columns), F.lit(bits)).alias("p"))
    pieces = place.groupBy(F.expr(f"cast(p div {_WORD} as int)").alias("__piece")).agg(F.bitmap_construct_agg(F.col("p") % _WORD).alias("__bits"))
    return Bitmap(pieces, bits)


def with_maybe(df: DataFrame, known: Bitmap, columns: list[str], flag: str = "__maybe") -> DataFrame:
    """Adds ``flag``: false if the key is surely not in the bitmap's set. Rows stay where they lie.

    A key that is in the set is always flagged; others are by chance, with the share of bits that are set. Whoever uses
    the flag must settle the flagged rows exactly.
    """
    placed = df.withColumn("__p", F.pmod(F.xxhash64(*[f"`{c}`" for c in columns]), F.lit(known.bits))).withColumn("__piece", F.expr(f"cast(__p div {_WORD} as int)"))
    byte = F.conv(F.hex(F.substring("__bits", F.expr(f"cast(__p % {_WORD} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    test = F.getbit(byte, F.expr("cast(__p % 8 as int)")) == 1
    return placed.join(F.broadcast(known.pieces), "__piece", "left").withColumn(flag, F.coalesce(test, F.lit(False))).drop("__p", "__piece", "__bits")


def blocked_sum(df: DataFrame, group: list[str], block: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Running sums before each row, in the order of (block, *order) within ``group``; ``values``: column summed by new column.

    Two levels: a window within each (group, block), and one over the block totals only. Blocks must be
    numbered in the wanted order and be small enough for one task.
    """
    inner = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, block).agg(*[F.sum(v).alias(f"__t_{o}") for o, v in values.items()])
    base = totals.select(*group, block, *[F.coalesce(F.sum(f"__t_{o}").over(outer), F.lit(0)).alias(f"__b_{o}") for o in values])
    own = df.withColumns({f"__i_{o}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for o, v in values.items()})
    both = own.join(base, [*group, block], "left").withColumns({o: F.col(f"__b_{o}") + F.col(f"__i_{o}") for o in values})
    return both.drop(*[f"__{x}_{o}" for o in values for x in "ib"])


def exclusive_sum(df: DataFrame, group: list[str], order: list[str], values: dict[str, str], per_task: int = TASK_ROWS) -> DataFrame:
    """Running sums before each row in the order of ``order`` within ``group`` (not null); ``values``: column summed by new column.

    The rows, which should be narrow, are written once; blocks are ranges of (group, order) of about ``per_task`` rows,
    so neither a large group nor gaps in the order make a large task.
    """
    scratch = Scratch(df.sparkSession, "sums")
    rows = scratch.write(df, "rows")
    blocks = -(-rows.count() // per_task)
    if blocks > 1:  # the ranges come from a sample of the keys, so they are fixed by writing
        rows = scratch.write(rows.repartitionByRange(blocks, *group, *order).withColumn("__block", F.spark_partition_id()), "blocks")
    else:
        rows = rows.withColumn("__block", F.lit(0))
    return blocked_sum(rows, group, "__block", order, values).drop("__block")


def random_rank(df: DataFrame, group: list[str], random: str, tie: list[str], rows: int, out: str, per_task: int = TASK_ROWS) -> DataFrame:
    """``row_number`` of each row within ``group`` by the hash in ``random`` (ties by ``tie``), without a hot task.

    A hash is uniform, so equal ranges of it are equal shares of any group: rows are ranked within
    (group, range), and the ranks of earlier ranges are added from a table of counts.
    """
    ranges = max(1, -(-rows // per_task))
    # Doubles round, but never turn the order of two hashes round.
    block = F.least(F.lit(ranges - 1), F.floor((F.col(random).cast("double") / 2.0**64 + 0.5) * ranges).cast("int"))
    cut = df.withColumn("__block", block).withColumn("__one", F.lit(1).cast("bigint"))
    ranked = blocked_sum(cut, group, "__block", [random, *tie], {"__before": "__one"})
    return ranked.withColumn(out, F.col("__before") + 1).drop("__block", "__one", "__before")
