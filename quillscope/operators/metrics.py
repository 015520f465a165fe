"""Metric tables indexed by generation, with trends, latest values and a digest.

Each table is a DataFrame (or a folder of Parquet files, see :class:`MetricStore`); its key columns make a write idempotent:
of rows with the same key the last written holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key columns of each table. ``type_sig`` and ``missing`` have the count in the key: another count is another row.
KEYS = {
    "generations": ["gen"], "type_sig": ["tag", "count", "gen"], "bonds": ["tag", "gen", "site"], "missing": ["tag", "gen", "count"],
    "connectivity": ["tag", "gen"], "fitness": ["dim", "gen"], "health": ["gen"], "hex_ops": ["op", "gen"], "lock_in": ["bucket", "gen"],
    "snapshots": ["gen"], "ewma_state": ["gen"], "adsr": ["gen"], "file_scores": ["path"], "walker": ["one"], "oracle_state": ["one"],
    "oracle_history": ["seq", "gen"], "oracle_results": ["seq", "hash"], "profiles": ["gen"], "model_spores": ["name"], "convergence": ["gen"],
}
EXPLORE, NUCLEATE = 6, 3


class MetricStore:
    """Folders of Parquet, one a table; appends carry the number of their write, reads give the last row of each key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.writes = spark, root.rstrip("/"), 0

    def record(self, table: str, rows: DataFrame) -> None:
        missing = set(KEYS[table]) - set(rows.columns)
        if missing:
            raise ValueError(f"{table} lacks the key columns {sorted(missing)}")
        self.writes += 1
        rows.withColumn("__write", F.lit(self.writes)).write.mode("append").parquet(f"{self.root}/{table}")

    def read(self, table: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        return last_written(rows, KEYS[table], "__write").drop("__write")

    def add_scores(self, rows: DataFrame) -> None:
        """Add to the running scores of files: (path, accreted, raw)."""
        self.writes += 1
        rows.withColumn("__write", F.lit(self.writes)).write.mode("append").parquet(f"{self.root}/file_score_parts")

    def scores(self) -> DataFrame:
        return file_scores(self.spark.read.parquet(f"{self.root}/file_score_parts"))


def last_written(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of the rows with the same key the one of the highest version, by aggregation."""
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), version).alias("__r"))
    return last.select(*key, *[F.col("__r")[c].alias(c) for c in others])


def file_scores(parts: DataFrame) -> DataFrame:
    return parts.groupBy("path").agg(F.sum("accreted").alias("accreted"), F.sum("raw").alias("raw"))


def last_n(rows: DataFrame, order: list[str], n: int, per: str | None = None) -> DataFrame:
    """The last ``n`` rows by ``order`` (of each ``per``); all of them if n is 0 or less."""
    if n <= 0:
        return rows
    down = [F.col(c).desc() for c in order]
    if per is None:
        return rows.orderBy(*down).limit(n).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(*down))).where(F.col("__n") <= n).drop("__n")


def type_trend(type_sig: DataFrame, n: int, order: str = "count", per: str | None = None) -> DataFrame:
    """Last points of a tag; the default order is that of the stored key, by count and then by generation."""
    return last_n(type_sig, ["count", "gen"] if order == "count" else ["gen", "count"], n, per)


def latest(rows: DataFrame, by: str = "gen") -> DataFrame:
    return rows.orderBy(F.col(by).desc()).limit(1)


def oracle_history(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` readings by (seq, gen); none if n is 0 or less."""
    return rows.limit(0) if n <= 0 else last_n(rows, ["seq", "gen"], n)


def bond_counts(bonds: DataFrame) -> DataFrame:
    """(tag, gen, bonds): distinct sites."""
    return bonds.select("tag", "gen", "site").distinct().groupBy("tag", "gen").agg(F.count("*").alias("bonds"))


def bond_history(bonds: DataFrame, n: int) -> DataFrame:
    """The last ``n`` generations of each tag with their counts of bonds."""
    return last_n(bond_counts(bonds), ["gen"], n, "tag")


def bond_rates(type_sig: DataFrame, bonds: DataFrame) -> DataFrame:
    """(tag, rate): bonds by count at the last point, in the order of counts, with a count over 0; no bonds are 0."""
    points = type_sig.where("count > 0").groupBy("tag").agg(F.max(F.struct("count", "gen")).alias("p")).select("tag", "p.count", "p.gen")
    both = points.join(bond_counts(bonds), ["tag", "gen"], "left")
    return both.select("tag", "gen", F.struct(F.coalesce("bonds", F.lit(0)).alias("num"), F.col("count").alias("denom")).alias("rate"))


def explore_ratio(hex_ops: DataFrame) -> DataFrame:
    """(num, denom): the latest counts of exploring operations among those of all operations, each at its own latest generation."""
    last = hex_ops.where("op between 0 and 8").groupBy("op").agg(F.max_by("count", "gen").alias("n"))
    return last.agg(F.coalesce(F.sum(F.when(F.col("op").isin(EXPLORE, NUCLEATE), F.col("n"))), F.lit(0)).alias("num"), F.coalesce(F.sum("n"), F.lit(0)).alias("denom"))


def trend(rows: DataFrame, num: Column, denom: Column, order: str = "gen", per: list[str] | None = None) -> DataFrame:
    """([per,] points, rises, falls, trend) of exact ratios over ``order``.

    falling if over half of the steps (rounded down) fall, else rising if so many rise, else stagnant if there are
    three points and no change, else flat. A denominator of 0 gives a point that differs from none.
    """
    per = per or []
    w = (Window.partitionBy(*per) if per else Window.partitionBy(F.lit(0))).orderBy(order)
    points = rows.select(*per, order, num.cast("decimal(19,0)").alias("n"), denom.cast("decimal(19,0)").alias("d"))
    step = points.withColumn("pn", F.lag("n").over(w)).withColumn("pd", F.lag("d").over(w))
    left, right = F.col("n") * F.col("pd"), F.col("pn") * F.col("d")
    counted = step.groupBy(*per).agg(F.count("*").alias("points"), F.count_if(left > right).alias("rises"), F.count_if(left < right).alias("falls"))
    half = F.floor((F.col("points") - 1) / 2)
    name = (
        F.when(F.col("points") < 2, "flat").when(F.col("falls") > half, "falling").when(F.col("rises") > half, "rising")
        .when((F.col("points") >= 3) & (F.col("falls") == 0) & (F.col("rises") == 0), "stagnant").otherwise("flat")
    )
    return counted.withColumn("trend", name)


def missing_delta(missing: DataFrame) -> DataFrame:
    """(tag, delta): the last count less the one before; 0 for a single point."""
    w = Window.partitionBy("tag").orderBy("gen", "count")
    step = missing.withColumn("delta", F.coalesce(F.col("count") - F.lag("count").over(w), F.lit(0)))
    return step.groupBy("tag").agg(F.max_by("delta", F.struct("gen", "count")).alias("delta"))


def digest(health: DataFrame, fitness: DataFrame, type_sig: DataFrame, bonds: DataFrame, missing: DataFrame, hex_ops: DataFrame, adsr: DataFrame, n: int = 5) -> DataFrame:
    """One row that sums up the last ``n`` generations (at least 2); none if there are fewer than two of health.

    occupancy_trend, fitness_trend, explore, over_extended, collapsed, sustain, early, and ``types``: tag to (bond rate, missing delta).
    """
    n = max(n, 2)
    recent = last_n(health, ["gen"], n)
    occupancy = trend(recent, F.col("occupied"), F.col("total")).select("points", F.col("trend").alias("occupancy_trend"))
    ends = recent.agg(F.min_by(F.struct("occupied", "total"), "gen").alias("first"), F.max_by(F.struct("occupied", "total"), "gen").alias("last"))
    fit = trend(last_n(fitness.where("dim = 0"), ["gen"], n), F.col("num"), F.col("denom")).select(F.col("trend").alias("fitness_trend"))
    explore = explore_ratio(hex_ops).select(F.struct("num", "denom").alias("explore"))
    envelope = latest(adsr).agg(F.max(F.struct("attack", "decay", "sustain", "release")).alias("a"))
    types = bond_rates(type_sig, bonds).join(missing_delta(missing), "tag", "full")
    types = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", F.struct("rate", "delta").alias("d"))))).alias("types"))  # one entry a tag
    row = occupancy.join(ends).join(fit, how="left").join(explore).join(envelope).join(types)  # one row each
    falling = F.col("occupancy_trend") == "falling"
    less_than_half = F.col("last.occupied") * 2 * F.col("first.total") < F.col("first.occupied") * F.col("last.total")
    whole = sum((F.col(f"a.{x}") for x in ("attack", "decay", "sustain", "release")), F.lit(0))
    return row.where("points >= 2").select(
        "occupancy_trend", F.coalesce("fitness_trend", F.lit("flat")).alias("fitness_trend"), "explore",
        (falling & ((F.col("explore.num") * 5 > F.col("explore.denom") * 4) | less_than_half)).alias("over_extended"), (falling & less_than_half).alias("collapsed"),
        F.when(whole > 0, F.col("a.sustain") / whole).alias("sustain"), F.when(whole > 0, (F.col("a.attack") + F.col("a.decay")) / whole).alias("early"), "types",
    )


def rate_windows(tokens: DataFrame, order: str, new_vertex: Column, size: int = 100_000, threshold: tuple[int, int] = (1, 1_000_000)) -> DataFrame:
    """(window, tokens, vertices, converged): tumbling windows of ``size`` tokens, counted by rank in ``order``.

    A window converges if it is at least the third full one and neither its rate nor those of the two before exceed the threshold.
    ``order`` is a whole number that numbers the tokens, with gaps allowed.
    """
    from ..plans.skew import exclusive_sum

    flat = tokens.select(F.col(order).cast("bigint").alias("o"), new_vertex.cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("one"))
    ranked = exclusive_sum(flat, [], ["o"], {"i": "one"})
    windows = ranked.groupBy(F.expr(f"i div {size}").alias("window")).agg(F.count("*").alias("tokens"), F.sum("v").alias("vertices"))
    full = windows.where(F.col("tokens") >= size)
    w = Window.orderBy("window")  # one row for many tokens
    above = (F.col("vertices") * threshold[1] > F.col("tokens") * threshold[0]).cast("int")
    return full.withColumn("converged", (F.row_number().over(w) >= 3) & (F.max(above).over(w.rowsBetween(-2, 0)) == 0))


def bulk_windows(records: DataFrame, order: str, tokens: str, vertices: str, size: int = 100_000) -> DataFrame:
    """(window, tokens, vertices): windows over records of many tokens each; a record that fills the window closes it with all it holds.

    What one window takes decides where the next begins, so the scan is in order: it runs over one narrow row a record (a
    file or batch, not a token), in one task.
    """
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = t = v = 0
        for frame in frames:
            rows = []
            for more_t, more_v in zip(frame["t"], frame["v"], strict=True):
                t, v = t + more_t, v + more_v
                if t >= size:
                    rows.append((n, t, v))
                    n, t, v = n + 1, 0, 0
            yield pd.DataFrame(rows, columns=["window", "tokens", "vertices"])

    flat = records.select(F.col(order).alias("o"), F.col(tokens).cast("bigint").alias("t"), F.col(vertices).cast("bigint").alias("v"))
    return flat.coalesce(1).sortWithinPartitions("o").select("t", "v").mapInPandas(scan, "window bigint, tokens bigint, vertices bigint")


def window_report(windows: DataFrame, threshold: tuple[int, int] = (1, 1_000_000), recent: int = 10) -> DataFrame:
    """One row over full windows (window, tokens, vertices): their number, whether the last three keep to the threshold, and the last ``recent``, the oldest first."""
    last = windows.orderBy(F.desc("window")).limit(max(recent, 3))
    high = F.col("vertices") * threshold[1] > F.col("tokens") * threshold[0]
    rows = F.sort_array(F.collect_list(F.struct("window", "tokens", "vertices", high.alias("high"))))  # at most ten
    one = last.agg(rows.alias("w")).join(windows.agg(F.count("*").alias("window_count")))  # one row each
    tail = lambda n: F.slice("w", F.greatest(F.lit(1), F.size("w") - n + 1), n)
    return one.select("window_count", ((F.col("window_count") >= 3) & ~F.exists(tail(3), lambda x: x["high"])).alias("converged"), F.transform(tail(recent), lambda x: x.dropFields("high")).alias("recent"))
