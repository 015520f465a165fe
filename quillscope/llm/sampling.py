"""A sample whose categories follow target proportions, by the priorities of a divisor method.

Records of a category are put in random order; the record of rank r of a category with target t has the priority (r - 0.5) / t.
The sample is the records of the smallest priorities, after the first ``min_rows`` of each category. A category
that runs out leaves its seats to the next priorities of the others.

The order comes from a hash, and ranks from counts by ranges of the hash, so a category may hold any share of the rows.
The smallest priorities of all are found by one more ranking, in ranges of the priorities, so neither the
categories nor the sample meet in one place, and any number of targets will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import exclusive_sum, lookup, random_rank
from ..session import Scratch


def sample_by_targets(
    records: DataFrame, key: Column, category: dict[str, Column], targets: DataFrame, target: str, floor: str,
    share: float | None = 0.1, size: int | None = None, scale: int = 1000, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of distinct ``key`` of ``records``.

    ``targets`` holds, under the names of ``category``, one row a category with its wanted share (in ``1/scale``) and least number.
    The sample has ``size`` rows, or else the ``share`` of all distinct keys, rounded down.
    sample: key, the category's columns, rank, priority (null for the first ``floor`` records). report: the category's columns, wanted (the
    larger of floor and size x share, rounded down), available, taken, met.

    Defined results: rows with a null key are ignored; of rows with the same key the least category holds; a
    category with a null part is a category of no target: it counts for the size and is not drawn from;
    targets with null names match nothing and are reported; null shares and floors count as 0; of several target rows for a
    category the sums hold; equal priorities go by the category's names; if the floors alone exceed the size they are filled by
    rank, every category's first record, then the second ones; empty tables give an empty sample. Other columns are ignored.
    """
    spark = records.sparkSession
    names = list(category)
    scratch = Scratch(spark, "sample")
    flat = records.select(key.alias("__key"), F.struct(*[c.alias(n) for n, c in category.items()]).alias("__cell")).where("__key is not null")
    rows = flat.groupBy("__key").agg(F.min("__cell").alias("__cell")).select("__key", "__cell.*")
    rows = scratch.write(rows.withColumn("__u", F.xxhash64("__key", F.lit(seed))), "records")
    n = rows.count()
    size = int(n * share + 1e-9) if size is None else size
    want = targets.groupBy(*names).agg(F.coalesce(F.sum(target), F.lit(0)).cast("double").alias("__target"), F.coalesce(F.sum(floor), F.lit(0)).cast("bigint").alias("__floor"))
    drawn = lookup(rows, want, names, "inner")
    ranked = random_rank(drawn, names, "__u", ["__key"], n, "rank")
    in_floor, in_share = F.col("rank") <= F.col("__floor"), F.col("__target") > 0
    priority = F.when(~in_floor & in_share, (F.col("rank") - 0.5) / F.col("__target"))
    # Floors first, by rank; then the priorities; records of categories without a target last, and never taken.
    ranked = ranked.select("__key", *names, "rank", priority.alias("priority"), F.when(in_floor, 0).when(in_share, 1).otherwise(2).alias("__class"))
    ranked = ranked.withColumn("__order", F.when(F.col("__class") == 0, F.col("rank")).otherwise(F.coalesce("priority", F.lit(0.0)))).withColumn("__one", F.lit(1).cast("bigint"))
    placed = exclusive_sum(ranked, [], ["__class", "__order", *names, "rank"], {"__before": "__one"})
    placed = scratch.write(placed.withColumn("taken", (F.col("__class") < 2) & (F.col("__before") < size)), "placed")
    # A category's records are as many as its last rank.
    cells = placed.groupBy(*names).agg(F.max("rank").alias("available"), F.count_if("taken").alias("taken"))
    report = want.join(cells, names, "left").fillna(0, ["available", "taken"])
    wanted = F.greatest(F.col("__floor"), F.floor(F.col("__target") * size / scale + 1e-9).cast("bigint"))
    report = report.select(*names, wanted.alias("wanted"), "available", "taken", (F.col("available") >= wanted).alias("met"))
    return placed.where("taken").select(F.col("__key").alias("key"), *names, "rank", "priority"), report
