import random

import pytest
from pyspark.sql import functions as F

from quillscope.llm import sampling as sa


def brute(target, floor, there, size):
    rows = sorted(
        ((0, r, 0.0, c) if r <= floor[c] else (1, 0, (r - 0.5) / target[c], c)) for c in range(len(target)) for r in range(1, there[c] + 1) if target[c] > 0 or r <= floor[c]
    )
    got = [0] * len(target)
    for row in rows[:size]:
        got[row[3]] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_seats_are_the_smallest_priorities(spark, seed):
    rnd = random.Random(seed)
    cells = [(rnd.randrange(10), rnd.randrange(5), rnd.randrange(31)) for _ in range(9)]
    size = rnd.choice([3, 20, 60, 300])
    rows = [(100 * c + i, f"m{c}", "d", "", "") for c, (_, _, n) in enumerate(cells) for i in range(n)]
    _, report = run(spark, rows, [(f"m{c}", "d", t, f) for c, (t, f, _) in enumerate(cells)], size=size)
    assert [report[f"m{c}", "d"]["taken"] for c in range(9)] == brute(*zip(*cells), size)


def run(spark, rows, targets, **options):
    df = spark.createDataFrame(rows, "k bigint, m string, d string, wanted string, rank string")
    t = spark.createDataFrame(targets, "m string, d string, pm int, least int")
    sample, report = sa.sample_by_targets(df, F.col("k"), {"m": F.lower("m"), "d": F.col("d")}, t, "pm", "least", **options)
    return sample.collect(), {(r["m"], r["d"]): r for r in report.collect()}


def test_sample_and_report(spark):
    rows = [(i, "A", "x", "", "") for i in range(600)] + [(1000 + i, "b", "x", "", "") for i in range(300)] + [(2000 + i, "b", "y", "", "") for i in range(3)]
    rows += [(3000 + i, "c", None, "", "") for i in range(97)] + [(0, "A", "x", "", ""), (None, "A", "x", "", "")]
    sample, report = run(spark, rows, [("a", "x", 500, 2), ("b", "x", 300, 2), ("b", "y", 195, 5), ("z", "z", 5, 1), (None, "x", 0, 0)])
    assert len(sample) == 100 and len({r["key"] for r in sample}) == 100
    assert report["b", "y"]["wanted"] == 19 and not report["b", "y"]["met"] and report["b", "y"]["taken"] == 3 and not report["z", "z"]["met"] and report["a", "x"]["met"]
    taken = {k: report[k]["taken"] for k in [("a", "x"), ("b", "x")]}
    assert sum(taken.values()) == 97 and abs(taken["a", "x"] - 97 * 5 / 8) <= 1
    for cell, n in taken.items():
        assert sorted(r["rank"] for r in sample if (r["m"], r["d"]) == cell) == list(range(1, n + 1))
    again, _ = run(spark, list(reversed(rows)), [("a", "x", 500, 2), ("b", "x", 300, 2), ("b", "y", 195, 5)])
    assert {r["key"] for r in again} == {r["key"] for r in sample}


@pytest.mark.parametrize("rows, targets", [([], [("a", "x", 1000, 3)]), ([(1, "a", "x", "", "")], []), ([(1, None, None, "", "")], [(None, None, None, None)])])
def test_nothing(spark, rows, targets):
    sample, report = run(spark, rows, targets, size=5)
    assert sample == [] and all(r["taken"] == 0 for r in report.values())


def test_ranks_of_a_large_group(spark):
    from quillscope.plans.skew import random_rank

    df = spark.range(20_000).select("id", F.lit("g").alias("g"), F.xxhash64("id").alias("u"))
    got = random_rank(df, ["g"], "u", ["id"], 20_000, "rank", per_task=700).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 20_001)) and [r["u"] for r in got] == sorted(r["u"] for r in got)
