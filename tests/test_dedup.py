from pyspark.sql import functions as F

from quillscope.operators.dedup import exactly_once

SCHEMA = "n bigint, id string, at int, __key string, __rank int"


def run(spark, rows, stored=None):
    df = spark.createDataFrame(rows, SCHEMA)
    old = None if stored is None else spark.createDataFrame(stored, SCHEMA)
    kept, dropped = exactly_once(df, F.lower(F.trim("id")), [F.col("at"), F.col("n")], old)
    assert kept.columns == df.columns
    return sorted(r["n"] for r in kept.collect()), sorted(r["n"] for r in dropped.collect())


def test_first_of_each_is_kept(spark):
    rows = [(1, "a", 5, "x", 1), (2, " A", 3, None, 2), (3, "b", 1, "y", 3), (4, "a", 3, "z", 4), (5, None, 1, "q", 5), (6, None, 1, "q", 5), (7, "c", None, "r", 6), (8, "c", 9, "r", 6)]
    assert run(spark, rows) == ([2, 3, 5, 6, 8], [1, 4, 7])


def test_stored_and_new(spark):
    assert run(spark, [(1, "a", 5, "", 0), (2, "b", 5, "", 0)], [(3, "a", 1, "", 0), (4, "a", 2, "", 0)]) == ([2, 3], [1, 4])


def test_full_ties_keep_one(spark):
    kept, dropped = run(spark, [(1, "a", 1, "", 0)] * 3)
    assert kept == [1] and dropped == [1, 1]


def test_empty(spark):
    assert run(spark, []) == ([], [])


def test_hot_identifier(spark):
    df = spark.range(30_000).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), (30_000 - F.col("id")).cast("int").alias("at"))
    kept, dropped = exactly_once(df, F.col("id"), [F.col("at")])
    assert kept.count() == 15_001 and dropped.count() == 14_999 and kept.where("id = 'hot'").first()["n"] == 29_998


def test_many_middling_hot_identifiers(spark):
    df = spark.range(40_000).select(F.col("id").alias("n"), (F.col("id") % 100).cast("string").alias("id"), F.lit(1).alias("at"))
    kept, dropped = exactly_once(df, F.col("id"), [F.col("at"), F.col("n")], task_rows=150)
    assert sorted(r["n"] for r in kept.collect()) == list(range(100)) and dropped.count() == 39_900


def test_singletons_pass_without_a_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("n"), F.col("id").cast("string").alias("id"), F.lit("long text").alias("body"))
    plan = exactly_once(df, F.col("id"), [F.col("n")])[0]._jdf.queryExecution().toString()
    singles = plan[plan.index("== Physical Plan") :].split("Union")[1]
    assert kept_rows(df) == 100 and "hashpartitioning(__key" in singles


def kept_rows(df):
    return exactly_once(df, F.col("id"), [F.col("n")])[0].count()
