import random

from pyspark.sql import functions as F

from quillscope.plans.skew import bitmap, exclusive_sum, hot_keys, lookup, salted_join, with_maybe


def test_hot_keys_by_rows_a_task(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    hot = hot_keys(df, "k", 150)
    assert hot.count() == 26 and hot.agg(F.max("__salts")).first()[0] == 34
    index = spark.range(-1, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = df.join(index, "k", how), salted_join(df, index, "k", how, hot, F.col("v"))
        assert sorted(plain.collect()) == sorted(salted.select(*plain.columns).collect())
    assert hot_keys(df, "k", 100_000) is None


def test_lookup_beyond_the_bound_gives_the_same(spark):
    df = spark.range(1_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), "id", F.create_map(F.lit("x"), F.col("id")).alias("m"))
    table = spark.range(5).select(F.col("id").alias("a"), F.lit(1).cast("bigint").alias("b"), F.lit("t").alias("t"))
    small, large = (lookup(df, table, ["a", "b"], "left", most).drop("m") for most in (100, 2))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_bitmap_forgets_nothing(spark):
    keys = spark.range(0, 3_000, 3).withColumnRenamed("id", "k")
    flagged = with_maybe(spark.range(3_000).withColumnRenamed("id", "k"), bitmap(keys, "k"), ["k"])
    yes = {r["k"] for r in flagged.where("__maybe").collect()}
    assert yes >= set(range(0, 3_000, 3)) and len(yes) < 1_250  # a sixteenth of the others by chance


def test_running_sums_over_many_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(1 << 62), rng.randrange(9)) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    for group, per_task in (([], 300), (["g"], 300), (["g"], 10_000)):
        got = {(r["g"], r["o"]): r["s"] for r in exclusive_sum(df, group, ["o"], {"s": "v"}, per_task).collect()}
        sums: dict = {}
        for g, o, v in sorted(rows, key=lambda r: (r[0] if group else "", r[1])):
            k = g if group else ""
            assert got[g, o] == sums.get(k, 0)
            sums[k] = sums.get(k, 0) + v
