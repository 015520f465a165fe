from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillscope.operators import graph as gr
from quillscope.operators import metrics as mt
from quillscope.operators import report as rep
from quillscope.operators import sampling as sm

EVENT = "id string, pubkey string, kind int, tags array<array<string>>, received_at timestamp"
T = datetime(2025, 1, 1)


def graph(spark, *rows):
    return gr.nodes(spark.createDataFrame([(i, p, k, t, T) for i, p, k, t in rows], EVENT))


def test_graph(spark):
    g = graph(spark, ("a", "x", 1, []), ("b", "y", 1, [["e", "A"], ["e", "a"], ["p", "x"]]), ("c", "x", 7, [["e", "b"], ["e", "gone"], ["p", "none"], ["e"]]), ("a", "x", 1, []))
    assert g.count() == 3
    assert tuple(gr.stats(g).select("events", "authors", "kinds", "bonds", "orphans", "largest_author", "largest_kind").first()) == (3, 2, 2, 3, 2, 2, 2)
    assert {r["id"]: r["n_in_refs"] for r in gr.in_refs(g).collect()} == {"a": 2, "b": 1, "c": 0}
    assert sorted((r["type"], r["key"]) for r in gr.orphans(g).collect()) == [("event", "gone"), ("pubkey", "none")]
    assert gr.stats(g.limit(0)).first()["events"] == 0


def test_store_keeps_the_last_row_of_each_key(spark, tmp_path):
    store = mt.MetricStore(spark, str(tmp_path))
    store.record("health", spark.createDataFrame([(0, 10, 20), (1, 11, 20)], "gen bigint, occupied bigint, total bigint"))
    store.record("health", spark.createDataFrame([(1, 12, 20)], "gen bigint, occupied bigint, total bigint"))
    assert sorted(tuple(r) for r in store.read("health").collect()) == [(0, 10, 20), (1, 12, 20)]
    store.record("type_sig", spark.createDataFrame([("f", 5, 0), ("f", 6, 0)], "tag string, count bigint, gen bigint"))
    assert store.read("type_sig").count() == 2
    for k in (1, 2):
        store.add_scores(spark.createDataFrame([("p", 2 * k, 10)], "path string, accreted bigint, raw bigint"))
    assert tuple(store.scores().first()) == ("p", 6, 20)
    with pytest.raises(ValueError):
        store.record("bonds", spark.createDataFrame([("f",)], "tag string"))


def test_trends(spark):
    sig = spark.createDataFrame([("f", 30, 0), ("f", 20, 1), ("f", 10, 2)], "tag string, count bigint, gen bigint")
    assert sorted(r["gen"] for r in mt.type_trend(sig, 2).collect()) == [0, 1]
    assert sorted(r["gen"] for r in mt.type_trend(sig, 2, "gen").collect()) == [1, 2] and mt.type_trend(sig, 0).count() == 3
    hist = spark.createDataFrame([(s, g) for s in range(3) for g in range(2)], "seq bigint, gen bigint")
    assert mt.oracle_history(hist, 0).count() == 0 and mt.oracle_history(hist, 2).count() == 2

    def name(*points):
        rows = spark.createDataFrame(list(enumerate(points)), "gen bigint, p struct<n: bigint, d: bigint>")
        return mt.trend(rows, F.col("p.n"), F.col("p.d")).first()["trend"]

    assert name((100, 200), (70, 200), (40, 200)) == "falling" and name((1, 2), (2, 3), (3, 4)) == "rising"
    assert name((1, 2), (2, 4), (3, 6)) == "stagnant" and name((1, 2)) == "flat" and name((1, 2), (1, 3), (1, 2)) == "flat" and name((1, 2), (1, 2)) == "flat"


def digest_of(spark, occupied, gens=3):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return mt.digest(
        table([(g, o, 200) for g, o in enumerate(occupied)], "gen bigint, occupied bigint, total bigint"),
        table([(0, g, g + 1, 10) for g in range(gens)], "dim int, gen bigint, num bigint, denom bigint"),
        table([("f", 50, 2), ("g", 10, 2)], "tag string, count bigint, gen bigint"),
        table([("f", 2, s) for s in range(30)], "tag string, gen bigint, site bigint"),
        table([("f", 1, 100), ("f", 2, 150), ("h", 1, 7)], "tag string, gen bigint, count bigint"),
        table([(6, 0, 90), (6, 1, 9), (3, 1, 1), (0, 1, 2)], "op int, gen bigint, count bigint"),
        table([(2, 1, 2, 3, 4)], "gen bigint, attack bigint, decay bigint, sustain bigint, release bigint"),
    ).collect()


def test_digest(spark):
    d = digest_of(spark, [100, 70, 40])[0]
    assert (d["occupancy_trend"], d["fitness_trend"], tuple(d["explore"]), d["over_extended"], d["collapsed"]) == ("falling", "rising", (10, 12), True, True)
    assert (d["sustain"], d["early"]) == (0.3, 0.3)
    assert tuple(d["types"]["f"]["rate"]) == (30, 50) and d["types"]["f"]["delta"] == 50 and d["types"]["h"]["delta"] == 0 and tuple(d["types"]["g"]["rate"]) == (0, 10)
    assert digest_of(spark, [100]) == [] and digest_of(spark, [1, 2])[0]["occupancy_trend"] == "rising"


def test_rate_windows(spark):
    rows = spark.range(350).select("id", (F.col("id") < 50).alias("v"))
    got = mt.rate_windows(rows, "id", F.col("v"), 100, (1, 100)).orderBy("window").collect()
    assert [(r["tokens"], r["vertices"], r["converged"]) for r in got] == [(100, 50, False), (100, 0, False), (100, 0, False)]
    more = mt.rate_windows(spark.range(400).select("id", (F.col("id") < 50).alias("v")), "id", F.col("v"), 100, (1, 100))
    assert more.where("window = 3").first()["converged"]


def test_reports(spark):
    v = spark.createDataFrame([(True, True, 0.5), (True, False, 0.1), (False, False, 1.0), (False, False, 0.2)], "is_human boolean, human boolean, confidence double")
    assert tuple(rep.balanced(v).first()) == (50.0, 100.0, 75.0, 0.45)
    assert rep.balanced(v.where("is_human")).first()["balanced"] is None
    board = rep.leaderboard(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "m string, s double"), "m", "s").orderBy("place").collect()
    assert [r["m"] for r in board] == ["c", "a", "b"]


def test_samplers(spark):
    assert sorted(r[0] for r in sm.every_kth(spark.range(10), "id", 3).collect()) == [0, 3, 6]
    assert sm.every_kth(spark.range(2), "id", 5).count() == 2
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    once, again = sm.per_group(rows, "g", F.col("id"), 7), sm.per_group(rows.repartition(5), "g", F.col("id"), 7)
    assert once.count() == 21 and sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
