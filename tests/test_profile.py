import pytest
from pyspark.sql import functions as F

from quillscope.functions.arrays import longs
from quillscope.operators import detect as det
from quillscope.operators import profile as prof

WORDS = {"w1": "a", "w2": "abc", "w3": "abcde", "w4": "abcdefgh", "punct": "!", "space": " "}


def text(*tags):
    """A text whose tokens have these tags (words need something between them)."""
    return "".join(WORDS[t] for t in tags)


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def spatial(levels):
    return {r["depth"]: r["spatial"] for r in levels.collect()}


def test_each_depth_has_half_of_the_next(spark):
    docs = corpus(spark, [text(*["w2", "punct"] * 37), text(*["w2", "space"] * 41), "", None, text(*["w3", "punct"] * 50)])
    got = spatial(prof.train(docs, "doc_id", "text", threshold=None))
    n = sum(got[7])
    assert n == 256 and [sum(got[d]) for d in range(8)] == [n >> (7 - d) for d in range(8)]
    assert got[7][1] == 78 and got[7][2] == 50


def test_places_run_through_all_documents(spark):
    texts = [text(*["w2", "punct"] * k) for k in (3, 50, 1, 64, 10)]
    stream = [c for t in texts for c in [1, 5] * (len(t) // 4)]
    got = spatial(prof.train(corpus(spark, texts), "doc_id", "text", threshold=None))
    for d in range(8):
        picked = stream[(1 << (7 - d)) - 1 :: 1 << (7 - d)]
        assert got[d] == [picked.count(c) for c in range(8)]


def test_convergence_needs_eight_like_documents(spark):
    like = [text(*["w2", "punct", "w3", "punct"] * 1000)] * 12
    placed = prof.with_offsets(prof.document_counts(corpus(spark, like), "doc_id", "text", chunk_bytes=None))
    counted = prof.with_levels(placed)
    flags = [r["converged"] for r in prof.convergence(counted).orderBy("file").collect()]
    assert not any(flags[:7]) and all(flags[7:])


def test_fingerprint_has_origin_tokens(spark):
    docs = spark.createDataFrame([(0, "x", text(*["w2", "punct"] * 100)), (1, "x", "a"), (2, None, "abc"), (3, "y", "")], "doc_id bigint, who string, text string")
    leaf = {r["who"]: (r["spatial"], r["origin_tokens"]) for r in prof.fingerprint(docs, "who", "doc_id", "text").where("depth = 7").collect()}
    assert leaf["x"] == ([1, 100, 0, 0, 0, 100, 0, 7], 7) and leaf["y"] == ([0, 0, 0, 0, 0, 0, 0, 1], 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_compare_bounds(spark):
    trained = (100, 100, 100, 100, 100, 100, 100, 0)
    s = one(spark, det.compare_level(longs([50, 200, 201, 49, 100, 100, 100, 0]), trained))
    assert s["bonded"] + s["missed"] == 8
    same = one(spark, det.compare_level(longs(list(trained)), trained))
    assert (same["bonded"], same["long_misses"], same["walk"]) == (7, 0, 0.0)
    for nothing in (det.compare_level(longs([0] * 8), trained), det.compare_level(longs([1] * 8), (0,) * 8)):
        s = one(spark, nothing)
        assert (s["bonded"], s["missed"], s["long_misses"], s["walk"]) == (0, 8, 0, 8.0)


def test_exact_ratios_bond(spark):
    # Shares of one half and of twice the trained share are still bonds.
    trained = (2, 2, 0, 0, 0, 0, 0, 0)
    assert one(spark, det.compare_level(longs([1, 3, 0, 0, 0, 0, 0, 0]), trained))["bonded"] == 2
    assert one(spark, det.compare_level(longs([2, 7, 0, 0, 0, 0, 0, 0]), trained))["bonded"] == 1


def test_empty_text_is_machine(spark):
    model = det.Model(tuple(tuple([10] * 8) for _ in range(8)))
    df = spark.createDataFrame([("",), (None,)], "t string")
    for r in det.detect(df, "t", model, troll=model).select("verdict.*").collect():
        assert (r["human"], r["confidence"], r["label"], r["troll_score"], r["pass_hits"]) == (False, 1.0, "AI (100%)", 0.0, [0.0] * 8)


def test_level_floor(spark):
    model = det.Model(tuple(tuple([10] * 8) for _ in range(8)))
    sizes = [31, 32, 63, 64, 500]
    df = spark.createDataFrame([(n, "!" * n) for n in sizes], "n int, t string")
    used = df.select("n", F.size(det.passes(det.probe_levels(F.col("t")), model)).alias("k")).collect()
    assert [r["k"] for r in used] == [0, 1, 1, 2, 4]


def test_manipulation_needs_six_channels_at_the_root(spark):
    model = det.Model(tuple(tuple([10] * 8) for _ in range(8)))
    cases = {5: 0.0, 6: (0.75 - 0.67) / 0.13, 7: 1.0, 8: 1.0}
    for n, want in cases.items():
        assert one(spark, det.manipulation_score(longs([1] * n + [0] * (8 - n)), model)) == pytest.approx(want)


def test_snapshot_round_trip(spark, tmp_path):
    model = det.Model(tuple(tuple(range(d, d + 8)) for d in range(8)))
    model.save(spark, str(tmp_path / "m"))
    assert det.Model.load(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError):
        det.Model.from_json('{"version": 1}')


def test_probe(spark):
    counts = longs([0, 200, 160, 0, 0, 0, 100, 0])
    assert one(spark, det.probe_channel(counts, F.lit(1)))["bonded"] and not one(spark, det.probe_channel(counts, F.lit(0)))["bonded"]
    assert tuple(one(spark, det.probe_channel(counts, F.lit(9)))) == (False, 8)


def test_convergence_is_the_same_in_small_blocks(spark):
    texts = [text(*["w2", "punct", "w3", "punct"] * (300 + 7 * (i % 5))) for i in range(60)] + [text(*["w4", "space"] * 4000)] + [text(*["w2", "punct", "w3", "punct"] * 500)] * 40
    docs = spark.createDataFrame([(i * 1_000_003_000_000, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    placed = prof.with_offsets(prof.document_counts(docs, "doc_id", "text", chunk_bytes=None))
    counted = prof.with_levels(placed)
    whole, cut = ([tuple(r) for r in prof.convergence(counted, block=n).select("file", "converged").orderBy("file").collect()] for n in (100_000, 20))
    assert whole == cut and len(cut) == 101 and len({c for _, c in cut}) == 2


def test_text_is_tokenised_once_in_each_plan(spark):
    from quillscope import text_queries as tq

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    for name in ("channel_counts", "token_window_features", "walsh_levels", "multiscale_counts"):
        plan = getattr(tq, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("coalesce(text") == 1, name


def test_residues_give_the_counts_of_any_offset(spark):
    streams = [[], [3], [c % 8 for c in range(1000)], [(c * c) % 7 for c in range(300)]]
    df = spark.createDataFrame([(s, o) for s in streams for o in (0, 1, 63, 64, 127, 128, 12_345)], "s array<int>, o bigint")
    both = df.select(prof.level_counts(F.col("s"), F.col("o")).alias("a"), prof.counts_at(prof.residue_counts(F.col("s")), F.col("o")).alias("b"))
    assert both.where("a <> b").count() == 0 and both.count() == 28


def test_no_stream_is_shuffled_in_training(spark, monkeypatch):
    from quillscope.plans import skew

    docs = corpus(spark, [text(*["w2", "punct"] * k) for k in (3, 50, 1, 64, 10)])
    want = spatial(prof.train(docs, "doc_id", "text", threshold=None))
    monkeypatch.setattr(skew.lookup, "__defaults__", ("left", 2))  # as for a corpus beyond a broadcast
    levels = prof.train(docs, "doc_id", "text", threshold=None)
    assert spatial(levels) == want and "stream" not in levels._jdf.queryExecution().toString()
