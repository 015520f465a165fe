import random
import re

import pytest
from pyspark.sql import functions as F

from quillscope.llm import quality as q
from quillscope.llm import repetition as rp

PROSE = [
    "Nobody would have said that the old bridge was far from finished in the early spring. You will find the letter behind the library, where the clock is.",
    "Es gab viele Briefe in der alten Halle, und die Stimme beschreibt sie nicht. Ich glaube, dass das Fenster leider verloren ist.",
    "как далеко до реки\nи где же тот старый дом\nв котором мы жили\nкогда не было ни снега\nни дождя на краю поля",
    "no sabemos por qué la máquina abre el mensaje y la\ncocina no las describe cuando llueve en la sala\ngrande de la casa",
    "- We do not know why the garden is so quiet.\n- There were many letters on the table, and nobody has read them.\n- It is late.",
    "last night, " * 30,
]
NO_PROSE = [
    "\n".join(f"- the {w} x{i}" for i, w in enumerate(["station", "oven", "river", "compass", "kettle", "museum", "tractor", "lantern"])),
    "name                 walk     miss\n" + "\n".join(f"item{i}         0.{i}356   0.{i}955" for i in range(9)),
    "no,item,qty\n" + "\n".join(f"{i},every old note,{i * 37},{i}.46" for i in range(9)),
    '{"ref": "abc", "rows": [' + ", ".join(f'{{"k": {i}, "v": 4.{i}}}' for i in range(9)) + "]}",
    "func f(x int) error {\n    return g(x, 12)\n}\nfor i in range(3):\n    x := y[5] + 7\n" * 3,
    "rrcgrm ckxdeztpz vrg igbj lxbktq rbdqjqsznjm dxppmtzcp qqxsev mwjeiqhjwvc rngzenpt xrvqz twtdr jh gcdjbxt",
    "Verse · Valley · Thread · Note · Author · Ledger · Harbor · Channel · Comma · Critic · Reader · Violin · Kettle",
    " ".join(f"https://notes.example/page{i}" for i in range(9)),
    "%#@$ =$$[%[{ $ |{{=]$~& <  < * &/^]_\\  $ $@>~] >_/>%/+ ^+ } * {%  {+-%_#\\ =#/> % \\{<|{ ^&---_<[@ @~_{",
    "\n".join(f"2025-03-{10 + i}T16:25:57Z INFO svc[87{i}4]: rc=19{i} t=2.82{i} id=b42373c{i}" for i in range(5)),
    "A sentence that is one.\n" + "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 20,
]


def test_prose_or_not(spark):
    texts = PROSE + NO_PROSE
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", q.is_no_prose(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [False] * len(PROSE) + [True] * len(NO_PROSE)


def test_statistics_and_reasons(spark):
    df = spark.createDataFrame([("Two words.\n* Three more words…",), ("",), (None,), ("....",)], "t string").withColumn("n_words", F.lit("clash"))
    a, empty, null, dots = q.judge(df, {"t": F.col("t")}, F.col("t")).collect()
    assert (a["n_words"], a["n_chars"], a["end_line_share"], a["bullet_line_share"], a["ellipsis_line_share"]) == (5, 30, 1.0, 0.5, 0.5)
    assert a["mean_word_length"] == pytest.approx(22 / 5) and a["symbol_share"] == pytest.approx(3 / 30)
    assert null["reasons"] == ["null"] and null["n_words"] is None and empty["n_words"] == 0 and "few words" in empty["reasons"] and "few common words" in dots["reasons"] and "no prose" not in dots["reasons"]
    assert q.judge(df.limit(0), {"t": F.col("t")}, F.col("t")).count() == 0


def covered(text):
    w = re.findall(r"[^\W_]+", text.lower())
    seen, hit = set(), set()
    for i in range(len(w) - 4):
        run = tuple(w[i : i + 5])
        if run in seen:
            hit |= set(range(i, i + 5))
        seen.add(run)
    return len(hit), len(w)


def test_covered_words_against_brute_force(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices("abc", k=rnd.randint(0, 120))) for _ in range(60)] + ["one two three four five", "x " * 50, "", "A b, c. D\ne! a B c d e f", "w " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rp.statistics(F.col("t")).alias("s"))
    for r in df.collect():
        n, total = covered(texts[r["i"]])
        assert r["s"]["n_words"] == total and r["s"]["run_word_share"] == pytest.approx(n / max(total, 1))


def test_shares_and_reasons(spark):
    text = "Same line here.\nSame LINE here!\nanother one\n\nSame line here."
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").withColumn("line_share", F.lit(1))
    a, empty, null = rp.measure(df, {"t": F.col("t")}, F.col("t")).collect()
    assert a["line_share"] == pytest.approx(28 / 53) and a["top_word_share"] == pytest.approx(3 / 11) and "repeated lines" in a["reasons"]
    assert "repeated runs of words" not in empty["reasons"] and empty["run_word_share"] == 0 and null["reasons"] == ["null"]


def test_a_third_of_thirty(spark):
    base = [f"w{i}" for i in range(25)]
    cases = {" ".join(base + base[:10]): False, " ".join(base[:20] + base[:10]): True, " ".join(base[:18] + base[:10]): False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: rp.REPEATED_RUNS in r["reasons"] for r in rp.measure(df, {"t": F.col("t")}, F.col("t")).collect()}
    assert got == cases


def test_each_rule_has_a_source_and_statistics_are_evaluated_once(spark):
    assert all(r.source for r in [*q.RULES, *q.LINE_RULES, *rp.RULES])
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = spark.createDataFrame([("x",)], "t string")
    for module, reason, judge in ((q, q.NO_PROSE, q.judge), (rp, rp.REPEATED_RUNS, rp.measure)):
        plan = judge(df, {"t": F.col("t")}, F.col("t")).where(F.array_contains("reasons", reason)).select("t")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("few common words") == 1
    plan = df.where(~q.is_no_prose(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("prose_share, CASE") == 1 and "few common words" not in plan
