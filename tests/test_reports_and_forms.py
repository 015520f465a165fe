import random

import pytest
from pyspark.sql import functions as F

from quillscope.functions import codec, constraints, grammar
from quillscope.functions import tokens as tok
from quillscope.functions.text import fixed, left, right
from quillscope.operators import detect as det
from quillscope.operators import metrics as mt
from quillscope.operators import report as rep
from quillscope.sources import source_code

VERDICTS = "model string, is_human boolean, human boolean, deep_walk double, long_miss_rate double, troll_score double, ms double, confidence double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_numbers_round_as_in_c(spark):
    rnd = random.Random(4)
    values = [0.125, 0.375, 6.25, 12.5, 0.5, 1.5, 2.5, 1e9 + 0.5, -0.25, 0.0, *[rnd.random() * 10 ** rnd.randint(-3, 6) for _ in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 3):
        got = [r[0] for r in df.select(fixed(F.col("v"), places)).collect()]
        assert [float(g) for g in got] == [float(f"%.{places}f" % v) for v in values]
    r = one(spark, left(F.lit(7), 4), right(F.lit("ab"), 3), left(F.lit("toolong"), 3))
    assert list(r) == ["7   ", " ab", "toolong"]


def verdicts(spark, *rows):
    return spark.createDataFrame(list(rows), VERDICTS)


ROWS = [("human", True, True, 0.1, 0.2, 0.0, 3.0, 0.5), ("human", True, False, 0.3, 0.4, 0.5, 5.0, 0.5), ("human", True, None, None, None, None, None, None), ("m1", False, False, 0.2, 0.1, 1.0, 1.0, 1.0), ("m1", False, True, 0.4, 0.3, 0.0, 1.0, 1.0), ("m2", False, False, 0.25, 0.5, 0.75, 1.0, 1.0)]


def lines(page):
    return [r["line"] for r in page.orderBy("line_no").collect()]


def test_reports(spark):
    text = lines(rep.markdown_report(verdicts(spark, *ROWS), "T"))
    assert text[0] == "# T" and "| Human correct (true negative) | 50.0% |" in text and "| **Balanced accuracy** | **58.3%** |" in text
    assert "| m1 | 1/2 | 50% | 0.300 | 0.200 | 50.0% |" in text and "| **Total** | **2/3** | **66.7%** | | | |" in text
    assert text.index("| 1 | m2 | 75.0% |") < text.index("| 2 | m1 | 50.0% |") < text.index("| -- | *human baseline* | *25.0%* |")
    box = lines(rep.box_report(verdicts(spark, *ROWS)))
    assert "║  m1                    1/2   detected  (walk=0.300 miss=0.200 troll=50.0%)  ║" in box and box[-1].startswith("╚") and any("█" * 15 in x and "█" * 16 not in x for x in box)
    plain = lines(rep.markdown_report(verdicts(spark, *ROWS), with_troll=False))
    assert not any("Manipulation" in x or "troll" in x for x in plain)
    people = lines(rep.box_report(verdicts(spark, *ROWS[:3])))
    assert any("HUMAN TEXT" in x for x in people) and not any("MACHINE" in x or "COMBINED" in x for x in people)
    assert lines(rep.markdown_report(verdicts(spark))) == ["# Detection Benchmark", "", "Deterministic detection of machine text.", "", "---"]


def test_group_stats_and_outcomes(spark):
    r = rep.group_stats(verdicts(spark, *ROWS), "is_human").where("is_human").first()
    assert (r["n"], r["errors"], r["avg_troll"], r["avg_ms"]) == (2, 1, 0.25, 4.0)
    df = spark.createDataFrame([(1, True), (1, False), (1, None), (2, None)], "e int, accepted boolean")
    assert sorted(map(tuple, rep.outcome_counts(df, "e").collect())) == [(1, 1, 1, 1, 3), (2, 0, 0, 1, 1)]


def test_replies(spark):
    model = det.Model(tuple(tuple([10] * 8) for _ in range(8)))
    df = spark.createDataFrame([("e1", "p1", "")], "id string, pubkey string, content string")
    r = det.replies(det.detect(df, "content", model, troll=model), "wss://r", ["a"], "b", F.lit("more")).first()
    assert r["kind"] == 1 and r["tags"] == [["e", "e1", "wss://r", "reply"], ["p", "p1"], ["t", "a"]] and r["content"].startswith("verdict: AI (100%)") and r["content"].endswith("more")


def test_code_allocation(spark):
    def brute(target, num, denom):
        text = max(2, target * 15 // 100)
        words = num * text // denom
        if text - words < 1:
            words = text - 1
        counts = {k: max(1, max(1, target - text) * w // 60) for k, w in grammar.GO_WEIGHTS.items()}
        counts["ident:var-name"] += max(0, target - text - sum(counts.values()))
        return {**counts, "word": words, "punct": text - words}

    assert sum(grammar.GO_WEIGHTS.values()) == 60
    for case in ((0, 1, 2), (40, 1, 1), (1000, 7, 10), (12345, 0, 3)):
        assert one(spark, grammar.go_counts(*map(F.lit, case)))[0] == brute(*case)


def test_grammars(spark):
    ast, emit = (grammar.edges(spark, g) for g in (grammar.GO_AST, grammar.GO_EMIT))
    asked = spark.createDataFrame([("func", "assign"), ("func", "func"), ("unknown", "x")], grammar.NEIGHBOUR_SCHEMA)
    assert [tuple(r) for r in grammar.can_neighbor(asked, ast).collect()] == [("func", "assign")]
    assert emit.join(grammar.edges(spark, {t: grammar.STATEMENTS for t in grammar.STATEMENTS}), ["tag", "neighbor"]).count() == 14 * 14


def test_values(spark):
    df = spark.createDataFrame([(-5, 0, 1 << 31, 7), (1 << 62, -3, 0, 1)], "a bigint, b bigint, c bigint, d bigint")
    pair, health = codec.pair_value(F.col("a"), F.col("b")), codec.health_value(F.col("c"), F.col("d"), F.col("a"), F.col("b"))
    got = df.select(codec.read_pair(pair).alias("p"), codec.read_health(health).alias("h"), codec.read_counts(codec.counts_value(F.col("c"), F.col("d")), 2).alias("n"), F.length(pair).alias("l")).collect()
    assert [(tuple(r["p"]), tuple(r["h"]), r["n"], r["l"]) for r in got] == [((-5, 1), (1 << 31, 7, -5, 1), [1 << 31, 7], 32), ((1 << 62, -3), (0, 1, 1 << 62, -3), [0, 1], 32)]
    r = one(spark, codec.read_pair(F.lit("00")), codec.read_health(F.lit("")), codec.read_counts(F.lit("0011"), 4))
    assert (tuple(r[0]), tuple(r[1]), r[2]) == ((0, 1), (0, 0, 0, 1), [0, 0, 0, 0])


def test_elements_and_constraints(spark):
    e = one(spark, tok.element(F.lit("word"), F.lit("Ab"), True), tok.origin(F.lit("me")))
    assert (e[0]["groups"], e[0]["n_bytes"], e[0]["is_ref"], e[1]["tag"], e[1]["is_ref"]) == ([16, 22, 8, 0], 2, True, "origin", False)
    x = F.struct(F.lit("a").alias("tag"), F.lit(3).alias("value"), F.lit("fine").alias("layer"), F.lit(None).cast("boolean").alias("sticky"))
    none, near = F.array(F.lit(None).cast("string")), F.array(F.lit("b"), F.lit(None).cast("string"))
    a = constraints.of_tag("a", lambda v: v > 2)
    r = one(spark, a(x, none), constraints.of_tag("b")(x, none), constraints.aligned("coarse", a)(x, none), constraints.in_context(a, ["b"], {"a": ["b"]})(x, near),
            constraints.in_context(a, ["b"])(x, none), constraints.in_context(a, [], {"a": ["c"]})(x, near), constraints.dissolves(x), constraints.all_of()(x, none))
    assert list(r) == [True, False, False, True, False, False, True, True]


def test_bulk_windows(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 40), rnd.randint(0, 3)) for i in range(500)] + [(500, 350, 1)]
    got = [tuple(r) for r in mt.bulk_windows(spark.createDataFrame(rows, "o int, t int, v int").repartition(7), "o", "t", "v", 100).orderBy("window").collect()]
    want, t, v = [], 0, 0
    for _, a, b in rows:
        t, v = t + a, v + b
        if t >= 100:
            want.append((len(want), t, v))
            t = v = 0
    assert got == want
    r = mt.window_report(spark.createDataFrame(want, "window bigint, tokens bigint, vertices bigint"), (1, 1), 4).first()
    assert r["window_count"] == len(want) and r["converged"] and [w["window"] for w in r["recent"]] == [w[0] for w in want[-4:]]
    assert mt.window_report(spark.createDataFrame([], "window bigint, tokens bigint, vertices bigint")).first()["converged"] is False


def test_readers_of_ones_own_and_labels(spark):
    source_code.register_reader("lines", lambda text: [("line", x) for x in text.split("\n")])
    df = spark.createDataFrame([("p", "a\nb"), ("q", None)], "p string, t string")
    assert [tuple(r) for r in source_code.source_elements(df, F.col("p"), F.col("t"), "lines").collect()] == [("p", 0, "line", "a"), ("p", 1, "line", "b")]
    tags = [t for t, _ in source_code.go_elements("package x\n\ntype T struct {\n\tio.Reader\n\t*Base\n\tn int\n}\n\nfunc f() {\nouter:\n\tfor {\n\t\tbreak outer\n\t}\n\treturn\n}\n")]
    assert tags.count("field") == 1 and "for" not in tags and tags[-1] == "return"


def test_a_missing_subpackage_is_told_from_a_broken_one(monkeypatch):
    import __spark_entry__ as entry

    real = entry.import_module

    def broken(name, missing):
        return lambda n: (_ for _ in ()).throw(ModuleNotFoundError(name=missing)) if n == name else real(n)

    monkeypatch.setattr(entry, "import_module", broken("quillscope.llm.queries", "quillscope.llm"))
    assert "p1_found" in entry.queries() and "p3_found" not in entry.queries()
    monkeypatch.setattr(entry, "import_module", broken("quillscope.llm.queries", "numpy"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
