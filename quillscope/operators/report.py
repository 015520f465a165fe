"""Accuracy reports over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, left, right
from ..session import Scratch


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def group_stats(verdicts: DataFrame, *by: str) -> DataFrame:
    """Accuracy and averages of a group of human texts; rows without a verdict count as errors. With ``troll_score`` and ``ms`` if they are there."""
    n = F.count("human")
    more = [F.round(F.avg(c), 6).alias(a) for c, a in (("troll_score", "avg_troll"), ("ms", "avg_ms")) if c in verdicts.columns]
    return verdicts.groupBy(*by).agg(
        n.alias("n"), F.count_if(F.col("human").isNull()).alias("errors"), F.count_if("human").alias("human"),
        F.round(_percent(F.count_if("human"), n), 4).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.round(F.avg("deep_walk"), 6).alias("avg_walk"), F.round(F.avg("long_miss_rate"), 6).alias("avg_miss"), *more,
    )


def by_model(verdicts: DataFrame) -> DataFrame:
    """Detection by ``model`` with a total row (``is_total`` 1, model null), with ``avg_troll`` if there is a ``troll_score``."""
    more = [F.round(F.avg("troll_score"), 6).alias("avg_troll")] if "troll_score" in verdicts.columns else []
    caught = F.count_if(~F.col("human"))
    return verdicts.rollup("model").agg(
        F.grouping("model").cast("int").alias("is_total"), F.count("*").alias("n"), caught.alias("detected"), F.round(_percent(caught, F.count("*")), 4).alias("rate"),
        F.round(F.avg("deep_walk"), 6).alias("avg_walk"), F.round(F.avg("long_miss_rate"), 6).alias("avg_miss"), *more,
    )


def balanced(verdicts: DataFrame) -> DataFrame:
    """(human_correct, ai_detected, balanced, avg_confidence) in percent; null for a side without texts."""
    people, machines = F.count_if("is_human"), F.count_if(~F.col("is_human"))
    right = _percent(F.count_if(F.col("is_human") & F.col("human")), people)
    caught = _percent(F.count_if(~F.col("is_human") & ~F.col("human")), machines)
    sums = verdicts.agg(right.alias("r"), caught.alias("c"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return sums.select(F.round("r", 4).alias("human_correct"), F.round("c", 4).alias("ai_detected"), F.round((F.col("r") + F.col("c")) / 2, 4).alias("balanced"), "avg_confidence")


def leaderboard(scores: DataFrame, model: str, score: str, least: int = 1) -> DataFrame:
    """Models by falling average score, ties by name, with their rank."""
    means = scores.groupBy(model).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("avg_score")).where(F.col("n") >= least)
    order = Window.orderBy(F.desc("avg_score"), F.asc(model))  # one row a model
    return means.withColumn("place", F.row_number().over(order).cast("bigint"))


def running_share(chunks: DataFrame, order: str, detected: str, total: str) -> DataFrame:
    """Cumulative share of detections over chunks of time, in percent; 0 while there are none."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # one row a chunk
    d, t = F.sum(detected).over(so_far), F.sum(total).over(so_far)
    return chunks.withColumn("running_detected", d).withColumn("running_total", t).withColumn("running_share", F.round(F.when(t > 0, 100.0 * d / t).otherwise(0.0), 4))


def together(human: DataFrame, *groups: DataFrame) -> DataFrame:
    """Verdicts on human text and on any groups of machine text (with ``model``) as one bag with ``is_human``; columns that a part lacks are null."""
    out = human.withColumn("is_human", F.lit(True)).withColumn("model", F.lit("human"))
    for rows in groups:
        out = out.unionByName(rows.withColumn("is_human", F.lit(False)), allowMissingColumns=True)
    return out


def outcome_counts(results: DataFrame, *by: str) -> DataFrame:
    """(by, accepted, rejected, failed, total) of the answers of relays: ``accepted`` true or false, null for none."""
    ok = F.col("accepted")
    return results.groupBy(*by).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok.isNull()).alias("failed"), F.count("*").alias("total"))


def _sides(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables (one row on both sides, one row a model) of verdicts with ``is_human``, ``model``, ``human``, ``deep_walk``, ``long_miss_rate``, ``troll_score``, ``ms``; rows without a verdict are left out."""
    known = verdicts.where("human is not null")
    of_people = lambda c: F.avg(F.when(F.col("is_human"), F.col(c)))
    one = known.agg(
        F.count_if("is_human").alias("hn"), F.count_if(F.col("is_human") & F.col("human")).alias("hc"), F.count_if(~F.col("is_human")).alias("an"),
        F.count_if(~F.col("is_human") & ~F.col("human")).alias("ad"), *[of_people(c).alias(a) for c, a in (("deep_walk", "walk"), ("long_miss_rate", "miss"), ("troll_score", "troll"), ("ms", "ms"))],
    )
    rates = {"right": F.when(F.col("hn") > 0, F.col("hc") * 100.0 / F.col("hn")), "caught": F.when(F.col("an") > 0, F.col("ad") * 100.0 / F.col("an"))}
    models = known.where("not is_human").groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(~F.col("human")).alias("d"), F.avg("deep_walk").alias("walk"), F.avg("long_miss_rate").alias("miss"), F.avg("troll_score").alias("troll"),
    )
    places = Window.orderBy(F.desc("troll"), F.asc("model"))  # one row a model
    scratch = Scratch(verdicts.sparkSession, "report")  # each part of the page reads them again
    return scratch.write(one.withColumns(rates), "sides"), scratch.write(models.withColumn("place", F.row_number().over(places)), "models")


def _page(parts: list[tuple[DataFrame, Column | None, Column, list[Column | str]]]) -> DataFrame:
    """(line_no, line) of parts (rows, condition, order of the rows, lines of a row), one below the other."""
    out = None
    for k, (rows, when, order, lines) in enumerate(parts):
        each = rows if when is None else rows.where(when)
        texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
        flat = each.select(F.lit(k).alias("part"), order.cast("string").alias("o"), F.posexplode(texts).alias("i", "line"))
        out = flat if out is None else out.unionByName(flat)
    return out.select((F.row_number().over(Window.orderBy("part", "o", "i"))).cast("bigint").alias("line_no"), "line")  # a few lines a model


def _c(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def markdown_report(verdicts: DataFrame, title: str = "Detection Benchmark", about: str = "Deterministic detection of machine text.", with_troll: bool = True) -> DataFrame:
    """(line_no, line) of the report in Markdown; sections without texts are left out."""
    one, models = _sides(verdicts)
    col, first = F.col, F.lit("")
    both, people, machines = (col("hn") > 0) & (col("an") > 0), col("hn") > 0, col("an") > 0
    by_place, pc = F.lpad(col("place").cast("string"), 9, "0"), lambda c: _c(fixed(col(c) * 100, 1), "%")
    # The headings and the form of the lines.
    extra, cell = (" Manipulation |", "-------------|") if with_troll else ("", "")
    row = [_c("| ", col("model"), " | ", col("d").cast("string"), "/", col("n").cast("string"), " | ", fixed(col("d") * 100.0 / col("n"), 0), "% | ", fixed(col("walk"), 3), " | ", fixed(col("miss"), 3), " |", *([" ", pc("troll"), " |"] if with_troll else []))]
    parts = [
        (one, None, first, [f"# {title}", "", about, ""]),
        (one, both, first, ["## Overall Accuracy", "", "| Metric | Value |", "|--------|-------|", _c("| Human correct (true negative) | ", fixed(col("right"), 1), "% |"),
                            _c("| AI detected (true positive) | ", fixed(col("caught"), 1), "% |"), _c("| **Balanced accuracy** | **", fixed((col("right") + col("caught")) / 2, 1), "%** |"), ""]),
        (one, people, first, ["## Human Text", "", _c("- **", col("hn").cast("string"), "** samples, **", fixed(col("right"), 1), "%** correctly identified as human"),
                              _c("- Avg deep walk: ", fixed(col("walk"), 3), " (boundary: multi-level)"), _c("- Avg long-miss rate: ", fixed(col("miss"), 3), " (boundary: multi-level)"),
                              _c("- Avg detection time: ", fixed(col("ms"), 0), " ms/sample"), *([_c("- Avg manipulation score: ", pc("troll"), " (human baseline)")] if with_troll else []), ""]),
        (one, machines, first, ["## AI Detection by Model", "", "| Model | Detected | Rate | Avg Walk | Avg Miss |" + extra, "|-------|----------|------|----------|----------|" + cell]),
        (models, None, col("model"), row),
        (one, machines, first, [_c("| **Total** | **", col("ad").cast("string"), "/", col("an").cast("string"), "** | **", fixed(col("caught"), 1), "%** | | |" + (" |" if with_troll else "")), ""]),
    ]
    if with_troll:
        parts += [
            (one, machines, first, ["## Manipulation Score Leaderboard", "", "Structural match against a manipulation/rhetoric lattice.", "Higher = more manipulation-like prosodic patterns.", "", "| Rank | Model | Score |", "|------|-------|-------|"]),
            (models, None, by_place, [_c("| ", col("place").cast("string"), " | ", col("model"), " | ", pc("troll"), " |")]),
            (one, both, first, [_c("| -- | *human baseline* | *", pc("troll"), "* |")]),
            (one, machines, first, [""]),
        ]
    return _page([*parts, (one, None, first, ["---"])])


def box_report(verdicts: DataFrame, title: str = "DETECTION BENCHMARK REPORT", with_troll: bool = True) -> DataFrame:
    """(line_no, line) of the report in a box; sections without texts are left out."""
    one, models = _sides(verdicts)
    col, first, width = F.col, F.lit(""), 63
    both, people, machines = (col("hn") > 0) & (col("an") > 0), col("hn") > 0, col("an") > 0
    # The frame, the headings and the widths of the fields.
    top, middle, bottom = "╔" + "═" * width + "╗", "╠" + "═" * width + "╣", "╚" + "═" * width + "╝"
    blank, rule = "║" + " " * width + "║", "║  " + "─" * 57 + "    ║"
    head = lambda t: "║" + ("  " + t).ljust(width) + "║"
    end = lambda n: " " * n + "║"
    bar = lambda c, sign: (F.repeat(F.lit(sign), F.floor(col(c) * 20).cast("int")), F.repeat(F.lit(" "), (20 - F.floor(col(c) * 20)).cast("int")))
    troll = [" troll=", fixed(col("troll") * 100, 1), "%"] if with_troll else []
    by_place = F.lpad(col("place").cast("string"), 9, "0")
    parts = [
        (one, None, first, [top, "║" + title.center(width) + "║", middle]),
        (one, people, first, [
            blank, head("HUMAN TEXT (known-human corpus)"), rule, _c("║  samples:         ", left(col("hn"), 44), "║"),
            _c("║  correct (HUMAN): ", left(col("hc"), 5), "  (", fixed(col("right"), 1), "%)", end(31)), _c("║  false positive:  ", left(col("hn") - col("hc"), 5), "  (", fixed(100 - col("right"), 1), "% misclassified as AI)", end(14)),
            _c("║  avg deep walk:   ", fixed(col("walk"), 3), "  (boundary: multi-level)", end(18)), _c("║  avg long-miss:   ", fixed(col("miss"), 3), "  (boundary: multi-level)", end(18)),
            _c("║  avg time:        ", fixed(col("ms"), 0), " ms/sample", end(30)), *([_c("║  avg troll score: ", fixed(col("troll"), 3), end(38))] if with_troll else []),
        ]),
        (one, machines, first, [blank, head("MACHINE TEXT (by model)"), rule]),
        (models, None, col("model"), [_c("║  ", left(col("model"), 20), " ", right(col("d"), 2), "/", left(col("n"), 3), " detected  (walk=", fixed(col("walk"), 3), " miss=", fixed(col("miss"), 3), *troll, ")  ║")]),
        (one, machines, first, [rule, _c("║  TOTAL:            ", right(col("ad"), 3), "/", left(col("an"), 4), "  (", fixed(col("caught"), 1), "%)", end(26))]),
    ]
    if with_troll:
        parts += [
            (one, machines, first, [blank, middle, head("MANIPULATION SCORE LEADERBOARD"), rule]),
            (models, None, by_place, [_c("║  ", left(col("model"), 20), " ", fixed(col("troll") * 100, 1), "% ", *bar("troll", "█"), "║")]),
            (one, both, first, [_c("║  ", left(F.lit("human"), 20), " ", fixed(col("troll") * 100, 1), "% ", *bar("troll", "░"), "(human baseline)  ║")]),
        ]
    parts.append((one, both, first, [
        blank, middle, head("COMBINED ACCURACY"), rule, _c("║  human correct:   ", right(fixed(col("right"), 1), 5), "%  (true negative rate)", end(15)),
        _c("║  AI detected:     ", right(fixed(col("caught"), 1), 5), "%  (true positive rate)", end(15)), _c("║  balanced acc:    ", right(fixed((col("right") + col("caught")) / 2, 1), 5), "%", end(37)),
    ]))
    return _page([*parts, (one, None, first, [blank, bottom])])
