"""Repeated content within a document: a table of thresholds compiled into one projection of length, symbol, common-word, line and run ratios, without user functions.

The share of repeated words is exact: every run of five words is hashed in place, the hashes are
sorted with their places, and a run that is not the first of its hash marks its five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import FINEWEB, GOPHER, OWN, common_words
from .rules import CHARS, LINE_BREAKS, Rule, bind, count_chars, measured, words

RUN = 5

#: For which reasons a text fails. Those of Gopher are its bounds for the share of characters; the last one makes a case of p7_found.
RULES: list[Rule] = [
    Rule("repeated lines", "line_share", ">", 0.2, GOPHER),
    Rule("repeated paragraphs", "paragraph_share", ">", 0.2, GOPHER),
    Rule("repeated sentences", "sentence_share", ">", 0.3, OWN),
    Rule("one word over and over", "top_word_share", ">", 0.3, OWN),
    Rule("hashes and ellipses", "mark_word_ratio", ">", 0.1, GOPHER),
    Rule("symbols", "symbol_share", ">", 0.3, OWN),
    Rule("few common words", "n_common_words", "<", 2, GOPHER),
    Rule("lines without end", "end_line_share", "<=", 0.12, FINEWEB),
    # At least a third: three times the words in repeated runs, less all words.
    Rule("repeated runs of words", "run_surplus", ">=", 0, OWN, ("n_words", 30)),
]
REPEATED_RUNS = RULES[-1].reason
NAMES = [
    "n_words", "run_words", "run_word_share", "run_surplus", "line_share", "paragraph_share", "sentence_share", "top_word_share", "symbol_share", "mark_word_ratio",
    "n_common_words", "end_line_share",
]


def covered_words(w: Column, run: int = RUN) -> Column:
    """How many words lie in runs of ``run`` words that began at an earlier word too; in n log n steps, and in n where no run occurs twice."""
    def of(words_hashed: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(words_hashed) - run)
        return bind(F.transform(place, lambda i: F.xxhash64(*[F.get(words_hashed, i + k) for k in range(run)])), counted)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(placed, again))

    def again(s: Column) -> Column:
        later = F.filter(F.transform(s, lambda x, k: F.when((k > 0) & (F.get(s, k - 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
        start = F.struct(F.lit(0).alias("n"), F.lit(-run).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(run), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(later), start, step, lambda a: a["n"])

    return F.when(F.size(w) >= run, bind(F.transform(w, lambda x: F.xxhash64(x)), of)).otherwise(0)


def _repeated_share(parts: Column) -> Column:
    """Share of the characters in parts that occurred before, of parts cleaned to words."""
    def of(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
        first = F.aggregate(F.array_distinct(p), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
        return F.when(total > 0, (total - first) / total).otherwise(0.0)

    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return bind(F.filter(clean, lambda x: x != ""), of)


def _top_share(w: Column) -> Column:
    """Share of the most frequent word."""
    def of(s: Column) -> Column:
        start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

        def step(a: Column, x: Column) -> Column:
            n = F.when(a["w"] == x, a["n"] + 1).otherwise(1)
            return F.struct(x.alias("w"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

        return F.aggregate(s, start, step, lambda a: a["most"] / F.greatest(F.size(s), F.lit(1)))

    return bind(F.sort_array(w), of)


def statistics(text: Column) -> Column:
    """A struct of the statistics :data:`NAMES`; null for a null text. Shares of nothing are 0."""
    def of(w: Column) -> Column:
        return bind(F.struct(w.alias("w"), F.size(w).alias("n"), covered_words(w).alias("run"), F.filter(F.split(text, LINE_BREAKS), lambda x: x != "").alias("lines")), numbers)

    def numbers(x: Column) -> Column:
        share = lambda a, b: a / F.greatest(b, F.lit(1))
        ends = F.size(F.filter(x["lines"], lambda y: y.rlike(r"[.!?…。！？][\"”»')\]]*\s*$")))
        values = {
            "n_words": x["n"].cast("bigint"), "run_words": x["run"].cast("bigint"), "run_word_share": share(x["run"], x["n"]), "run_surplus": (x["run"] * 3 - x["n"]).cast("bigint"),
            "line_share": _repeated_share(x["lines"]), "paragraph_share": _repeated_share(F.split(text, r"(?:\r?\n\s*){2,}")),
            "sentence_share": _repeated_share(F.split(text, r"(?<=[.!?…])\s+")), "top_word_share": _top_share(x["w"]),
            "symbol_share": share(count_chars(text, CHARS), F.length(text)), "mark_word_ratio": share(F.regexp_count(text, F.lit(r"#|…|\.\.\.")), x["n"]),
            "n_common_words": common_words(x["w"]).cast("bigint"), "end_line_share": share(ends, F.size(x["lines"])),
        }
        return F.struct(*[values[n].alias(n) for n in NAMES])

    return F.when(text.isNotNull(), bind(words(text), of))


def measure(records: DataFrame, key: dict[str, Column], text: Column) -> DataFrame:
    """The key's columns, the statistics, and ``reasons``: the rules of :data:`RULES` that the text fails.

    One row a record, also of repeated ones; a null text has null statistics and the one reason ``null``; an empty
    one has zeros. Other columns, under any names, are ignored. Long texts are taken whole.
    """
    rows = records.select(*[c.alias(n) for n, c in key.items()], text.alias("__text"))
    return rows.select(*key, F.inline(measured(RULES, statistics(F.col("__text")), NAMES)))
