"""Statistics of each text, and whether it is natural prose or a list, table or junk.

Everything is one projection of built-in functions: no user function, no shuffle. Two tables of thresholds decide, both
compiled into that projection: :data:`LINE_RULES` says which lines are structured, :data:`RULES` says for which reasons a text fails.

A line is *structured* if it is an entry of a list (a bullet or number before a few words that end no
sentence), a pair of key and value, code, mostly digits, signs, links, tags or one long token, a row of
separated short entries, or long without any common word. All other lines flow. The characters of flowing lines are prose if
common words are frequent enough among theirs, or if the lines repeat themselves (repetition is judged elsewhere).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CHARS, LINE_BREAKS, Rule, bind, count_chars, fails, measured, words

# Frequent function words of each language.
COMMON = {
    "en": "a an the that this every some and are as at be because been but by can could did do for from had has have he her his how i if in is isn it its me my no nobody not of on or our she so than then there they to too under was we were what when where which while who why will with would you your",
    "de": "als am an auf aus bei bis das dass dem den der des die du durch ein eine er es für gegen hat hinter ich ihm im in ist mit nach neben nicht noch nur oder ob sagt sehr sei seit sich sie sind so um und unter vom von vor war wenn wer wie wir wird zu zum zur zwischen aber niemand",
    "es": "a al aunque bajo como con cuando de del desde donde durante el en entre era es está ha había hasta la las lo los más me mi muy nada nadie no nos o para pero por porque que quien se sea ser será si sin sobre su también un una y ya estaba",
    "fr": "à au aux avec c ce ces comme dans de des du elle en entre est et il ils je là le la les l mais me n ne nous on ou où par pas plus pour pourquoi quand que qu qui sa sans se ses si son sont sous sur un une vous y était sera",
    "it": "a ai al alla anche che chi come con cui da dal della del di dice dietro e era erano fa fra gli ha ho i il in la le lo l ma me mi ne nel nella nessuno non o per perché più poi quando quella se si sia sono su sul tra un una è",
    "nl": "aan als bij daar dan dat de die dit door een en er geen had heb heeft het hij hoe ik in is je maar men met mijn na naar niemand niet nog nu of om onder ook op over te tegen tot uit van veel voor waarom wanneer was wat we wie wij wordt ze zegt zich zij zijn",
    "pt": "a ao as até com como da das de depois diz do dos e ela ele em entre era essa está foi há havia isso já mais mas me na nas nem ninguém no não nós o os ou para pela pelo por porque quando que quem se sem ser será seu sob sobre sua também um uma é",
    "ru": "а без бы был была было быть в все всё вы где да до если есть ещё за и из или им их к как когда ли мне мы на над не нет ни никто ничего но о об однако он она они от очень перед по под после почти при рядом с сам со так там то тоже только у уже чем что это я будет довольно",
}

_MARK = r"^\s*(?:[-*+•‣▪–—>·◦#]+|[(\[]?\d{1,3}[)\].:]|\d{1,3} [-–])\s+"
_LINK = r"(?<!\S)(?:[a-zA-Z+.-]+://\S+|[^\s\p{L}\p{N}]{0,2}[#@][\p{L}\p{N}_]+|\S{26,})"
_PAIR = r"^[^\p{L}\p{N}\s]?[\p{L}\p{N}_.-]+\"?\s*(?:=|->|:)\s*\S+$"
_CODE = r"(?<=[\p{L}\p{N}_])\(|[{}]|[)\]\p{N}\"];\s*$|:=|==|\"\s*:|</?[a-zA-Z]+>"
_SEPARATOR = r"(?<=\s)[·•|/»›>~–—:,;*-]+(?=\s)"
_END = r"[.!?…。！？][\"”»')\]]*\s*$"
_SPACES = r"(?:[^\S ]|[\x{A0}\x{2000}-\x{200B}\x{3000}]|  )\s*"
#: A line of many common words without any of these needs no further test.
_SUSPECT = r"[{}()<>=|;:/\\·•»›\[\]#@_]|\S{26}"

#: Publications of the thresholds. Gopher: Rae et al. 2021, "Scaling Language Models", appendix A.1. FineWeb: Penedo et al. 2024. C4: Raffel et al. 2020.
GOPHER, FINEWEB, C4, OWN = "Gopher", "FineWeb", "C4", "this project"

#: When a line is structured. All are this project's own: the definition of the cases is by characters in sentences, which no published set has.
LINE_RULES: list[Rule] = [
    Rule("entry of a list", "entry_words", "<=", 6, OWN),
    Rule("digits", "digit_share", ">", 0.15, OWN, ("varied", 1)),
    Rule("symbols", "symbol_share", ">", 0.3, OWN),
    Rule("links and tags", "linkless_share", "<", 0.5, OWN),
    Rule("separated entries", "separators_a_word", ">", 0.25, OWN),
    Rule("pair of key and value", "pair", ">=", 1, OWN),
    Rule("code", "code", ">=", 1, OWN),
    Rule("no common words", "common_share", "<", 0.06, OWN, ("varied_words", 12)),
]

#: For which reasons a text fails. The last one makes a case of p3_found.
RULES: list[Rule] = [
    Rule("few words", "n_words", "<", 50, GOPHER),
    Rule("many words", "n_words", ">", 100_000, GOPHER),
    Rule("short words", "mean_word_length", "<", 3, GOPHER),
    Rule("long words", "mean_word_length", ">", 10, GOPHER),
    Rule("hashes and ellipses", "mark_word_ratio", ">", 0.1, GOPHER),
    Rule("words without letters", "alpha_word_share", "<", 0.8, GOPHER),
    Rule("bullets", "bullet_line_share", ">", 0.9, GOPHER),
    Rule("ellipses", "ellipsis_line_share", ">", 0.3, GOPHER),
    Rule("few common words", "n_common_words", "<", 2, GOPHER),
    Rule("lines without end", "end_line_share", "<=", 0.12, FINEWEB),
    Rule("short lines", "short_line_share", ">=", 0.67, FINEWEB),
    Rule("curly bracket", "n_braces", ">=", 1, C4),
    Rule("no prose", "prose_share", "<", 0.5, OWN, ("n_chars", 80)),
]
NO_PROSE = RULES[-1].reason
NAMES = [
    "n_chars", "n_words", "mean_word_length", "symbol_share", "mark_word_ratio", "alpha_word_share", "n_lines", "end_line_share", "bullet_line_share",
    "ellipsis_line_share", "short_line_share", "n_common_words", "common_word_share", "n_braces", "prose_share",
]


def common_words(w: Column) -> Column:
    """How many of the words are common ones of any language."""
    return F.size(F.filter(w, lambda x: x.isin(sorted({y for v in COMMON.values() for y in v.split()}))))


def _lines(text: Column) -> Column:
    """Each line with what the statistics of the text need of it."""
    cut = F.transform(F.split(text, LINE_BREAKS), lambda x: F.struct(F.length(x).alias("n"), x.alias("raw"), F.regexp_replace(x, _MARK, "").alias("body")))
    clean = F.transform(cut, lambda x: F.struct(x["n"].alias("n"), (x["raw"] != x["body"]).alias("mark"), F.trim(F.regexp_replace(x["body"], _SPACES, " ")).alias("c")))
    with_words = F.transform(clean, lambda x: F.struct(x["n"].alias("n"), x["mark"].alias("mark"), x["c"].alias("c"), F.length(x["c"]).alias("size"), words(x["c"]).alias("w")))
    parts = F.transform(
        with_words,
        lambda x: F.struct(
            *[x[f].alias(f) for f in ("n", "mark", "c", "size", "w")], F.size(x["w"]).alias("k"), common_words(x["w"]).alias("common"), x["c"].rlike(_END).alias("end"),
        ),
    )

    def judged(x: Column) -> Column:
        size, k = F.greatest(x["size"], F.lit(1)), x["k"]
        # A line that repeats itself is no table and no junk.
        distinct = F.size(F.array_distinct(x["w"])) > 0.5 * k
        statistics = {
            "entry_words": F.when(x["mark"] & ~x["end"], k).otherwise(1 << 30),
            "digit_share": count_chars(x["c"], r"[^\p{Nd}]+") / size,
            "varied": F.when(k < 12, 1).otherwise(distinct.cast("int")),
            "symbol_share": count_chars(x["c"], CHARS) / size,
            "linkless_share": count_chars(x["c"], _LINK) / size,
            "separators_a_word": F.regexp_count(x["c"], F.lit(_SEPARATOR)) / F.greatest(k, F.lit(1)) + F.when(k == 0, F.regexp_count(x["c"], F.lit(_SEPARATOR))).otherwise(0),
            "pair": x["c"].rlike(_PAIR).cast("int"),
            "code": x["c"].rlike(_CODE).cast("int"),
            "common_share": x["common"] / F.greatest(k, F.lit(1)),
            "varied_words": F.when((k >= 12) & (x["common"] < 0.06 * k) & distinct, k).otherwise(0),
        }
        sure = (k >= 8) & (x["common"] >= 0.2 * k) & ~x["c"].rlike(_SUSPECT)
        structured = (x["size"] > 0) & ~sure & fails(LINE_RULES, statistics)
        return F.struct(
            *[x[f].alias(f) for f in ("n", "w", "k", "common", "end", "mark")], F.endswith(x["c"], F.lit("…")).alias("dots"), (x["size"] > 0).alias("full"),
            (x["size"] < 30).alias("short"), structured.alias("structured"),
        )

    return F.transform(parts, judged)


def _total(lines: Column, f) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, y: a + f(y))


def statistics(text: Column, names: list[str] = NAMES) -> Column:
    """A struct of statistics of a text, all of :data:`NAMES` or some; null for a null text. Shares of nothing are 0.

    A text is natural if common words are frequent among its flowing lines, or if these repeat themselves.
    """
    by_words = {"n_words", "mean_word_length", "mark_word_ratio", "alpha_word_share", "n_common_words", "common_word_share"} & set(names)

    def of(x: Column) -> Column:
        lines = x["lines"]
        sums = {
            "flow_words": lambda y: F.when(y["structured"], 0).otherwise(y["k"]), "flow_common": lambda y: F.when(y["structured"], 0).otherwise(y["common"]),
            "flow_n": lambda y: F.when(y["structured"], 0).otherwise(y["n"] + 1), "n_lines": lambda y: y["full"].cast("int"),
            "ends": lambda y: (y["full"] & y["end"]).cast("int"), "marks": lambda y: (y["full"] & y["mark"]).cast("int"),
            "dots": lambda y: (y["full"] & y["dots"]).cast("int"), "short": lambda y: (y["full"] & y["short"]).cast("int"),
        }
        all_words = words(x["text"]) if by_words else F.array().cast("array<string>")
        return bind(F.struct(all_words.alias("w"), lines.alias("lines"), x["text"].alias("text"), *[_total(lines, f).alias(n) for n, f in sums.items()]), counted)

    def counted(x: Column) -> Column:
        lengths = F.aggregate(x["w"], F.lit(0).cast("bigint"), lambda a, y: a + F.length(y))
        fields = ["w", "lines", "text", "flow_words", "flow_common", "flow_n", "n_lines", "ends", "marks", "dots", "short"]
        return bind(F.struct(*[x[f].alias(f) for f in fields], F.length(x["text"]).alias("n_chars"), F.size(x["w"]).alias("n_words"), common_words(x["w"]).alias("common"), lengths.alias("lengths")), numbers)

    def numbers(x: Column) -> Column:
        share = lambda a, b: a / F.greatest(b, F.lit(1))
        flow_w = F.flatten(F.transform(F.filter(x["lines"], lambda y: ~y["structured"]), lambda y: y["w"]))
        natural = (x["flow_common"] >= 0.08 * x["flow_words"]) | (F.size(F.array_distinct(flow_w)) <= 0.5 * x["flow_words"])
        prose = F.when((x["flow_words"] > 0) & natural, F.least(F.lit(1.0), share(x["flow_n"], x["n_chars"]))).otherwise(0.0)
        marks = F.regexp_count(x["text"], F.lit(r"#|…|\.\.\."))
        values = {
            "n_chars": x["n_chars"].cast("bigint"), "n_words": x["n_words"].cast("bigint"), "mean_word_length": share(x["lengths"], x["n_words"]),
            "symbol_share": share(count_chars(x["text"], CHARS), x["n_chars"]), "mark_word_ratio": share(marks, x["n_words"]),
            "alpha_word_share": share(F.size(F.filter(x["w"], lambda y: y.rlike(r"\p{L}"))), x["n_words"]), "n_lines": x["n_lines"],
            "end_line_share": share(x["ends"], x["n_lines"]), "bullet_line_share": share(x["marks"], x["n_lines"]), "ellipsis_line_share": share(x["dots"], x["n_lines"]),
            "short_line_share": share(x["short"], x["n_lines"]), "n_common_words": x["common"].cast("bigint"), "common_word_share": share(x["common"], x["n_words"]),
            "n_braces": F.regexp_count(x["text"], F.lit(r"[{}]")), "prose_share": prose,
        }
        return F.struct(*[values[n].alias(n) for n in names])

    return F.when(text.isNotNull(), bind(F.struct(_lines(text).alias("lines"), text.alias("text")), of))


def is_no_prose(text: Column) -> Column:
    """Whether a text fails :data:`RULES` as no prose, as a condition that evaluates the statistics which that takes once; false for null."""
    rules = [r for r in RULES if r.reason == NO_PROSE]
    names = sorted({x for r in rules for x in (r.statistic, *(r.least or ())[:1])})
    return F.coalesce(F.exists(measured(rules, statistics(text, names), names), lambda s: F.array_contains(s["reasons"], NO_PROSE)), F.lit(False))


def judge(records: DataFrame, key: dict[str, Column], text: Column) -> DataFrame:
    """The key's columns, all statistics, and ``reasons``: the rules of :data:`RULES` that the text fails.

    One row a record, also of repeated ones; a null text has null statistics and the one reason ``null``; an
    empty one has zeros. Other columns, under any names, are ignored. Long texts are taken whole.
    """
    rows = records.select(*[c.alias(n) for n, c in key.items()], text.alias("__text"))
    return rows.select(*key, F.inline(measured(RULES, statistics(F.col("__text")), NAMES)))
