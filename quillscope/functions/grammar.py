"""Grammars as sets of directed pairs of neighbouring tags, and how many nodes of each kind a text of a size gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import bind
from .tokens import CHANNELS

NEIGHBOUR_SCHEMA = "tag string, neighbor string"
# The pairs that natural text excludes, and the shares of its kinds in percent.
NATURAL_EXCLUDED = [("w5", "w5"), ("space", "space"), ("origin", "origin")]
TEXT_SHARES = {"w1": 5, "w2": 19, "w3": 19, "w4": 14, "w5": 5, "punct": 10, "origin": 3}
LEAST_TARGET = 8
# Which elements of Go code may stand beside which, by tag; statements of a body share their neighbours.
STATEMENTS = ["assign", "return", "if", "for", "switch", "select", "go", "send", "expr", "defer", "decl", "branch", "case", "comm"]
IDENTIFIERS = ["ident:field-name", "ident:func-name", "ident:method-name", "ident:param", "ident:receiver", "ident:result", "ident:type-name", "ident:var-name"]
GO_AST = {
    "package": ["import", "func", "method", "type", "var", "directive", "comment", "file"],
    "import": ["package", "func", "method", "type", "var"],
    "file": ["package", "import", "func", "method", "type", "comment"],
    "directive": ["func", "method", "type", "var", "package"],
    "comment": ["package", "func", "method", "type", "struct", "interface", "field", "var", "file"],
    "func": ["type", "var", "comment", "ident:func-name", "ident:param", "ident:result", "ident:var-name", *STATEMENTS],
    "method": ["type", "struct", "var", "comment", "ident:method-name", "ident:receiver", "ident:param", "ident:result", "ident:var-name", *STATEMENTS],
    "type": ["struct", "interface", "field", "func", "method", "comment", "ident:type-name"],
    "struct": ["field", "type", "method", "comment", "ident:field-name", "ident:type-name"],
    "interface": ["method", "type", "comment", "ident:method-name"],
    "field": ["struct", "type", "comment", "ident:field-name"],
    "var": ["type", "assign", "expr", "func", "ident:var-name"],
    "ident:func-name": ["func", "expr"],
    "ident:method-name": ["method", "interface", "expr"],
    "ident:type-name": ["type", "struct", "interface", "field"],
    "ident:field-name": ["struct", "field", "type"],
    "ident:param": ["func", "method"],
    "ident:result": ["func", "method"],
    "ident:receiver": ["method", "struct"],
    "ident:var-name": ["var", "assign", "func", "method"],
    "grammar-rule": ["func", "method", "type", "struct", "interface", "field", "import", "var", "assign", "return", "if", "for", "package", "expr", "switch", "select"],
    "word": ["punct", "word", "comment"],
    "punct": ["word", "punct"],
    **dict.fromkeys(STATEMENTS, [*IDENTIFIERS, *STATEMENTS]),
}
GO_EMIT = {
    "package": ["import"], "import": ["package"], "file": ["package"], "directive": ["func", "method"],
    "func": STATEMENTS, "method": STATEMENTS,
    "type": ["struct", "interface"], "struct": ["field"], "interface": ["method"], "field": ["struct", "ident:field-name"], "var": ["ident:var-name"],
    "ident:func-name": ["func"], "ident:method-name": ["method", "interface"], "ident:type-name": ["type"], "ident:field-name": ["field", "struct"],
    "ident:param": ["func", "method"], "ident:result": ["func", "method"], "ident:receiver": ["method"], "ident:var-name": ["var"],
    "comment": ["func", "method", "type", "struct"], "grammar-rule": ["func", "method", "type", "struct", "interface"],
    "word": ["punct", "word"], "punct": ["word", "punct"],
    **dict.fromkeys(STATEMENTS, STATEMENTS),
}
# Weights of the elements of Go code, and the percentage of nodes for words and signs.
GO_WEIGHTS = {
    "package": 1, "import": 2, "func": 4, "method": 4, "type": 3, "struct": 2, "interface": 2, "field": 3, "var": 2, "directive": 1,
    "assign": 4, "return": 3, "if": 3, "for": 2, "switch": 1, "select": 1, "go": 1, "send": 1, "expr": 3, "defer": 1, "decl": 1, "branch": 1, "case": 1, "comm": 1,
    "ident:func-name": 1, "ident:method-name": 1, "ident:type-name": 1, "ident:field-name": 1, "ident:param": 1, "ident:result": 1, "ident:receiver": 1, "ident:var-name": 1,
    "grammar-rule": 2, "comment": 1, "file": 1,
}
GO_TEXT_PERCENT, GO_REST = 15, "ident:var-name"


def natural_text(spark: SparkSession) -> DataFrame:
    """Every pair of the eight tags but those excluded."""
    tags = spark.createDataFrame([(t,) for t in CHANNELS], "tag string")
    pairs = tags.crossJoin(tags.select(F.col("tag").alias("neighbor")))  # eight by eight
    return pairs.join(spark.createDataFrame(NATURAL_EXCLUDED, NEIGHBOUR_SCHEMA), ["tag", "neighbor"], "left_anti")


def edges(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    """(tag, neighbor) of a grammar given by tag."""
    return spark.createDataFrame([(tag, n) for tag, near in rules.items() for n in near], NEIGHBOUR_SCHEMA)


def can_neighbor(pairs: DataFrame, grammar: DataFrame) -> DataFrame:
    """The given (tag, neighbor) rows that the grammar has."""
    return pairs.join(F.broadcast(grammar), ["tag", "neighbor"], "left_semi")  # a grammar has at most one row for each pair of tags


def neighbors_of(grammar: DataFrame) -> DataFrame:
    return grammar.groupBy("tag").agg(F.array_sort(F.collect_set("neighbor")).alias("neighbors"))


def tags(grammar: DataFrame) -> DataFrame:
    return grammar.select("tag").union(grammar.select("neighbor")).distinct()


def text_counts(target: Column) -> Column:
    """Map of kind to count: the shares of the target, at least one each, and the rest for space."""
    size = F.greatest(target, F.lit(LEAST_TARGET))
    counts = {k: F.greatest(F.lit(1), F.floor(size * p / 100)).cast("bigint") for k, p in TEXT_SHARES.items()}
    used = sum(counts.values(), F.lit(0))
    space = F.greatest(F.lit(1), size - used).cast("bigint")
    return F.create_map(*[x for k, c in {**counts, "space": space}.items() for x in (F.lit(k), c)])


def go_counts(target: Column, num: Column, denom: Column) -> Column:
    """Map of element to count for ``target`` nodes of Go code, with ``num / denom`` of the text's nodes for words.

    Words and signs get their percentage (two nodes at least, one of them a sign); the others share the rest by weight, at least
    one each, so a small target may be exceeded; what rounding leaves goes to names of variables.
    """
    def of(x: Column) -> Column:
        text = F.greatest(F.lit(2), F.call_function("div", x["t"] * GO_TEXT_PERCENT, F.lit(100)))
        asked = F.call_function("div", text * x["n"], x["d"])
        words = F.when(text - asked < 1, text - 1).otherwise(asked)
        rest = F.greatest(F.lit(1), x["t"] - text)
        whole = sum(GO_WEIGHTS.values())
        counts = {tag: F.greatest(F.lit(1), F.call_function("div", rest * w, F.lit(whole))) for tag, w in GO_WEIGHTS.items()}
        used = sum(counts.values(), text)
        counts[GO_REST] = counts[GO_REST] + F.greatest(F.lit(0), x["t"] - used)
        return F.create_map(*[y for k, c in {**counts, "word": words, "punct": text - words}.items() for y in (F.lit(k), c.cast("bigint"))])

    return bind(F.struct(target.cast("bigint").alias("t"), num.cast("bigint").alias("n"), denom.cast("bigint").alias("d")), of)


def admits(elements: Column, grammar: dict[str, list[str]]) -> Column:
    """Whether each two neighbours of an array of tags are a pair of the grammar."""
    table = F.create_map(*[x for k, v in grammar.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    pairs = F.arrays_zip(F.slice(elements, F.lit(1), F.greatest(F.size(elements) - 1, F.lit(0))).alias("a"), F.slice(elements, F.lit(2), F.greatest(F.size(elements) - 1, F.lit(0))).alias("b"))
    return F.forall(pairs, lambda p: F.coalesce(F.array_contains(F.try_element_at(table, p["a"]), p["b"]), F.lit(False)))
