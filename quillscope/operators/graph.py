"""The graph of events: nodes, resolved and missing references, clusters and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..plans.skew import hot_keys, salted_join


def nodes(events: DataFrame) -> DataFrame:
    """(id, pubkey, kind, tags): each event once, at its first arrival; events without an id are none."""
    named = events.where(F.col("id").isNotNull()).select(
        norm_key(F.col("id")).alias("id"), F.struct(F.col("received_at").isNull(), "received_at", norm_key(F.col("pubkey")).alias("pubkey"), "kind", "tags").alias("e")
    )
    return named.groupBy("id").agg(F.min("e").alias("e")).select("id", "e.pubkey", "e.kind", "e.tags")


def references(graph: DataFrame) -> DataFrame:
    """(id, pos, type, key): one row for each e and p tag with a value, repeated ones too."""
    tags = graph.select("id", F.posexplode("tags").alias("pos", "t"))
    name = F.get("t", F.lit(0))
    usable = (F.size("t") >= 2) & name.isin("e", "p") & F.get("t", F.lit(1)).isNotNull()
    return tags.where(usable).select("id", "pos", F.when(name == "e", "event").otherwise("pubkey").alias("type"), norm_key(F.get("t", F.lit(1))).alias("key"))


def _known(graph: DataFrame) -> DataFrame:
    people = graph.where("pubkey is not null").select(F.lit("pubkey").alias("type"), F.col("pubkey").alias("key")).distinct()
    return graph.select(F.lit("event").alias("type"), F.col("id").alias("key")).union(people).select(F.concat_ws(":", "type", "key").alias("probe"))


def resolve(graph: DataFrame, how: str) -> DataFrame:
    """The references to what is there (``left_semi``) or is not (``left_anti``); hot targets are salted."""
    refs = references(graph).withColumn("probe", F.concat_ws(":", "type", "key"))
    return salted_join(refs, _known(graph), "probe", how, hot_keys(refs, "probe"), F.struct("id", "pos")).select("id", "pos", "type", "key")


def bonds(graph: DataFrame) -> DataFrame:
    """References to events that are there."""
    return resolve(graph, "left_semi").where("type = 'event'")


def orphans(graph: DataFrame) -> DataFrame:
    """References to events and authors that are not there."""
    return resolve(graph, "left_anti")


def in_refs(graph: DataFrame) -> DataFrame:
    """(id, n_in_refs) of every event."""
    counts = bonds(graph).groupBy(F.col("key").alias("id")).agg(F.count("*").alias("n_in_refs"))
    return graph.select("id").join(counts, "id", "left").fillna(0, ["n_in_refs"])


def clusters(graph: DataFrame) -> DataFrame:
    """(by, member, size): events by author and by kind, both in one pass of grouping sets."""
    sets = graph.groupingSets([["pubkey"], ["kind"]], "pubkey", "kind").agg(F.grouping("pubkey").alias("g"), F.count("*").alias("size"))
    return sets.select(F.when(F.col("g") == 0, "author").otherwise("kind").alias("by"), F.when(F.col("g") == 0, F.col("pubkey")).otherwise(F.col("kind").cast("string")).alias("member"), "size")


def stats(graph: DataFrame) -> DataFrame:
    """One row: events, authors, kinds, bonds, orphans and the largest clusters."""
    sizes = clusters(graph).where("member is not null").groupBy("by").agg(F.count("*").alias("n"), F.max("size").alias("most"))
    top = sizes.agg(*[F.coalesce(F.max(F.when(F.col("by") == b, F.col(c))), F.lit(0)).alias(a) for b, c, a in (("author", "n", "authors"), ("kind", "n", "kinds"), ("author", "most", "largest_author"), ("kind", "most", "largest_kind"))])
    counts = graph.agg(F.count("*").alias("events")).join(top).join(bonds(graph).agg(F.count("*").alias("bonds"))).join(orphans(graph).agg(F.count("*").alias("orphans")))  # one row each
    return counts



def members(graph: DataFrame) -> DataFrame:
    """(by, member, id): every event in the cluster of its author and in that of its kind; rows, not lists, so a cluster may be of any size."""
    both = F.array(F.struct(F.lit("author").alias("by"), F.col("pubkey").alias("member")), F.struct(F.lit("kind").alias("by"), F.col("kind").cast("string").alias("member")))
    return graph.select(F.inline(both), "id").where("member is not null")


def referrers(graph: DataFrame) -> DataFrame:
    """(type, key, id, pos): who refers to which event or author that is there, a row for each reference, repeated tags too."""
    return resolve(graph, "left_semi").select("type", "key", "id", "pos")
