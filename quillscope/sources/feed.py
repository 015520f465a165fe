"""Feeds of events: bounded replay by time, and files of JSON lines as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import SCHEMA, long_enough, matches, valid_id, valid_sig
from ..functions.keys import norm_key
from ..session import ship

DAY = 86_400


def replay(events: DataFrame, since: int = 0, until: int | None = None, chunk: int = DAY, kind: int = 1, least: int = 50) -> DataFrame:
    """Events of a kind in a span of time with ``chunk_no``, the number of their piece of it; each id once (the first to arrive)."""
    span = events.where((F.col("kind") == kind) & (F.col("created_at") >= since) & long_enough(least))
    if until is not None:
        span = span.where(F.col("created_at") <= until)
    names = span.columns
    once = span.groupBy(norm_key(F.col("id")).alias("__id")).agg(F.min_by(F.struct(*names), F.struct("received_at", "delivery_id")).alias("e"))
    return once.select("e.*").withColumn("chunk_no", F.expr(f"(created_at - {since}) div {chunk}"))


def json_stream(spark: SparkSession, folder: str, per_trigger: int = 100, valid_only: bool = True, signed_only: bool = False) -> DataFrame:
    """A stream of events from JSON lines in files of a folder; by default only those whose id fits their content.

    ``signed_only`` also checks their signatures (in Arrow batches, a few hundred a second and core).
    """
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)
    return verified(rows, signed_only) if valid_only or signed_only else rows


def verified(events: DataFrame, signed_only: bool = True) -> DataFrame:
    """The events whose id fits their content and, by default, whose signature by their author over that id holds."""
    fits = events.where(valid_id())
    if not signed_only:
        return fits
    ship(events.sparkSession)
    return fits.where(valid_sig(norm_key(F.col("pubkey")), norm_key(F.col("id")), norm_key(F.col("sig"))))


def subscribe(events: DataFrame, limit: int | None = None, **fields) -> DataFrame:
    """The events that a subscription asks for (fields as in :func:`..functions.events.matches`); with a ``limit`` the newest so many, ties by id."""
    found = events.where(matches(**fields))
    return found if limit is None else found.orderBy(F.desc("created_at"), norm_key(F.col("id"))).limit(limit)
