"""Live pipelines in Structured Streaming: validation, deduplication, verdicts, limits and windows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.events import long_enough, normal_url
from ..functions.keys import norm_key
from ..operators.detect import Model, detect, triggered
from ..operators.orphans import OrphanTracker


def keep_running(start: Callable[[], StreamingQuery], first: float = 1.0, most: float = 60.0, tries: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Start a query again whenever it fails, after a pause of ``first`` seconds that doubles up to ``most``; gives the number of failures once it ends well.

    A query that made progress before it failed starts over with the first pause. State and place come from its checkpoint. After
    ``tries`` failures in a row the last one is raised.
    """
    failures = row = 0
    while True:
        query = None
        try:
            query = start()
            query.awaitTermination()
            return failures
        except Exception:
            row = 1 if query is not None and query.lastProgress else row + 1
            failures += 1
            if tries is not None and row >= tries:
                raise
            sleep(min(most, first * 2 ** (row - 1)))


def with_time(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Adds ``at`` from created_at and a watermark."""
    return stream.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)


def once(stream: DataFrame) -> DataFrame:
    """Each id once within the watermark."""
    return stream.withColumn("id", norm_key(F.col("id"))).dropDuplicatesWithinWatermark(["id"])


def watch(stream: DataFrame, model: Model, troll: Model | None = None, least: int = 50, own_sign: str | None = None, threshold: float = 0.5, troll_threshold: float = 0.05, window: int = 500) -> DataFrame:
    """Notes worth a reply: long enough, without our own sign, and with a verdict over the thresholds."""
    notes = stream.where((F.col("kind") == 1) & long_enough(least, own_sign))
    judged = detect(notes, "content", model, window, troll or model)
    return judged.where(triggered(F.col("verdict"), threshold, troll_threshold))


def relay_urls(stream: DataFrame) -> DataFrame:
    """Addresses of relays that can be written to, each once, from relay lists (kind 10002)."""
    tags = stream.where("kind = 10002").select(F.explode("tags").alias("t"))
    usable = (F.get("t", F.lit(0)) == "r") & (F.get("t", F.lit(2)).isNull() | (F.get("t", F.lit(2)) != "read"))
    return tags.where(usable).select(normal_url(F.get("t", F.lit(1))).alias("url")).where("url is not null").dropDuplicates(["url"])


def relay_pool(lists: DataFrame, most: int = 1000) -> DataFrame:
    """(url, first_seen) of the first ``most`` addresses by arrival, from a table with ``tags`` and ``received_at``."""
    tags = lists.where("kind = 10002").select("received_at", F.explode("tags").alias("t"))
    usable = (F.get("t", F.lit(0)) == "r") & (F.get("t", F.lit(2)).isNull() | (F.get("t", F.lit(2)) != "read"))
    urls = tags.where(usable).select(normal_url(F.get("t", F.lit(1))).alias("url"), "received_at").where("url is not null")
    return urls.groupBy("url").agg(F.min("received_at").alias("first_seen")).orderBy("first_seen", "url").limit(most)


def ai_share(judged: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, total, detected): verdicts by window of time, tumbling or sliding; needs ``at`` and ``verdict``."""
    span = F.window("at", width, slide) if slide else F.window("at", width)
    return judged.groupBy(span.alias("w")).agg(F.count("*").alias("total"), F.count_if(~F.col("verdict.human")).alias("detected")).select(F.col("w.start").alias("start"), "total", "detected")


def ai_sessions(judged: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(pubkey, start, end, total, detected) by session of an author."""
    grouped = judged.groupBy("pubkey", F.session_window("at", gap).alias("s"))
    return grouped.agg(F.count("*").alias("total"), F.count_if(~F.col("verdict.human")).alias("detected")).select("pubkey", "s.start", "s.end", "total", "detected")


def take(times: list[float], per_minute: int, tokens: float = 1.0, last: float | None = None) -> tuple[list[bool], float, float | None]:
    """A bucket of ``per_minute`` tokens that starts with one and gains one each 60 / per_minute seconds of event time."""
    passed = []
    for t in times:
        if last is not None and t > last:
            tokens = min(float(per_minute), tokens + (t - last) * per_minute / 60)
        last = t if last is None else max(t, last)
        passed.append(tokens >= 1 - 1e-9)
        if passed[-1]:
            tokens -= 1
    return passed, tokens, last


def limit_rate(stream: DataFrame, by: str, per_minute: int = 6) -> DataFrame:
    """The rows of each ``by`` that its token bucket lets through, in event time: stateful, on ``at`` of the input."""
    names = stream.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        tokens, last = state.get if state.exists else (1.0, None)
        keep, tokens, last = take([t.timestamp() for t in rows["at"]], per_minute, tokens, last if last is None or last >= 0 else None)
        state.update((tokens, -1.0 if last is None else last))
        yield rows[names][keep]

    return stream.groupBy(by).applyInPandasWithState(run, stream.schema, "tokens double, last double", "append", "NoTimeout")


def track_orphans(tracker: OrphanTracker) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the state of open references; give the tracker a ``root`` for a stream that may restart."""
    def run(batch: DataFrame, batch_id: int) -> None:
        tracker.step(batch, batch_id=batch_id)

    return run
