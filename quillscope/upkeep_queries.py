"""Queries for references to missing records (p1) and repeated deliveries (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import norm_key
from .operators.dedup import exactly_once
from .operators.orphans import track
from .registry import Registry
from .session import load

REGISTRY = Registry()

_NORM = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"

_OPEN_REFS = (
    r"""
WITH ev AS (
  SELECT id, min(pubkey) AS pubkey, min(kind) AS kind, min(tags) AS tags, min(received_at) AS seen
  FROM (SELECT NORM(id) AS id, NORM(pubkey) AS pubkey, kind, tags, received_at FROM nostr_event WHERE id IS NOT NULL)
  GROUP BY id),
tag AS (SELECT id, pubkey, kind, seen, unnest(range(len(tags))) AS pos, unnest(tags) AS t FROM ev),
ref AS (
  SELECT id, pubkey, kind, seen, pos, t[1] AS k, NORM(t[2]) AS key
  FROM tag WHERE len(t) >= 2 AND t[1] IN ('e', 'p') AND t[2] IS NOT NULL),
del AS (
  SELECT DISTINCT r.key FROM ref r JOIN ev ON ev.id = r.key AND ev.pubkey = r.pubkey WHERE r.kind = 5 AND r.k = 'e'),
author AS (SELECT DISTINCT pubkey FROM ev),
old AS (
  SELECT orphan_no::VARCHAR AS rec, 0 AS pos, NORM(id) AS key, coalesce(ref_type, '') = 'pubkey' AS person, found_at AS seen
  FROM orphan WHERE id IS NOT NULL
  UNION ALL
  SELECT orphan_no::VARCHAR, 1, NORM(ref_by), false, found_at FROM orphan WHERE ref_by IS NOT NULL),
open_ref AS (
  SELECT 'nostr_event' AS tab, r.id AS rec, r.pos::BIGINT AS pos, r.key AS missing_key, r.seen,
    CASE WHEN r.k = 'p' OR ev.id IS NULL THEN 'missing' WHEN d.key IS NOT NULL THEN 'deleted' ELSE 'late' END AS status
  FROM ref r LEFT JOIN ev ON r.k = 'e' AND ev.id = r.key LEFT JOIN del d ON r.k = 'e' AND d.key = r.key
    LEFT JOIN author a ON r.k = 'p' AND a.pubkey = r.key
  WHERE r.kind <> 5 AND CASE WHEN r.k = 'p' THEN a.pubkey IS NULL
    ELSE ev.id IS NULL OR d.key IS NOT NULL OR ev.seen > r.seen + INTERVAL 24 HOUR END
  UNION ALL
  SELECT 'orphan', o.rec, o.pos::BIGINT, o.key, o.seen, CASE WHEN d.key IS NULL THEN 'missing' ELSE 'deleted' END
  FROM old o LEFT JOIN ev ON NOT o.person AND ev.id = o.key LEFT JOIN del d ON NOT o.person AND d.key = o.key
    LEFT JOIN author a ON o.person AND a.pubkey = o.key
  WHERE CASE WHEN o.person THEN a.pubkey IS NULL ELSE ev.id IS NULL OR d.key IS NOT NULL END)
""".replace("NORM(id)", _NORM.format("id"))
    .replace("NORM(pubkey)", _NORM.format("pubkey"))
    .replace("NORM(t[2])", _NORM.format("t[2]"))
    .replace("NORM(ref_by)", _NORM.format("ref_by"))
)


@REGISTRY.add(_OPEN_REFS + "SELECT tab, rec, pos, missing_key FROM open_ref")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(load(spark, sf_dir, "nostr_event"), load(spark, sf_dir, "orphan")).open()


@REGISTRY.add(
    _OPEN_REFS
    + """SELECT tab, strftime(seen AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, status, count(*) AS n_open
FROM open_ref GROUP BY ALL"""
)
def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open references by table, day of the reference and reason."""
    tracker = track(load(spark, sf_dir, "nostr_event"), load(spark, sf_dir, "orphan"))
    day = F.date_format("at", "yyyy-MM-dd").alias("day")
    return tracker.current().where("status <> 'ok'").groupBy("tab", day, "status").agg(F.count("*").alias("n_open"))


BATCHES = 4


def _snapshot_sql() -> str:
    """What is open among the events and reports of the first spans of arrival time, for each number of spans."""
    span = f"least(greatest((epoch_us({{}}) - lo) // ((hi - lo + {BATCHES}) // {BATCHES}), 0), {BATCHES - 1})"
    ends = "(SELECT min(epoch_us(received_at)) AS lo, max(epoch_us(received_at)) AS hi FROM nostr_event)"
    parts = []
    for k in range(BATCHES):
        text = _OPEN_REFS
        for table, column in (("nostr_event", "received_at"), ("orphan", "found_at")):
            text = text.replace(f"FROM {table} ", f"FROM (SELECT t.* FROM {table} t, {ends} WHERE coalesce({span.format(column)}, {BATCHES - 1}) <= {k}) ")
        counted = text + "SELECT tab, strftime(seen AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, status, count(*) AS n FROM open_ref GROUP BY ALL"
        parts.append(f"SELECT {k}::BIGINT AS step, * FROM ({counted})")
    return "\nUNION ALL\n".join(parts)


@REGISTRY.add(_snapshot_sql())
def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open references as they stood after each batch."""
    tracker = track(load(spark, sf_dir, "nostr_event"), load(spark, sf_dir, "orphan"), BATCHES)
    return tracker.snapshots().withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_RANKED = f"""
SELECT *, row_number() OVER (PARTITION BY {_NORM.format("id")} ORDER BY received_at, delivery_id) AS nth
FROM nostr_event WHERE id IS NOT NULL"""


def _once(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """All messages with those of the last tenth of the hours as new ones and the others as stored."""
    rows = load(spark, sf_dir, "nostr_event").select("delivery_id", "id", "received_at", "batch_no", *columns)
    cut = rows.agg(F.max("batch_no")).first()[0]
    is_new = F.coalesce(F.col("batch_no"), F.lit(0)) > (cut or 0) * 0.9
    return exactly_once(rows.where(is_new), norm_key(F.col("id")), [F.col("received_at"), F.col("delivery_id")], rows.where(~is_new))


@REGISTRY.add(f"SELECT delivery_id FROM ({_RANKED}) WHERE nth > 1")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir)[1].select("delivery_id")


@REGISTRY.add(f"SELECT kind, count(*) AS n_events, sum(length(content))::BIGINT AS n_chars FROM ({_RANKED}) WHERE nth = 1 GROUP BY kind")
def p4_kept_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept copies, counted by kind."""
    kept = _once(spark, sf_dir, "kind", "content")[0]
    return kept.groupBy("kind").agg(F.count("*").alias("n_events"), F.sum(F.length("content")).alias("n_chars"))
