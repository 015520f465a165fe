"""References to records that do not exist, kept up to date batch by batch.

State is append-only tables in one folder shared by the executors, each with a segment a batch:

* ``parents`` (``kind``, ``key``, ``owner``, ``came``): the events seen so far, each once, at its first arrival, and the authors;
* ``gone`` (``key``, ``owner``): events that an author asked to delete;
* ``refs`` (``tab``, ``rec``, ``pos``, ``kind``, ``key``, ``seen``, ``at``, ``late_rule``, ``status``, ``before``, ``step``): each reference
  with what became of it, and again, with the status it had ``before``, whenever that changes. The row of the last step holds.

A batch does three things. New references probe the index of parents. Records that arrive resolve the references that
wait for them. Deletions reopen references that were resolved. For all three the keys of the batch are sent to the state
as a bitmap of fixed size, so the state is read where it lies, in its narrow columns, and only what the
batch touches (and the few rows that the bitmap lets through by chance, which change nothing) is shuffled: the shuffle of a
batch depends on the batch, not on the state. Every :data:`COMPACT` batches the segments are merged into one.

A batch counts once its commit is written; the commit names the segments of all tables. A tracker on a
folder with commits goes on after the last one, a batch whose id is committed already is skipped, and
segments without a commit are overwritten: so a stream may be restarted and a batch delivered again. A step that
fails leaves the tracker as it was. Merged segments are kept until the next merge, for those who still read them, and deleted then.

Status: ``ok``; ``missing`` (no such record, may still arrive); ``late`` (it arrived more than ``grace`` after
the reference); ``deleted``. All but ``ok`` are open.

Defined results for odd input: rows with a null ``id`` name no event and are ignored, as are null tags, tags
with fewer than two strings, and tags whose second string is null; repeated deliveries count once, at their
earliest arrival; a null arrival counts as the latest of its batch's ties and never makes a record late; empty
batches leave the state as it is; other columns are ignored. Batches must come in order of arrival.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_key, pack_key, unpack_key
from ..plans.skew import TASK_ROWS, bitmap, hot_keys, salted_join, with_maybe
from ..session import Scratch, list_folder, read_text, remove, write_text

EVENT, AUTHOR = "e", "p"
COMPACT = 16
TABLES = {
    "parents": "kind string, key binary, owner binary, came timestamp",
    "gone": "key binary, owner binary",
    "refs": "tab string, rec binary, pos bigint, kind string, key binary, seen timestamp, at timestamp, late_rule boolean, status string, before string, step bigint",
}
COLUMNS = ["tab", "rec", "pos", "kind", "key", "seen", "at", "late_rule"]
REF_ID = ["tab", "rec", "pos"]


def _first(t: str, i: int) -> Column:
    return F.get(t, F.lit(i))


def event_refs(events: DataFrame, tab: str = "nostr_event") -> DataFrame:
    """One row for each e or p tag of each event but deletions, in :data:`COLUMNS`."""
    tags = events.where("ekind <> 5").select("key", "seen", F.posexplode("tags").alias("pos", "t"))
    usable = (F.size("t") >= 2) & _first("t", 0).isin(EVENT, AUTHOR) & _first("t", 1).isNotNull()
    return tags.where(usable).select(
        F.lit(tab).alias("tab"),
        F.col("key").alias("rec"),
        F.col("pos").cast("bigint").alias("pos"),
        _first("t", 0).alias("kind"),
        pack_key(norm_key(_first("t", 1))).alias("key"),
        "seen",
        F.col("seen").alias("at"),
        F.lit(True).alias("late_rule"),
    )


def report_refs(reports: DataFrame, tab: str = "orphan") -> DataFrame:
    """The references of an older report: place 0 is ``id``, place 1 is ``ref_by``; null ones are none."""
    kind = F.when(F.col("ref_type") == "pubkey", AUTHOR).otherwise(EVENT)
    places = [(0, kind, "id"), (1, F.lit(EVENT), "ref_by")]
    each = F.array(*[F.struct(F.lit(i).cast("bigint").alias("pos"), k.alias("kind"), F.col(c).alias("k")) for i, k, c in places])
    both = reports.select(F.col("orphan_no").cast("string").alias("rec"), F.col("found_at").cast("timestamp").alias("at"), F.explode(each).alias("r"))
    return both.where("r.k is not null and rec is not null").select(
        F.lit(tab).alias("tab"),
        pack_key(F.col("rec")).alias("rec"),
        "r.pos",
        "r.kind",
        pack_key(norm_key(F.col("r.k"))).alias("key"),
        F.lit(None).cast("timestamp").alias("seen"),
        "at",
        F.lit(False).alias("late_rule"),
    )


def _deletions(events: DataFrame) -> DataFrame:
    """(key, owner) of each event that an author asked to delete."""
    tags = events.where("ekind = 5 and owner is not null").select("owner", F.explode("tags").alias("t"))
    usable = (F.size("t") >= 2) & (_first("t", 0) == EVENT) & _first("t", 1).isNotNull()
    return tags.where(usable).select(pack_key(norm_key(_first("t", 1))).alias("key"), "owner").distinct()


class OrphanTracker:
    """Keyed state of open references; call :meth:`step` for each batch, or use it in ``foreachBatch``.

    With a ``root`` (a folder that all executors reach) the state stays there and a later tracker goes on with it;
    without one it lies in the session's scratch folder and goes with the session.
    """

    def __init__(self, spark: SparkSession, grace_hours: float = 24.0, root: str | None = None, compact_every: int = COMPACT, task_rows: int = TASK_ROWS):
        self.spark, self.grace, self.compact_every, self.task_rows = spark, grace_hours, compact_every, task_rows
        self.root = root.rstrip("/") if root else Scratch(spark, "orphans").root
        self.segments: dict[str, list[str]] = {name: [] for name in TABLES}
        self.retired: list[str] = []  # merged segments that may still be read
        self.steps, self.last_batch = 0, None
        commits = sorted(int(n) for n in list_folder(spark, f"{self.root}/commits") if n.isdigit())
        if commits:
            state = json.loads(read_text(spark, f"{self.root}/commits/{commits[-1]}"))
            self.segments, self.retired, self.steps, self.last_batch = state["segments"], state["retired"], state["steps"], commits[-1]

    def _table(self, name: str) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in self.segments[name]]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _add(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        """Write a segment; it is part of the state from now on, and for good from the commit on."""
        path = f"{name}/{batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{path}")
        self.segments[name].append(path)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{path}")

    @property
    def refs(self) -> DataFrame:
        return self._table("refs")

    def step(self, batch: DataFrame, reports: DataFrame | None = None, batch_id: int | None = None) -> None:
        """Take in one batch of events, and of older reports. A batch that is committed already is skipped."""
        k = self.steps if batch_id is None else batch_id
        if self.last_batch is not None and k <= self.last_batch:
            return
        before = {name: list(paths) for name, paths in self.segments.items()}, list(self.retired), self.steps
        try:
            old = self._take(k, batch, reports)
        except BaseException:
            self.segments, self.retired, self.steps = before
            raise
        self.last_batch = k
        for path in old:
            remove(self.spark, f"{self.root}/{path}")

    def _take(self, k: int, batch: DataFrame, reports: DataFrame | None) -> list[str]:
        """Work a batch into the state and commit it; gives the segments that nothing needs any more."""
        arrived = F.col("received_at").cast("timestamp")
        rows = batch.where(F.col("id").isNotNull()).select(
            pack_key(norm_key(F.col("id"))).alias("key"),
            F.struct(
                arrived.isNull().alias("none"),
                arrived.alias("seen"),
                pack_key(norm_key(F.col("pubkey"))).alias("owner"),
                F.coalesce(F.col("kind"), F.lit(-1)).cast("int").alias("ekind"),
                F.coalesce(F.col("tags"), F.array().cast("array<array<string>>")).alias("tags"),
            ).alias("e"),
        )
        fresh = rows.groupBy("key").agg(F.min("e").alias("e")).select("key", "e.owner", "e.ekind", "e.tags", "e.seen")
        scratch = Scratch(self.spark, "batch")
        fresh = scratch.write(fresh, "fresh")
        names = fresh.select(F.lit(EVENT).alias("kind"), "key").union(fresh.where("owner is not null").select(F.lit(AUTHOR), F.col("owner")))
        if self.segments["parents"]:
            # Records that came in an earlier batch: the bitmap finds them in place, the join settles them.
            known = self._touched("parents", bitmap(names, "kind", "key")).select("kind", "key")
            fresh = scratch.write(fresh.join(known.where(F.col("kind") == EVENT).select("key"), "key", "left_anti"), "new")
            people = fresh.where("owner is not null").select(F.col("owner").alias("key")).distinct()
            people = people.join(known.where(F.col("kind") == AUTHOR).select("key"), "key", "left_anti")
        else:
            people = fresh.where("owner is not null").select(F.col("owner").alias("key")).distinct()
        none = F.lit(None)
        parents = fresh.select(F.lit(EVENT).alias("kind"), "key", "owner", F.col("seen").alias("came")).union(
            people.select(F.lit(AUTHOR), "key", none.cast("binary"), none.cast("timestamp"))
        )
        past = self.refs if self.segments["refs"] else None
        parents = self._add("parents", parents, k)
        gone = self._add("gone", _deletions(fresh), k)

        todo = event_refs(fresh)
        if reports is not None:
            todo = todo.unionByName(report_refs(reports))
        todo = todo.withColumn("before", none.cast("string"))
        if past is not None:
            news = bitmap(parents.select("kind", "key").union(gone.select(F.lit(EVENT), "key")), "kind", "key")
            touched = with_maybe(past, news, ["kind", "key"]).where("__maybe").select(*COLUMNS, "status", "step")
            woken = touched.groupBy(*REF_ID).agg(F.max_by(F.struct(*[c for c in COLUMNS if c not in REF_ID], "status"), "step").alias("r"))
            todo = todo.unionByName(woken.select(*REF_ID, "r.kind", "r.key", "r.seen", "r.at", "r.late_rule", F.col("r.status").alias("before")))
        todo = scratch.write(todo, "todo")
        self._add("refs", self._judge(todo), k)
        self.steps += 1
        old = self._compact(k) if self.steps % self.compact_every == 0 else []
        write_text(self.spark, f"{self.root}/commits/{k}", json.dumps({"steps": self.steps, "segments": self.segments, "retired": self.retired}))
        scratch.drop()
        return old

    def _touched(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a table whose kind and key may be in a bitmap; those of no other key are left where they lie."""
        rows = self._table(name)
        if name == "gone":
            rows = rows.withColumn("kind", F.lit(EVENT))
        return with_maybe(rows, keys, ["kind", "key"]).where("__maybe").drop("__maybe")

    def _judge(self, todo: DataFrame) -> DataFrame:
        """The references (new ones and woken ones, hot keys in parts) whose status is new, against all that is known now."""
        keys = bitmap(todo, "kind", "key")
        gone = self._touched("gone", keys).select("key", "owner").distinct().select(F.lit(EVENT).alias("kind"), "key", "owner", F.lit(True).alias("gone"))
        state = self._touched("parents", keys).join(gone, ["kind", "key", "owner"], "left").select("kind", "key", "came", "gone", F.lit(True).alias("there"))
        joined = salted_join(todo, state, ["kind", "key"], "left", hot_keys(todo, ["kind", "key"], self.task_rows), F.struct("rec", "pos"))
        late = F.col("late_rule") & (F.unix_micros("came") - F.unix_micros("seen") > int(self.grace * 3_600_000_000))
        status = F.when(F.col("there").isNull(), "missing").when(F.col("gone"), "deleted").when(late, "late").otherwise("ok")
        judged = joined.select(*COLUMNS, status.alias("status"), "before", F.lit(self.steps).cast("bigint").alias("step"))
        return judged.where("before is null or status <> before")

    def _compact(self, batch: int) -> list[str]:
        """Merge the segments of each table into one, with the same rows; gives the segments that the merge before had replaced."""
        old, self.retired = self.retired, [path for paths in self.segments.values() for path in paths]
        for name in TABLES:
            merged = self._table(name)
            path = f"{name}/upto-{batch}"
            pieces = max(1, merged.rdd.getNumPartitions() // 2)
            merged.coalesce(pieces).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{path}")
            self.segments[name] = [path]
        return old

    def current(self) -> DataFrame:
        """Each reference with its status after the last step.

        References that never changed pass where they lie; only those with several rows are grouped.
        """
        if self.steps < 2:
            return self.refs
        changed = self.refs.where("before is not null").select(*REF_ID)
        split = with_maybe(self.refs, bitmap(changed, *REF_ID), REF_ID)
        fields = ["kind", "key", "at", "status", "step"]
        several = split.where("__maybe").groupBy(*REF_ID).agg(F.max_by(F.struct(*fields), "step").alias("r")).select(*REF_ID, "r.*")
        return split.where("not __maybe").select(*REF_ID, *fields).unionByName(several)

    def open(self) -> DataFrame:
        """(tab, rec, pos, missing_key) of each open reference."""
        return self.current().where("status <> 'ok'").select("tab", unpack_key(F.col("rec")).alias("rec"), "pos", unpack_key(F.col("key")).alias("missing_key"))

    def changes(self) -> DataFrame:
        """(step, tab, day, status, n): by how much the open references of each table, day and status became more or fewer in each step."""
        day = F.to_date("at").alias("day")
        more = self.refs.where("status <> 'ok'").select("step", "tab", day, "status", F.lit(1).alias("d"))
        fewer = self.refs.where("before <> 'ok'").select("step", "tab", day, F.col("before").alias("status"), F.lit(-1).alias("d"))
        return more.unionByName(fewer).groupBy("step", "tab", "day", "status").agg(F.sum("d").alias("n")).where("n <> 0")

    def snapshots(self, every: int = 1) -> DataFrame:
        """Open references by table, day of the reference and status, as they stood after each ``every``-th step: running sums of :meth:`changes`."""
        steps = F.collect_list(F.struct("step", "n")).alias("c")  # at most one entry a step
        cells = self.changes().groupBy("tab", "day", "status").agg(F.sort_array(steps).alias("c"))
        each = cells.withColumn("step", F.explode(F.sequence(F.lit(every - 1), F.lit(max(self.steps - 1, every - 1)), F.lit(every)).cast("array<bigint>")))
        n = F.aggregate(F.filter("c", lambda x: x["step"] <= F.col("step")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        return each.select("step", "tab", "day", "status", n.alias("n")).where("n > 0")


def part_of(at: Column, lo: int, hi: int, batches: int) -> Column:
    """Which of ``batches`` equal spans of time from ``lo`` to ``hi`` (microseconds) a time lies in; null times are in the last."""
    width = max(1, -(-(hi - lo + 1) // batches))
    when = F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(hi))
    return F.least(F.greatest(F.floor((when - lo) / width), F.lit(0)), F.lit(batches - 1))


def track(events: DataFrame, reports: DataFrame | None = None, batches: int = 4, grace_hours: float = 24.0, **options) -> OrphanTracker:
    """Replay stored events through an :class:`OrphanTracker` in ``batches`` equal spans of arrival time."""
    tracker = OrphanTracker(events.sparkSession, grace_hours, **options)
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    lo, hi = lo or 0, hi or 0
    for k in range(batches):
        tracker.step(
            events.where(part_of(F.col("received_at"), lo, hi, batches) == k),
            None if reports is None else reports.where(part_of(F.col("found_at"), lo, hi, batches) == k),
        )
    return tracker
