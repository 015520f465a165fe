from datetime import datetime, timedelta

import pytest

from quillscope.operators.orphans import OrphanTracker, track

T0 = datetime(2025, 1, 1)
EVENTS = "id string, pubkey string, kind int, tags array<array<string>>, received_at timestamp, rec string, key string, n bigint"
REPORTS = "orphan_no bigint, ref_type string, id string, ref_by string, found_at timestamp"


def ev(i, who, hours, *tags, kind=1):
    return (i, who, kind, [list(t) for t in tags], None if hours is None else T0 + timedelta(hours=hours), "clash", "clash", 1)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


def found(tracker):
    return sorted(tuple(r) for r in tracker.open().collect())


def test_new_arriving_and_deleted(spark):
    t = OrphanTracker(spark)
    t.step(events(spark, ev("A ", "u", 0, ("e", " B"), ("e", "C"), ("p", "U"), ("p", "nobody"), ("e",), ("x", "B"), ("e", None)), ev("d", "v", 1, ("e", "b"))))
    assert found(t) == [("nostr_event", "a", 0, "b"), ("nostr_event", "a", 1, "c"), ("nostr_event", "a", 3, "nobody"), ("nostr_event", "d", 0, "b")]
    # b comes in time for both, c too late; nobody writes.
    t.step(events(spark, ev("b", "w", 2), ev("c", "w", 30), ev("z", "Nobody", 31)))
    assert found(t) == [("nostr_event", "a", 1, "c")]
    # A stranger's deletion does nothing, the author's reopens; a redelivery changes nothing.
    t.step(events(spark, ev("k", "x", 40, ("e", "b"), kind=5), ev("A", "u", 41, ("e", "B"))))
    assert found(t) == [("nostr_event", "a", 1, "c")]
    t.step(events(spark, ev("l", "W", 50, ("e", "B "), kind=5)))
    assert found(t) == [("nostr_event", "a", 0, "b"), ("nostr_event", "a", 1, "c"), ("nostr_event", "d", 0, "b")]
    steps = {(r["step"], r["status"]): r["n"] for r in t.snapshots().groupBy("step", "status").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert steps == {(0, "missing"): 4, (1, "late"): 1, (2, "late"): 1, (3, "late"): 1, (3, "deleted"): 2}


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_any_split_gives_the_same(spark, batches):
    rows = [ev(f"e{i}", f"u{i % 7}", i, ("e", f"e{(i * 7) % 60}"), ("p", f"u{i % 11}"), ("e", f"e{(i * 7) % 60}")) for i in range(50)]
    rows += [ev(f"k{i}", f"u{i % 7}", 60 + i, ("e", f"e{i}"), kind=5) for i in range(0, 50, 9)] + rows[:9] + [ev(None, "u1", 3, ("e", "q")), ev("n", None, None, ("e", "e1"))]
    reports = spark.createDataFrame([(1, "event", "E1", "e2", T0), (2, "pubkey", "u3", None, T0), (3, "pubkey", "zz", "k1", None), (4, None, "gone", "", T0), (5, "event", None, None, T0)], REPORTS)
    got = found(track(events(spark, *rows), reports, batches))
    assert got == found(track(events(spark, *rows), reports, 2)) and ("orphan", "3", 0, "zz") in got and ("orphan", "2", 0, "u3") not in got and ("orphan", "4", 1, "") in got


def test_hot_author(spark):
    rows = [ev(f"e{i}", "u", 1, ("p", "hot"), ("p", "cold")) for i in range(12_000)] + [ev("x", "hot", 2)]
    open_refs = track(events(spark, *rows), None, 1).open()
    assert open_refs.count() == 12_000 and open_refs.where("missing_key = 'hot'").count() == 0


def test_empty(spark):
    assert found(track(events(spark).limit(0), spark.createDataFrame([], REPORTS), 2)) == []


def test_restart_goes_on_and_skips_what_was_committed(spark, tmp_path):
    root = (tmp_path / "state").as_uri()
    first = events(spark, ev("a", "u", 0, ("e", "b"), ("e", "c")))
    OrphanTracker(spark, root=root).step(first, batch_id=7)
    again = OrphanTracker(spark, root=root)
    assert (again.steps, again.last_batch) == (1, 7)
    again.step(first, batch_id=7)
    assert again.steps == 1 and len(found(again)) == 2
    # A batch that broke off before its commit leaves segments that the next try overwrites.
    broken = OrphanTracker(spark, root=root)
    broken._add("parents", events(spark, ev("zz", "u", 0)).selectExpr("'e' kind", "cast('junk' as binary) key", "cast(null as binary) owner", "received_at came"), 8)
    again = OrphanTracker(spark, root=root)
    again.step(events(spark, ev("b", "u", 1)), batch_id=8)
    assert found(again) == [("nostr_event", "a", 1, "c")] and again._table("parents").where("key = cast('junk' as binary)").count() == 0
    assert found(OrphanTracker(spark, root=root)) == found(again)


def test_compaction_and_many_steps(spark):
    t, plain = OrphanTracker(spark, compact_every=2), OrphanTracker(spark)
    for k in range(5):
        rows = events(spark, ev(f"n{k}", "u", k, ("e", f"n{k + 1}"), ("e", f"n{k - 1}"), ("p", f"p{k}")), ev(f"p{k - 2}", f"p{k - 2}", k))
        t.step(rows)
        plain.step(rows)
    assert found(t) == found(plain) and [len(x) for x in t.segments.values()] == [2, 2, 2] and sorted(map(str, t.snapshots().collect())) == sorted(map(str, plain.snapshots().collect()))
    assert {r["step"] for r in t.snapshots(2).collect()} == {1, 3}
    # Two merges: what the first replaced is gone, what the second replaced may still be read.
    from quillscope.session import list_folder

    assert sorted(list_folder(spark, f"{t.root}/refs")) == ["2", "3", "4", "upto-1", "upto-3"]


def test_a_failed_step_changes_nothing(spark, monkeypatch):
    t = OrphanTracker(spark)
    t.step(events(spark, ev("a", "u", 0, ("e", "b"))))
    monkeypatch.setattr(t, "_judge", lambda todo: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.step(events(spark, ev("b", "u", 1)))
    monkeypatch.undo()
    assert len(found(t)) == 1 and t.steps == 1
    t.step(events(spark, ev("b", "u", 1)))
    assert found(t) == []


def test_hot_woken_references_are_spread(spark):
    t = OrphanTracker(spark, task_rows=200)
    t.step(events(spark, *[ev(f"e{i}", "u", 1, ("e", "late")) for i in range(3_000)]))
    assert t.open().count() == 3_000
    t.step(events(spark, ev("late", "w", 2)))
    assert t.open().count() == 0
    t.step(events(spark, ev("del", "w", 3, ("e", "late"), kind=5)))
    assert t.open().count() == 3_000 and {r["n"] for r in t.snapshots().collect()} == {3_000}


def test_a_step_shuffles_what_its_batch_touches(spark):
    def moved(t, rows):
        spark.sparkContext._jvm.System.gc()
        before = shuffled(spark)
        t.step(rows)
        return shuffled(spark) - before

    t = OrphanTracker(spark)
    t.step(events(spark, *[ev(f"a{i}", f"u{i}", i % 50, ("e", f"b{i}"), ("p", f"u{i + 1}")) for i in range(4_000)]))
    sizes = [moved(t, events(spark, *[ev(f"s{k}-{i}", f"u{i}", 60 + k, ("e", f"a{i}")) for i in range(50)])) for k in range(4)]
    assert max(sizes) < 1_000  # the state holds 8,000 references and as many parents


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
