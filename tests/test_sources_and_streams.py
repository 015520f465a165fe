import json

import pytest
from pyspark.sql import functions as F

from quillscope.functions import events as ev
from quillscope.operators.detect import Model
from quillscope.operators.orphans import OrphanTracker
from quillscope.sources import feed, files
from quillscope.streaming import live

MODEL = Model(tuple(tuple([10] * 8) for _ in range(8)))


@pytest.fixture
def folder(tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("a/b.txt", b"x" * 300)
    put("a.txt", b"y" * 300)
    put("a/.hidden.txt", b"z" * 300)
    put("c/small.txt", b"s")
    put("c/page.html", b"<p>One &amp; two</p><script>var x = 1</script><!-- no --><b>three</b>" + b" " * 300)
    put("c/data.bin", b"ab\x00" + b"q" * 300)
    return str(tmp_path)


def test_walks(spark, folder):
    train = files.train_corpus(spark, folder)
    assert [r["rel"] for r in train.select("rel").orderBy(files.walk_order()).collect()] == ["a/b.txt", "a.txt", "c/data.bin", "c/page.html"]
    assert [r["rel"] for r in files.text_corpus(spark, folder, 2).select("rel").collect()] == ["a/.hidden.txt", "a/b.txt"]
    assert {(r["model"], r["rel"]) for r in files.tiers(spark, folder).collect()} == {("a", "a/b.txt"), ("a", "a/.hidden.txt")}
    assert {r["rel"] for r in files.binary_files(spark, folder).where(~files.is_text(F.col("content"))).collect()} == {"c/data.bin"}


def test_extract(spark, folder):
    got = {r["rel"]: r["text"] for r in files.extract(files.binary_files(spark, folder)).collect()}
    assert got["c/page.html"] == "One & two\nthree" and got["a.txt"] == "y" * 300 and "c/data.bin" not in got
    kinds = {"": "plain", "md": "plain", "pdf": "pdf", "docx": "pandoc", "exe": None}
    assert {k: v for k, v in spark.createDataFrame([(k,) for k in kinds], "e string").select("e", files.extractor(F.col("e"))).collect()} == kinds


def test_samples_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('id,model,attack,domain,generation\n1,m,none,d,"' + "long\n" * 30 + '"\n2,human,none,d,' + "x" * 200 + "\n3,m,none,d,short\n")
    assert files.samples_csv(spark, str(p)).count() == 1
    q = tmp_path / "t.csv"
    q.write_text("id,model\n1,m\n")
    with pytest.raises(ValueError, match="attack"):
        files.samples_csv(spark, str(q))


def event(i, at, kind=1, content="x" * 60, tags=(), who="u"):
    return {"id": f"e{i}", "pubkey": who, "created_at": at, "kind": kind, "tags": [list(t) for t in tags], "content": content, "sig": ""}


@pytest.fixture
def lines(tmp_path):
    d = tmp_path / "feed"
    d.mkdir()
    rows = [event(1, 100), event(1, 100), event(2, 130, content="short"), event(3, 86500, kind=10002, tags=[("r", "wss://a/"), ("r", "wss://b", "read"), ("r", "wss://a")]), event(4, 90000, who="v")]
    (d / "0.json").write_text("\n".join(map(json.dumps, rows)))
    return str(d)


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_watch_once_and_relays(spark, lines):
    stream = live.once(live.with_time(feed.json_stream(spark, lines, valid_only=False)))
    got = run(live.watch(stream, MODEL), spark, "watched").collect()
    assert sorted(r["id"] for r in got) == ["e1", "e4"] and all(not r["verdict"]["human"] for r in got)
    urls = run(live.relay_urls(feed.json_stream(spark, lines, valid_only=False)), spark, "urls", "update")
    assert [r["url"] for r in urls.collect()] == ["wss://a"]
    assert run(feed.json_stream(spark, lines), spark, "valid").count() == 0


def test_share_by_window(spark, lines):
    rows = spark.read.schema(ev.SCHEMA).json(lines).withColumn("at", F.timestamp_seconds("created_at")).withColumn("verdict", F.struct((F.col("id") == "e1").alias("human")))
    days = sorted((r["total"], r["detected"]) for r in live.ai_share(rows).collect())
    assert days == [(2, 2), (3, 1)] and live.ai_share(rows, "2 days", "1 day").count() == 3
    assert live.ai_sessions(rows).count() == 3


def test_rate_limit(spark, lines):
    assert live.take([0, 1, 2, 30, 31, 600, 600, 600, 600, 600, 600, 600], 6)[0] == [True, False, False, True, True, True, True, True, True, True, True, False]
    stream = live.with_time(feed.json_stream(spark, lines, valid_only=False))
    assert run(live.limit_rate(stream, "pubkey"), spark, "limited").count() == 4


def test_orphans_in_a_stream(spark, lines, tmp_path):
    tracker = OrphanTracker(spark)
    stream = feed.json_stream(spark, lines, valid_only=False).withColumn("received_at", F.timestamp_seconds("created_at"))
    q = stream.writeStream.foreachBatch(live.track_orphans(tracker)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tracker.steps == 1 and tracker.open().count() == 0


def test_replay(spark):
    rows = spark.createDataFrame([(1, "A", 1, 10, "x" * 50, None), (2, "a ", 1, 10, "x" * 50, None), (3, "b", 1, 86400, "y" * 50, None), (4, "c", 7, 5, "x" * 99, None), (5, "d", 1, 7, None, None)], "delivery_id bigint, id string, kind int, created_at bigint, content string, received_at timestamp")
    assert sorted((r["delivery_id"], r["chunk_no"]) for r in feed.replay(rows).collect()) == [(1, 0), (3, 1)]


def test_crawl_rows(spark, tmp_path):
    from quillscope.operators.detect import detect

    rows = spark.createDataFrame([("a", "p", 1, "")], "id string, pubkey string, created_at bigint, content string")
    judged = detect(rows, "content", MODEL, troll=MODEL)
    for _ in range(2):
        files.write_crawl_csv(judged, str(tmp_path / "log"))
    back = spark.read.csv(str(tmp_path / "log"), header=True)
    assert back.columns == files.CRAWL_COLUMNS and back.count() == 2 and back.first()["confidence"] == "1.0000"


def test_a_query_is_started_again():
    from quillscope.streaming.live import keep_running

    class Query:
        def __init__(self, fails, progress=None):
            self.fails, self.lastProgress = fails, progress

        def awaitTermination(self):
            if self.fails:
                raise OSError("gone")

    runs, pauses = iter([Query(True)] * 4 + [Query(True, {"batchId": 3}), Query(True), Query(False)]), []
    assert keep_running(lambda: next(runs), most=5, sleep=pauses.append) == 6 and pauses == [1, 2, 4, 5, 1, 2]
    with pytest.raises(OSError):
        keep_running(lambda: Query(True), tries=2, sleep=lambda _: None)


def test_hidden_names_are_walked_as_they_should_be(spark, tmp_path):
    for name in ("_a.txt", ".b.txt", "c.txt", "_sub/d.txt", "_sub/deep/_e.txt", ".dot/f.txt", "x/y/.g.txt", "x/_h/i.txt", "x/_h/j.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 40)
    every = {r["rel"]: bytes(r["content"]) for r in files.text_corpus(spark, str(tmp_path)).collect()}
    assert every == {n: n.encode() * 40 for n in ("_a.txt", ".b.txt", "c.txt", "_sub/d.txt", "_sub/deep/_e.txt", ".dot/f.txt", "x/y/.g.txt", "x/_h/i.txt")}
    assert {r["rel"] for r in files.train_corpus(spark, str(tmp_path)).collect()} == {"_a.txt", "c.txt", "_sub/d.txt", "_sub/deep/_e.txt", "x/_h/i.txt", "x/_h/j.bin"}
    assert {r["rel"] for r in files.binary_files(spark, str(tmp_path), hidden=False).collect()} == {"c.txt"}
