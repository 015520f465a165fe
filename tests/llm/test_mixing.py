import numpy as np
import pytest

from quillscope.llm import mixing as mx
from quillscope.llm.tokenizer import VOCABULARIES, codec
from pathlib import Path

DOCS = "doc_id bigint, source string, text string, block_no string, weight_pm string"
TARGETS = "source string, weight_pm int, max_repeat int"


def test_permutations():
    for n in (1, 2, 3, 17, 1000, 4097):
        size, key = np.full(n, n), np.full(n, 99)
        assert sorted(mx.permute(np.arange(n), size, key)) == list(range(n))
    assert list(mx.permute(np.arange(50), np.full(50, 50), np.full(50, 1))) != list(mx.permute(np.arange(50), np.full(50, 50), np.full(50, 2)))


def test_fill_gives_what_is_left_to_others():
    got = mx.fill(np.array([500.0, 500.0, 0.0]), np.array([10.0, 1000.0, 1000.0]), 100)
    assert got.tolist() == [10, 90, 0] and mx.fill(np.array([1.0]), np.array([5.0]), 100).tolist() == [5]


def run(spark, docs, targets, **options):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS)
    blocks, report = mx.mix(d, spark.createDataFrame(targets, TARGETS), **options)
    return blocks.collect(), {r["source"]: r for r in report.collect()}


def test_shares_caps_and_tokens(spark):
    own = codec(Path(VOCABULARIES, "byte_bpe_50k.tiktoken").read_bytes())
    docs = [(i, "big", f"words of document number {i} and more of them " * 30) for i in range(200)] + [(1000 + i, "tiny", f"a small text {i}") for i in range(40)]
    docs += [(5, None, "no source"), (6, "big", None), (7, "big", ""), (8, "other", "not wanted"), (0, "big", docs[0][2])]
    blocks, report = run(spark, docs, [("big", 500, 2), ("tiny", 500, 3), ("none", 100, 2), (None, 5, 5)], block_tokens=64, shard_slots=50)
    texts = {s: [own.encode(t) for _, x, t in docs if x == s and t] for s in ("big", "tiny")}
    assert report["big"]["tokens"] == sum(map(len, texts["big"])) and report["tiny"]["tokens"] == sum(map(len, texts["tiny"])) and report["none"]["tokens"] == 0
    assert report["tiny"]["uses_of_a_block"] == 3 and not report["tiny"]["met"] and report["tiny"]["short_pm"] > 0 and report["tiny"]["used_tokens"] == 3 * report["tiny"]["tokens"]
    assert report["big"]["uses_of_a_block"] <= 2
    assert len({(r["shard"], r["slot"]) for r in blocks}) == len(blocks) and all(r["slot"] < 50 for r in blocks)
    uses, first = {}, {}
    for r in blocks:
        k = (r["source"], r["block_no"])
        uses[k] = uses.get(k, 0) + 1
        ids = np.frombuffer(bytes(r["ids"]), "<u2").tolist()
        assert len(ids) == r["n_tokens"] <= 64 and first.setdefault(k, ids) == ids
        # Each block says which tokens of which text it holds.
        whole = {i: own.encode(t) for i, x, t in docs if x == r["source"] and t}
        assert ids == [t for d in r["docs"] for t in whole[d["doc_id"]][d["first"] : d["first"] + d["n"]]] and [d["at"] for d in r["docs"]][0] == 0
    # The blocks of the small source, in order, are its texts end to end, in some order of the texts.
    tiny = [t for k in sorted(first) if k[0] == "tiny" for t in first[k]]
    assert sorted(tiny) == sorted(t for x in texts["tiny"] for t in x) and own.decode(tiny).decode().count("a small text") == 40


def test_total_and_weights_follow(spark):
    docs = [(i, f"s{i % 2}", "plain words again and again " * 40) for i in range(300)]
    blocks, report = run(spark, docs, [("s0", 800, 9), ("s1", 200, 9)], total_tokens=400 * 32, block_tokens=32, shard_slots=100)
    assert len(blocks) == 400 and abs(report["s0"]["actual_pm"] - 800) < 60
    again, _ = run(spark, docs, [("s0", 800, 9), ("s1", 200, 9)], total_tokens=400 * 32, block_tokens=32, shard_slots=100)
    assert sorted((r["shard"], r["slot"], r["source"], r["block_no"]) for r in blocks) == sorted((r["shard"], r["slot"], r["source"], r["block_no"]) for r in again)


@pytest.mark.parametrize("docs, targets", [([], [("a", 1000, 1)]), ([(1, "a", "x")], []), ([(1, "a", "x")], [("a", None, 1)]), ([(1, "a", "x")], [("a", 1, None)])])
def test_nothing_to_mix(spark, docs, targets):
    blocks, report = run(spark, docs, targets)
    assert blocks == [] and all(r["used_tokens"] == 0 and r["actual_pm"] == 0 for r in report.values())


def test_blocks_do_not_depend_on_the_layout(spark):
    docs = [(i % 250, f"s{i % 2}", f"plain words of {i % 250} again " * (i % 9)) for i in range(300)]
    d, t = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS), spark.createDataFrame([("s0", 700, 9), ("s1", 300, 2)], TARGETS)
    seen = []
    for parts, shuffles in ((1, "3"), (5, "8"), (11, "2")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        seen.append(sorted(map(str, mx.mix(d.repartition(parts), t, block_tokens=32, range_tokens=700, separator=9)[0].collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 100
    whole = sorted(map(str, mx.mix(d, t, block_tokens=32, separator=9)[0].collect()))
    assert whole == seen[0]
