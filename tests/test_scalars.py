import pytest
from pyspark.sql import functions as F

from quillscope.functions import bits, codec, events, grammar, ratio


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ratio(spark):
    got = lambda c: tuple(one(spark, c))
    assert got(ratio.new(6, 4)) == (3, 2) and got(ratio.new(6, -4)) == (-3, 2) and got(ratio.new(0, 5)) == (0, 1)
    a, b = ratio.new(1, 2), ratio.new(1, 3)
    assert got(ratio.add(a, b)) == (5, 6) and got(ratio.sub(a, b)) == (1, 6) and got(ratio.mul(a, b)) == (1, 6) and got(ratio.div(a, b)) == (3, 2)
    assert one(spark, ratio.scale_int(b, 100)) == 33 and got(ratio.clamp(ratio.new(9, 1), b, a)) == (1, 2)
    assert got(ratio.add(ratio.add(ratio.new(3, 20), ratio.new(1, 20)), ratio.new(16, 20))) == (1, 1)
    assert one(spark, ratio.text(ratio.neg(a))) == "-1/2" and one(spark, ratio.less(b, a)) and not one(spark, ratio.equal(a, b))
    fib = [1, 1]
    while fib[-1] + fib[-2] < 2**63:
        fib.append(fib[-1] + fib[-2])
    assert got(ratio.new(fib[-1], fib[-2])) == (fib[-1], fib[-2])
    for bad in (ratio.new(1, 0), ratio.div(a, ratio.new(0, 3))):
        with pytest.raises(Exception, match="denominator"):
            one(spark, bad)


def test_bits(spark):
    for h in range(64):
        assert one(spark, bits.hexagram(bits.inner(F.lit(h)), bits.outer(F.lit(h)))) == h
    assert one(spark, bits.flip(F.lit(0), F.lit(0))) == 1 and one(spark, bits.flip(F.lit(5), F.lit(7))) == 5
    assert one(spark, bits.move_line(F.lit(63), F.lit(1))) == 61 and one(spark, bits.bit(F.lit(4), 2)) and one(spark, bits.with_bit(F.lit(0), 1, True)) == 2


def test_keys(spark):
    assert one(spark, codec.tag_hash(F.lit("func"))) == one(spark, codec.tag_hash(F.lit("func"))) and len(one(spark, codec.tag_hash(F.lit("x")))) == 16
    k = codec.key("typ", codec.tag_hash(F.lit("x")), codec.u32(F.lit(258)), codec.u8(F.lit(3)))
    assert one(spark, codec.read_u32(k, 11)) == 258 and one(spark, k).startswith(b"typ".hex().upper())
    ends = {"61": "62", "61FF": "62", "FFFF": None, "00FE": "00FF", "1FF0": "1FF1"}
    for a, b in ends.items():
        assert one(spark, codec.prefix_end(F.lit(a))) == b


def test_grammar(spark):
    g = grammar.natural_text(spark)
    assert g.count() == 61 and grammar.tags(g).count() == 8
    pairs = spark.createDataFrame([("w1", "space"), ("space", "space"), ("x", "w1")], "tag string, neighbor string")
    assert [tuple(r) for r in grammar.can_neighbor(pairs, g).collect()] == [("w1", "space")]
    counts = one(spark, grammar.text_counts(F.lit(1000)))
    assert sum(counts.values()) == 1000 and 500 <= sum(v for k, v in counts.items() if k[0] == "w") <= 750
    assert min(one(spark, grammar.text_counts(F.lit(1))).values()) >= 1
    table = {"w1": ["space"], "space": ["w1"]}
    assert one(spark, grammar.admits(F.array(F.lit("w1"), F.lit("space"), F.lit("w1")), table)) and not one(spark, grammar.admits(F.array(F.lit("w1"), F.lit("w1")), table))


def test_signatures():
    # Published vector 0 of BIP-340.
    key, sig = events.sign(3, "00" * 32)
    assert key.upper() == "F9308A019258C31049344F85F89D5229B531C845836F99B08601F113BCE036F9"
    assert sig.upper() == "E907831F80848D1069A5371B402410364BDF1C5F8307B0084C55F1CE2DCA821525F66A4A85EA8B71E482A74F382D2CE5EBEEE8FDB2172F477DF4900D310536C0"
    assert events.verify(key, "00" * 32, sig) and not events.verify(key, "01" + "00" * 31, sig) and not events.verify(key, "zz", sig) and not events.verify(None, None, None)


def test_event_ids_and_addresses(spark):
    rows = spark.createDataFrame([("", "ab" * 32, 5, 1, [["t", "a\"b"], ["p"]], 'x <b> & "q" \n é'), (None, None, 0, 1, None, None)], "id string, pubkey string, created_at bigint, kind int, tags array<array<string>>, content string")
    text = [r[0] for r in rows.select(events.canonical()).collect()]
    assert text[0] == '[0,"' + "ab" * 32 + '",5,1,[["t","a\\"b"],["p"]],"x \\u003cb\\u003e \\u0026 \\"q\\" \\n é"]'
    fixed = rows.withColumn("id", events.compute_id(escape_html=False)).withColumn("sig", F.lit(""))
    assert [r[0] for r in fixed.select(events.valid_id(escape_html=False)).collect()] == [True, True]
    assert [r[0] for r in rows.select(events.valid_id()).collect()] == [False, False]
    assert events.nevent_text("zz", [], None, None) is None
    address = events.nevent_text("ab" * 32, ["wss://a"], "cd" * 32, 1)
    assert address.startswith("nevent1") and events.bech32("a", b"") == "a12uel5l"
    assert fixed.where(events.matches(kinds=[1], tags={"t": ['a"b']})).count() == 1


def test_event_elements(spark):
    row = spark.createDataFrame([("f" * 64, "p", 7, 1, [["e", "x"], ["t", "y"], ["q", "z"], ["e"]], "some words go")], "id string, pubkey string, created_at bigint, kind int, tags array<array<string>>, content string")
    got = [tuple(x) for x in row.select(events.elements().alias("e")).first()["e"]]
    assert got == [("event", "f" * 16), ("pubkey", "p"), ("kind", "1"), ("word", "some"), ("word", "words"), ("literal", '"some words go"'), ("e-tag", "x"), ("hashtag", "y"), ("tag", "q:z"), ("timestamp", "7")]


def test_urls(spark):
    cases = {" wss://a.b// ": "wss://a.b", "WSS://a": None, "http://a": None, "ws://LocalHost:1": None, "wss://127.0.0.1": None, "": None}
    for a, b in cases.items():
        assert one(spark, events.normal_url(F.lit(a))) == b
