import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillscope.functions import tokens as tok

WORD = set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xaa\xb5\xba") | set(range(0xC0, 0x100)) - {0xD7, 0xF7}
SPACE = set(b"\t\n\v\f\r \x85\xa0")


def model_tokens(data: bytes, chunk: int | None = 4096) -> list[bytes]:
    """The tokens byte by byte."""
    out = []
    for start in range(0, len(data), chunk or max(1, len(data))):
        part, i = data[start : start + (chunk or len(data))], 0
        while i < len(part):
            kind = WORD if part[i] in WORD else SPACE if part[i] in SPACE else None
            j = i + 1
            while kind and j < len(part) and part[j] in kind:
                j += 1
            out.append(part[i:j])
            i = j
    return out


def runes(data: bytes) -> list[str]:
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return out


def model_channel(token: bytes) -> int:
    r = runes(token)
    if r[0] in "\t\n\v\f\r ":
        return 6
    if r[0] != "�" and re.match(r"[^\W_]", r[0]) and (r[0].isalpha() or r[0].isdecimal()):
        return next(c for c, most in enumerate((1, 3, 5, 8, 1 << 60)) if len(r) <= most)
    return 5


def tags(spark, text, **options):
    row = spark.createDataFrame([(text,)], "t string").select(tok.elements(F.col("t"), **options).alias("e")).first()
    return [(x["tag"], x["value"].encode("latin-1")) for x in row["e"]]


def test_plain_sentence(spark):
    assert [t for t, _ in tags(spark, "hello world! 42")] == ["w3", "space", "w3", "punct", "space", "w2"]
    assert tags(spark, "") == [] and tags(spark, None) == []


def test_bytes_of_other_letters(spark):
    got = [t for t, _ in tags(spark, "voilà et “été” crêpe")]
    assert len(got) == 16 and {t: got.count(t) for t in set(got)} == {"punct": 10, "space": 2, "w2": 2, "w3": 2}


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="aé êõúñ— ªµº日🎻!1 \n", max_size=40), min_size=150, max_size=150))
def test_agrees_with_a_model_of_bytes(spark, texts):
    texts = [*texts, "é" * 3000, "ab " * 2000, "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: r["c"] for r in rows.select("i", tok.channels(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == [model_channel(x) for x in model_tokens(t.encode())], t


@pytest.mark.parametrize("chunk", [None, 4096])
def test_window_is_a_prefix(spark, chunk):
    text = "word, " * 9000
    row = spark.createDataFrame([(text,)], "t string").select(tok.tokens(F.col("t"), chunk).alias("a"), tok.tokens(F.col("t"), chunk, 500).alias("b"), tok.tokens(F.col("t"), chunk, 15000).alias("c")).first()
    assert row["b"] == row["a"][:500] and row["c"] == row["a"][:15000]


def test_channel_index_and_lines(spark):
    df = spark.createDataFrame([(t,) for t in [*tok.CHANNELS, "unknown", "", None]], "t string")
    assert [r[0] for r in df.select(tok.channel_index(F.col("t"))).collect()] == [*range(8), -1, -1, -1]
    row = spark.createDataFrame([("first line\nsecond line\r\nthird\n",)], "t string").select(tok.lines(F.col("t")).alias("l")).first()
    assert [tuple(x) for x in row["l"]] == [("line", "first line"), ("line", "second line"), ("line", "third")]


def test_six_bit_groups(spark):
    df = spark.createDataFrame([("Ab",), ("",), ("é" * 100,)], "t string").select(tok.hex_encode(F.col("t")).alias("g"), "t")
    got = df.select("g", F.decode(tok.hex_decode(F.col("g"), F.octet_length("t")), "UTF-8").alias("back"), "t").collect()
    assert got[0]["g"] == [16, 22, 8, 0] and all(r["back"] == r["t"] for r in got)
