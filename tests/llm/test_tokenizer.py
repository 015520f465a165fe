import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillscope.llm import tokenizer as tk

SIGNS = ["a b c ", "hello world ", "xyz" * 9, "  \n\n", "'s ", "'", "!!''ll", "été 日本語 🎻🇪🇺", " ", "12345", "\t\t", "    x", "don't we'll", "Привет мир"]


@pytest.fixture(scope="module")
def own():
    return tk.codec(Path(tk.VOCABULARIES, "byte_bpe_50k.tiktoken").read_bytes())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), min_size=2, max_size=80), st.sampled_from([7, 30, 64, 150]), st.booleans())
def test_joined_chunks_equal_the_whole(own, parts, n, unsplit):
    text = "".join(parts)
    text = "".join(text.split()) if unsplit else text
    chunks = [text[i : i + n] for i in range(0, len(text), n)]
    assert own.concatenate(chunks, [own.encode(c) for c in chunks]) == own.encode(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "🎻" * 9_000, " " * 20_000, "".join(random.Random(1).choices("abcdefgh", k=30_000)), "'" * 9_999])
def test_long_unsplit_text(own, text):
    chunks = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    assert own.concatenate(chunks, [own.encode(c) for c in chunks]) == own.encode(text)


def test_rows(spark, own):
    rnd = random.Random(2)
    long = " ".join("".join(rnd.choices("abcdeé🎻", k=rnd.randint(1, 9))) for _ in range(2_000))
    texts = [None, "", "a", "hello world", long, "x" * 5_000, "<|endoftext|>", long, long + "!"]
    ids = [1, 2, 3, 4, 5, 5, None, 5, None]
    df = spark.createDataFrame(list(zip(ids, texts, [0] * 9, ["c"] * 9)), "k bigint, t string, ids int, n string")
    got = tk.encode_texts(df, F.col("k"), F.col("t"), chunk=1_000).collect()
    want = [(k, own.encode(t) if t else []) for k, t in zip(ids, texts)]
    assert sorted(((r["doc_id"] or 0, r["ids"]) for r in got)) == sorted((k or 0, i) for k, i in want)
    assert tk.encode_texts(df.limit(0), F.col("k"), F.col("t")).count() == 0


def test_round_trip(own):
    for text in SIGNS:
        assert own.decode(own.encode(text)).decode() == text
