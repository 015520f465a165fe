import json
import re
import string

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillscope.llm import formatting as fm

TEXT = "The quick brown fox, and the lazy dog: number 7"


@given(st.lists(st.binary(max_size=12) | st.sampled_from([b"", b"abc", b"abcd", b"ab"]), max_size=60))
def test_trie(strings):
    trie = fm.Trie()
    numbers = [trie.add(s, str(i // 2)) for i, s in enumerate(strings)]
    assert trie.counts == [len({i // 2 for i, k in enumerate(numbers) if k == t}) for t in range(len(trie.counts))]
    assert len(set(numbers)) == len(set(strings)) == len(trie.counts) and all((a == b) == (x == y) for a, x in zip(numbers, strings) for b, y in zip(numbers, strings))


def brute(rows, least=20):
    groups = {}
    for key, text in rows:
        if key is None or text is None:
            continue
        body = text
        if text.lstrip().startswith("{"):
            try:
                body = " ".join(f"{k}:{v}" for k, v in sorted(json.loads(text).items()))
            except ValueError:
                pass
        canon = "".join(c for c in body.upper().lower() if c.isalnum())
        if len(canon) >= least:
            groups.setdefault(canon, set()).add(key)
    return sorted((min(g), k, len(g)) for g in groups.values() for k in g)


def rows():
    out = [("b", TEXT), ("a", TEXT.upper()), ("c", re.sub("[,:]", "", TEXT)), ("c", TEXT), ("d", "​" + TEXT.replace(" ", " \n")), ("e", TEXT + " 8"), ("f", None), (None, TEXT), ("g", ""), ("h", "!!" * 50), ("i", "short")]
    out += [("j", '{"name": "somebody here", "about": "nothing much"}'), ("k", '{ "about":"Nothing much",\n"name":"somebody, here"}'), ("l", '{"name": "somebody here", "about": "nothing much"'), ("m", '{"name": "somebody here", "name": "twice in one object"}')]
    out += [(f"n{i:04}", f"common beginning of very many texts {i % 700}") for i in range(2000)] + [(f"o{i:04}", "straße und mehr, ein langer Satz!" + "?" * (i % 5)) for i in range(900)] + [("p", "x" * 70_000), ("q", "X" * 70_000 + "."), ("r", "x" * 69_999)]
    return out


@pytest.mark.parametrize("limit", [10, 300, 20_000])
def test_classes(spark, limit):
    data = rows()
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in data], "id string, text string, canon string, bucket int")
    got = fm.classes(df, F.col("id"), F.col("text"), bucket_rows=limit, bucket_bytes=200_000).collect()
    assert sorted((r["first_id"], r["id"], r["n_copies"]) for r in got) == brute(data)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert fm.classes(df, F.col("id"), F.col("text")).count() == 0
    some = spark.createDataFrame([("a", ""), ("b", "!"), ("c", "x")], "id string, text string")
    assert sorted(map(tuple, fm.classes(some, F.col("id"), F.col("text"), least_signs=0).collect())) == [("a", "a", 2), ("a", "b", 2), ("c", "c", 1)]


def test_every_ascii_sign_is_formatting(spark):
    df = spark.createDataFrame([(string.punctuation + string.whitespace,)], "t string")
    assert df.select(fm.canonical(F.col("t"))).first()[0] == ""


def test_directory_beyond_a_broadcast(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, "id string, text string")
    monkeypatch.setattr(fm, "DIRECTORY", 1)
    got = fm.classes(df, F.col("id"), F.col("text"), bucket_rows=10).collect()
    assert sorted(tuple(r) for r in got) == brute(data)
