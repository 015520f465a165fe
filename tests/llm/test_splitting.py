import random
from pathlib import Path

import numpy as np
import pytest

from quillscope.llm import splitting as sp
from quillscope.llm.tokenizer import VOCABULARIES, codec


@pytest.fixture(scope="module")
def own():
    return codec(Path(VOCABULARIES, "byte_bpe_50k.tiktoken").read_bytes())


def greedy(own, ids, limit, overlap):
    """The cuts one after the other."""
    kind, allowed = sp.boundaries(np.asarray(ids), sp.marks(own))
    n, s, out = len(ids), 0, []
    while True:
        reach = min(s + limit, n)
        if reach >= n:
            return [*out, (s, n)]
        cut = -1
        for level in range(4, -1, -1):
            floor = max(s + (limit + 1) // 2, s + overlap + 1) if level >= 2 else s + overlap + 1
            fits = [p for p in range(floor, reach + 1) if allowed[p] and kind[p] >= level]
            if fits:
                cut = fits[-1]
                break
        cut = max(reach, min(s + 1, n)) if cut < 0 else cut
        out.append((s, cut))
        start = max((p for p in range(max(cut - overlap, 0) + 1) if allowed[p]), default=0)
        s = start if start > s else cut


def texts():
    rnd = random.Random(4)
    words = ["plain", "words", "été", "don't", "日本語", "🎻", "it's", "end.", "stop!", "\n\n", "\n", "(so).", "12345", "   "]
    yield from (" ".join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(40))
    yield from ("x" * 700, "🎻" * 200, "'" * 300, "\n" * 200, "a'b" * 200, "日本語" * 150)


@pytest.mark.parametrize("limit, overlap", [(16, 0), (32, 8), (100, 40), (7, 6), (1, 0)])
def test_same_as_one_cut_after_the_other(own, limit, overlap):
    rows = [own.encode(t) for t in texts()]
    got = sp.split_batch(own, rows, [limit] * len(rows), [overlap] * len(rows))
    for text, ids, pieces in zip(texts(), rows, got, strict=True):
        assert [(s, e) for s, e, _ in pieces] == greedy(own, ids, limit, overlap)
        ends = np.concatenate([[0], np.cumsum(own.lengths[ids])])
        raw = text.encode()
        for (s, e, _), nxt in zip(pieces, [*pieces[1:], None]):
            assert 0 < e - s <= limit or not ids
            if limit > 8:
                assert len(own.encode(raw[ends[s] : ends[e]].decode())) <= limit
            if nxt:
                assert s < nxt[0] <= e


def test_natural_places(own):
    text = "One sentence here. Another one there.\n\nA new paragraph that goes on for some time. And ends."
    ids = own.encode(text)
    (first, *_), = sp.split_batch(own, [ids], [12], [0])
    assert own.decode(ids[: first[1]]).decode() == "One sentence here. Another one there.\n\n" and sp.KINDS[first[2]] == "paragraph"


DOCS, LIMITS = "doc_id bigint, source string, text string, piece_no string, max_tokens string", "source string, max_tokens int, overlap_tokens int"


def test_rows(spark, own):
    long = "Some words of a sentence. " * 100
    docs = spark.createDataFrame([(1, "a", long, "", ""), (1, "a", long, "", ""), (2, "a", None, "", ""), (3, "a", "", "", ""), (4, None, long, "", ""), (5, "b", long, "", ""), (None, "a", long, "", ""), (6, "a", "short", "", ""), (7, "c", long, "", "")], DOCS)
    limits = spark.createDataFrame([("a", 50, 5), ("a", 60, 5), ("b", 50, None), ("c", None, 1), (None, 3, 1), ("d", 0, 0)], LIMITS)
    got = sp.split_oversized(docs, limits).collect()
    count = {k: sum(r["doc_id"] == k for r in got) for k in {r["doc_id"] for r in got}}
    assert set(count) == {1, 5, None} and count[1] == 2 * count[None]
    for r in got:
        assert r["n_tokens"] == r["end_token"] - r["start_token"] <= 50 and r["overlap"] == (5 if r["doc_id"] != 5 and r["piece_no"] else 0)
    whole = "".join(r["text"] for r in sorted((r for r in got if r["doc_id"] == 5), key=lambda r: r["piece_no"]))
    assert whole == long
    assert sp.split_oversized(docs.limit(0), limits).count() == 0 and sp.split_oversized(docs, limits.limit(0)).count() == 0
