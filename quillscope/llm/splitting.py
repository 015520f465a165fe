"""Cutting oversized texts at natural boundaries, with an overlap, by pointer doubling.

For every place between two tokens of a batch of texts, not only for those a greedy scan would reach, the
farthest legal end of a piece that starts there is found, and from it, less the overlap, the start of the next
piece. Squaring this table of successors (s, s of s, s of s of s of s, ...) while marking what the marked places lead
to gives all cuts in as many rounds as the logarithm of the number of pieces. All of it is done on whole arrays.

Every piece's tokens are a run of the text's own tokens, and encoding the piece alone gives that run: the
encoding of a part between two tokens is the part of the encoding, but where a part starts with an apostrophe
that was not the start of a unit, or within a character; such places are no places for cuts. White space at
the end of a piece may take fewer tokens alone, never more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup
from ..session import ship
from .tokenizer import VOCABULARIES, Codec, codec, vocabulary

#: Kinds of boundaries, from the weakest: within a word, between words, sentences, lines, paragraphs.
KINDS = ["token", "word", "sentence", "line", "paragraph"]
#: Tokens handled at once (memory of a task: about a hundred bytes each).
BATCH_TOKENS = 400_000
_CLOSERS, _ENDS = "\"')]}»”’", ".!?…。！？"


class _Marks:
    """What each token of the vocabulary tells about the places before and after it."""

    def __init__(self, own: Codec):
        n = own.size
        self.space_first, self.space_last, self.newline_last, self.two_newlines = (np.zeros(n, bool) for _ in range(4))
        self.stop_last, self.closer, self.inside, self.quote = (np.zeros(n, bool) for _ in range(4))
        self.only_newline = np.zeros(n, bool)
        for i, piece in enumerate(own.pieces):
            text = piece.decode("utf-8", "replace")
            if not text:
                continue
            self.space_first[i], self.space_last[i] = text[0].isspace(), text[-1].isspace()
            body = text.rstrip(" \t\r")
            self.newline_last[i] = body.endswith("\n")
            self.two_newlines[i] = body.replace("\r", "").endswith("\n\n")
            self.only_newline[i] = body == "\n"
            bare = text.rstrip().rstrip(_CLOSERS)
            self.stop_last[i] = bool(bare) and bare[-1] in _ENDS
            self.closer[i] = not bare and bool(text.strip())
            self.inside[i] = 0x80 <= piece[0] < 0xC0  # begins within a character
            self.quote[i] = text[0] == "'"


_MARKS: dict[int, _Marks] = {}


def marks(own: Codec) -> _Marks:
    if id(own) not in _MARKS:
        _MARKS[id(own)] = _Marks(own)
    return _MARKS[id(own)]


def boundaries(ids: np.ndarray, m: _Marks) -> tuple[np.ndarray, np.ndarray]:
    """(kind, allowed) of the places 0..n before each token and after the last, of one or more joined texts."""
    kind, allowed = np.zeros(len(ids) + 1, np.int8), np.ones(len(ids) + 1, bool)
    if len(ids) < 2:
        return kind, allowed
    prev, nxt = ids[:-1], ids[1:]
    before = np.concatenate([ids[:1], ids[:-2]])
    space = m.space_first[nxt] | m.space_last[prev]
    stop = m.stop_last[prev] | (m.closer[prev] & m.stop_last[before])
    inner = np.where(space, 1, 0)
    inner = np.where(space & stop, 2, inner)
    inner = np.where(m.newline_last[prev], 3, inner)
    inner = np.where(m.two_newlines[prev] | (m.only_newline[prev] & m.newline_last[before]), 4, inner)
    kind[1:-1] = inner
    allowed[1:-1] = ~m.inside[nxt] & ~(m.quote[nxt] & ~space)
    return kind, allowed


def successors(kind: np.ndarray, allowed: np.ndarray, end: np.ndarray, limit: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a piece that starts at each place: its end, the next piece's start (itself at the last), the kind of its end.

    ``end``: the place of the text's end; ``limit`` and ``overlap``: the most tokens of a piece and those shared.
    The end is the farthest boundary of the strongest kind in the last half of what the limit allows; else the
    farthest between words; else the farthest allowed place.
    """
    place = np.arange(len(kind), dtype=np.int64)
    reach = np.minimum(place + limit, end)
    least = np.maximum(place + (limit + 1) // 2, place + overlap + 1)
    cut, cut_kind = np.full(len(kind), -1, np.int64), np.zeros(len(kind), np.int8)
    for level in range(len(KINDS) - 1, -1, -1):
        fits = allowed & (kind >= level)
        last = np.maximum.accumulate(np.where(fits, place, -1))[reach]
        floor = least if level >= 2 else place + overlap + 1
        take = (cut < 0) & (last >= floor)
        cut[take], cut_kind[take] = last[take], level
    # No allowed place at all within the limit: the nearest token boundary, so that pieces keep within it.
    cut = np.where(cut < 0, np.maximum(reach, np.minimum(place + 1, end)), cut)
    done = reach >= end
    cut, cut_kind = np.where(done, end, cut), np.where(done, 4, cut_kind)
    start = np.maximum.accumulate(np.where(allowed, place, -1))[np.maximum(cut - overlap, 0)]
    start = np.where(start > place, start, cut)
    return cut, np.where(done, place, start), cut_kind


def reachable(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The places that chains from ``roots`` pass, by squaring the successor table."""
    reach = np.zeros(len(successor), bool)
    reach[roots] = True
    table, known = successor, -1
    while (count := int(reach.sum())) != known:
        known = count
        reach[table[reach]] = True
        table = table[table]
    return reach


def split_batch(own: Codec, ids: list[list[int]], limits: list[int], overlaps: list[int]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind of the end) of the pieces of each text, in tokens."""
    m = marks(own)
    # Each text has one place more than tokens; texts lie one after the other.
    sizes = np.array([len(x) + 1 for x in ids], np.int64)
    first = np.cumsum(sizes) - sizes
    kinds, alloweds = zip(*[boundaries(np.asarray(x, np.int64), m) for x in ids], strict=True)
    kind, allowed = np.concatenate(kinds), np.concatenate(alloweds)
    limit = np.maximum(np.asarray(limits, np.int64), 1)
    overlap = np.clip(np.asarray(overlaps, np.int64), 0, limit - 1)
    cut, successor, cut_kind = successors(kind, allowed, np.repeat(first + sizes - 1, sizes), np.repeat(limit, sizes), np.repeat(overlap, sizes))
    starts = np.flatnonzero(reachable(successor, first))
    owner = np.searchsorted(first, starts, side="right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    for s, e, k, o in zip((starts - first[owner]).tolist(), (cut[starts] - first[owner]).tolist(), cut_kind[starts].tolist(), owner.tolist(), strict=True):
        out[o].append((s, e, k))
    return out


def split_oversized(docs: DataFrame, limits: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """Pieces of the texts of ``docs`` (doc_id, source, text) over their source's limit in ``limits`` (source, max_tokens, overlap_tokens).

    (doc_id, piece_no, start_token, end_token, n_tokens, overlap, boundary, text): a piece's tokens are those of the text
    from start_token on; ``overlap`` counts the tokens it shares with the piece before; ``boundary`` says what its
    end is (the text's end, a paragraph, line, sentence, word, or none: token).

    Defined results: texts within the limit, null and empty texts, and those of sources without a limit
    (or with a null one, or below 1) give no rows. A null overlap is 0; one of max_tokens or more is max_tokens - 1. Of several
    limits for a source the smallest holds. The overlap is larger by a token or two where its start would lie within a character or next to an
    apostrophe within a word, and none where that would stop the cuts. Each row of ``docs`` is
    handled alone, so repeated ids give repeated pieces; other columns are ignored.
    """
    ship(docs.sparkSession)
    vocab = vocabulary(docs.sparkSession, name, folder)
    usable = limits.where("source is not null and max_tokens >= 1").groupBy("source").agg(
        F.min(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))).alias("l")
    ).select("source", F.col("l.max_tokens").alias("max_tokens"), F.col("l.overlap_tokens").alias("overlap_tokens"))
    # A text has at most as many tokens as bytes, so most short texts need no encoding.
    rows = lookup(docs.select("doc_id", "source", "text"), usable, "source", "inner").where("octet_length(text) > max_tokens")
    rows = rows.select("doc_id", "max_tokens", "overlap_tokens", "text")
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value)
        for batch in batches:
            keys, group, size = batch.column("doc_id"), [], 0
            texts, most, shared = (batch.column(c).to_pylist() for c in ("text", "max_tokens", "overlap_tokens"))
            for i, text in enumerate(texts):
                ids = own.encode(text)
                if len(ids) > most[i]:
                    group.append((i, ids))
                    size += len(ids)
                if group and (size >= BATCH_TOKENS or i == len(texts) - 1):
                    yield _pieces(own, keys, texts, most, shared, group)
                    group, size = [], 0
            if group:
                yield _pieces(own, keys, texts, most, shared, group)

    return rows.mapInArrow(run, f"doc_id {doc_type}, piece_no int, start_token int, end_token int, n_tokens int, overlap int, boundary string, text string")


def _pieces(own: Codec, keys: pa.Array, texts: list[str], most: list[int], shared: list[int], group: list[tuple[int, list[int]]]) -> pa.RecordBatch:
    pieces = split_batch(own, [g[1] for g in group], [most[g[0]] for g in group], [shared[g[0]] for g in group])
    row, number, start, end, over, kind, body = [], [], [], [], [], [], []
    for (i, ids), cuts in zip(group, pieces, strict=True):
        raw = texts[i].encode("utf-8")
        ends = np.concatenate([[0], np.cumsum(own.lengths[ids])]).tolist()
        before = 0
        for k, (s, e, what) in enumerate(cuts):
            row.append(i)
            number.append(k)
            start.append(s)
            end.append(e)
            over.append(max(0, before - s) if k else 0)
            kind.append("end" if e == len(ids) else KINDS[what])
            body.append(raw[ends[s] : ends[e]].decode("utf-8", "replace"))
            before = e
    s, e = np.array(start, np.int32), np.array(end, np.int32)
    arrays = [keys.take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(s), pa.array(e), pa.array(e - s), pa.array(over, pa.int32()), pa.array(kind, pa.string()), pa.array(body, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece_no", "start_token", "end_token", "n_tokens", "overlap", "boundary", "text"])
