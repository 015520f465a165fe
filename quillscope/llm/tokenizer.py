"""Byte-level BPE encoding of whole corpora with a public vocabulary.

Texts up to ``chunk`` characters are encoded row by row in Arrow batches. Longer texts are cut into chunks that
are encoded as rows of their own, on any executors, and put together by tree concatenation: at each join a
window around it is encoded again and grown until it agrees with both sides; neighbours are joined in pairs,
then pairs of pairs, and so on. The result equals the encoding of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import spread
from ..session import ship

#: Folder of the public vocabularies; a parameter everywhere.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk; longer texts are cut.
CHUNK = 16_384

_CODECS: dict[int, Codec] = {}
_EDGE = re.compile(r"\S(?=\s)")


class Codec:
    """One vocabulary in one process."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        pairs = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(ranks.values(), default=0) + 1
        self.pieces: list[bytes] = [b""] * self.size
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.lengths = np.array([len(x) for x in self.pieces], np.int32)
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self._encoding.encode_ordinary

    @property
    def dtype(self) -> np.dtype:
        """The type in which ids are packed into bytes."""
        return np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of ``left + right`` from the ids of both, with a small window encoded again."""
        if not left_ids or not right_ids:
            return left_ids or right_ids
        # A place between a sign and white space always ends a unit of the pattern, so a window between two
        # such places can be encoded alone and both sides agree with it at its ends.
        reach = 32
        while reach < len(left) or reach < len(right):
            a = left.rfind(" ", 0, max(0, len(left) - reach))
            while a > 0 and left[a - 1].isspace():
                a = left.rfind(" ", 0, a)
            b = _EDGE.search(right, min(reach, len(right)))
            if a > 0 and b:
                head, tail = left[a:], right[: b.end()]
                keep_l = _cut(self.lengths[left_ids], -len(head.encode("utf-8", "surrogatepass")))
                keep_r = _cut(self.lengths[right_ids], len(tail.encode("utf-8", "surrogatepass")))
                if keep_l is not None and keep_r is not None:
                    return left_ids[:keep_l] + self.encode(head + tail) + right_ids[keep_r:]
            reach *= 4
        # Text without such places: windows of tokens, until two tokens agree on either side. A BPE sequence
        # is the encoding of its text if each two neighbours are, which the agreement makes sure of.
        n = 8
        while n < max(len(left_ids), len(right_ids)):
            i, j = max(0, len(left_ids) - n), min(n, len(right_ids))
            try:
                window = self.encode(self.decode(left_ids[i:] + right_ids[:j]).decode("utf-8"))
            except UnicodeDecodeError:  # the window begins or ends within a character
                n += 1
                continue
            good_left = i == 0 or window[:2] == left_ids[i : i + 2]
            good_right = j == len(right_ids) or window[-2:] == right_ids[j - 2 : j]
            if good_left and good_right:
                return left_ids[:i] + window + right_ids[j:]
            n *= 2
        return self.encode(left + right)

    def concatenate(self, texts: list[str], ids: list[list[int]]) -> list[int]:
        """Tree concatenation of consecutive chunks."""
        parts = list(zip(texts, ids, strict=True))
        while len(parts) > 1:
            pairs = [(a[0] + b[0], self.join(*a, *b)) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = pairs + parts[len(parts) // 2 * 2 :]
        return parts[0][1] if parts else []


def _cut(lengths: np.ndarray, at: int) -> int | None:
    """How many tokens make up ``at`` bytes (from the end if negative), or None if no token ends there."""
    ends = np.cumsum(lengths)
    want = at if at >= 0 else int(ends[-1]) + at
    i = int(np.searchsorted(ends, want)) if want else -1
    return i + 1 if i < 0 or (i < len(ends) and ends[i] == want) else None


def codec(vocabulary: bytes) -> Codec:
    """The codec of a vocabulary, made once in each process."""
    key = hash(vocabulary)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
    """A broadcast of the vocabulary file (under 1 MB whatever the data)."""
    ship(spark)
    return spark.sparkContext.broadcast(Path(folder, f"{name}.tiktoken").read_bytes())


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_texts(df: DataFrame, key: Column, text: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens.

    Defined results: null and empty texts give an empty list; every row gives one row, also with a null or
    repeated key; an empty table gives an empty one; other columns, under any names, are ignored.
    """
    vocab = vocabulary(df.sparkSession, name, folder)
    rows = df.select(key.alias("doc_id"), text.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value)
        for batch in batches:
            ids = [own.encode(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, _lists(ids)], names=[*batch.schema.names[:-1], "ids"])

    long = F.length("text") > chunk
    # Chunks of long texts are spread by themselves.
    short = spread(rows.where(~F.coalesce(long, F.lit(False)))).mapInArrow(encode, f"doc_id {id_type}, ids array<int>")

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=[*batch.schema.names, "ids"])

    def put_together(table: pa.Table) -> pa.Table:
        own = codec(vocab.value)
        table = table.sort_by("n")
        whole = own.concatenate(table.column("text").to_pylist(), table.column("ids").to_pylist())
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": _lists([whole])})

    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    chunks = (
        rows.where(long)
        .select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
        .select("doc_id", "row", F.posexplode(cut).alias("n", "text"))
    )
    parts = chunks.repartition("row", "n").mapInArrow(encode_chunks, f"doc_id {id_type}, row bigint, n int, text string, ids array<int>")
    joined = parts.groupBy("doc_id", "row").applyInArrow(put_together, f"doc_id {id_type}, ids array<int>")
    return short.unionByName(joined)
