"""Mixing sources to target weights in blocks of tokens.

1. The texts are encoded once, where they lie, into a table of packed ids.
2. Each source's texts, in the order of a hash of id and text, are one endless row of tokens, which is
   cut into blocks of ``block_tokens``. The order does not depend on how the input is split. Ranges of the hash are
   packed one by one: a range's place is the running sum of the ranges' totals (sources x ranges numbers), and its texts are cut in
   order within an Arrow function, so ids are copied once, into their blocks.
3. Each output shard draws how many of its slots each source gets from a multinomial distribution with the target
   weights. A source that has given each block ``max_repeat`` times gives no more; its slots go to the others.
4. The j-th slot of a source takes block ``perm(j mod n)`` of its n blocks, where ``perm`` is a pseudorandom
   permutation of the indices (a Feistel network) with another key in each round through the blocks.
5. Slots and blocks are joined by source and index.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.skew import exclusive_sum, lookup
from ..session import Scratch, ship
from .tokenizer import VOCABULARIES, codec, vocabulary


BLOCK_TOKENS = 1024
SHARD_SLOTS = 256
#: Tokens of a source that one task packs (about).
RANGE_TOKENS = 4_000_000
#: Sources in the targets at most: a configuration table, whose weights (8 bytes each) every task that draws holds.
MOST_SOURCES = 1_000_000


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1 applied to each index (Feistel with cycle walking)."""
    index, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.ones(len(size), np.uint64)
    for _ in range(32):
        half += (np.left_shift(np.uint64(1), 2 * half) < size).astype(np.uint64)
    mask = np.left_shift(np.uint64(1), half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(1, 5):
            x = right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(turn * 0xC2B2AE3D27D4EB4F % 2**64)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            left, right = right, left ^ (x & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def fill(weights: np.ndarray, caps: np.ndarray, total: int) -> np.ndarray:
    """Slots by source: weights x total, none above its cap; what a source cannot give goes to the others by weight."""
    give, free = np.zeros(len(weights)), weights > 0
    left = float(min(total, caps[free].sum()))
    while left > 1e-9 and free.any():
        share = weights * free / weights[free].sum() * left
        step = np.minimum(share, caps - give)
        give += step
        left -= step.sum()
        free &= caps - give > 1e-9
    return give


def encode_by_source(docs: DataFrame, scratch: Scratch, name: str, folder: str, separator: int | None = None) -> DataFrame:
    """A written table (source, h, doc_id, n, ids): ``h`` is a hash of id and text, ``ids`` ends with the separator if there is one."""
    vocab = vocabulary(docs.sparkSession, name, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value)
        end = [] if separator is None else [separator]
        for batch in batches:
            ids = [np.array(own.encode(t.as_py()) + end, own.dtype) for t in batch.column("text")]
            arrays = [*(batch.column(c) for c in ("source", "h", "doc_id")), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["source", "h", "doc_id", "n", "ids"])

    texts = docs.where("source is not null and length(text) > 0").select("source", F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")
    doc_type = texts.schema["doc_id"].dataType.simpleString()
    return scratch.write(texts.mapInArrow(encode, f"source string, h bigint, doc_id {doc_type}, n bigint, ids binary"), "encoded")


def pack(encoded: DataFrame, block_tokens: int, width: int, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(source, block_no, ids, docs) of the blocks of all sources; ``docs``: the texts in the block, with the place of the first token in the block, its place in the text, and the number of tokens."""
    most = encoded.groupBy("source").agg(F.sum("n").alias("t")).agg(F.max("t")).first()[0] or 0
    ranges = max(1, -(-most // range_tokens))
    part = F.least(F.lit(ranges - 1), F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * ranges)).cast("int")
    rows = encoded.withColumn("part", part)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "part").agg(F.sum("n").alias("t"))
    base = totals.select("source", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))  # a row for each range of a source
    doc = encoded.schema["doc_id"].dataType
    doc_type = pa.struct([("doc_id", to_arrow_type(doc)), ("at", pa.int32()), ("first", pa.int64()), ("n", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, place, parts, docs, out, size = None, 0, [], [], [], 0

        def close() -> None:
            if parts:
                start = place - sum(map(len, parts)) // width
                out.append((group[0], start // block_tokens, start % block_tokens, b"".join(parts), list(docs)))
                parts.clear()
                docs.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(doc_type)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source", "block_no", "at", "ids", "docs"])

        for batch in batches:
            for source, part, base, key, ids in zip(*(batch.column(c) for c in ("source", "part", "base", "doc_id", "ids")), strict=True):
                if group != (now := (source.as_py(), part.as_py())):
                    close()
                    group, place = now, base.as_py()
                data, key, done = ids.as_py(), key.as_py(), 0
                while done < len(data):
                    at = place % block_tokens
                    piece = data[done : done + (block_tokens - at) * width]
                    docs.append({"doc_id": key, "at": at, "first": done // width, "n": len(piece) // width})
                    parts.append(piece)
                    done += len(piece)
                    place += len(piece) // width
                    size += len(piece)
                    if place % block_tokens == 0:
                        close()
                if size >= 4 << 20:
                    yield flush()
                    size = 0
        close()
        yield flush()

    placed = lookup(rows, base, ["source", "part"], "inner").select("source", "part", "base", "h", "doc_id", "ids")
    ordered = placed.repartition("source", "part").sortWithinPartitions("source", "part", "h", "doc_id", "ids")
    pieces = ordered.mapInArrow(cut, f"source string, block_no bigint, at int, ids binary, docs array<struct<doc_id: {doc.simpleString()}, at: int, first: bigint, n: int>>")
    # Nearly every block is one piece; those at the ends of ranges are two or more.
    whole = pieces.groupBy("source", "block_no").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "docs"))).alias("p"))
    return whole.select("source", "block_no", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.flatten(F.transform("p", lambda x: x["docs"])).alias("docs"))


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS,
    shard_slots: int = SHARD_SLOTS, seed: int = 7, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, separator: int | None = None, range_tokens: int = RANGE_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """(blocks, report) of a mix of ``docs`` (doc_id, source, text) by ``targets`` (source, weight_pm, max_repeat).

    ``blocks``: shard, slot, source, block_no, round, n_tokens, ids (packed as little-endian integers of 2 bytes,
    or 4 for vocabularies over 65,536), docs (doc_id, at, first, n: which tokens of which text lie where). ``separator``: an id put after each text.
    ``report``: for each source of the targets its wanted and actual thousandths of all tokens, its tokens, those used, the most times
    a block is used, ``short_pm``, the thousandths that it cannot give even with all repeats, and ``met``: whether that is 0. (Actual
    shares differ from the wanted ones by the noise of the draw too.) ``total_tokens`` defaults to all tokens of the targets' sources.

    Defined results: null and empty texts and texts of sources without target (null included) give nothing;
    repeated documents count as they stand; null weights and repeats count as 0; a source with two target rows has their
    sum of weights and their larger repeat; the last block of a source may be shorter; an empty corpus gives no
    blocks and a report with zeros. Other columns are ignored. The blocks depend on the rows and the seed only, not on
    how they are split. Targets are a configuration of at most a million sources.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mix")
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.sum("weight_pm"), F.lit(0)).cast("bigint").alias("weight_pm"), F.coalesce(F.max("max_repeat"), F.lit(0)).cast("bigint").alias("max_repeat")
    )
    goal = wanted.orderBy("source").limit(MOST_SOURCES + 1).toPandas()
    if len(goal) > MOST_SOURCES:
        raise ValueError("too many sources in the targets")
    in_target = lookup(docs.select("doc_id", "source", "text"), wanted.select("source"), "source", "left_semi")
    encoded = encode_by_source(in_target, scratch, name, folder, separator)
    tokens = {r["source"]: r["t"] for r in encoded.groupBy("source").agg(F.sum("n").alias("t")).collect()}  # a row a source
    goal["tokens"] = np.array([tokens.get(s, 0) for s in goal["source"]], np.int64)
    goal["blocks"] = -(-goal["tokens"] // block_tokens)

    width = codec(Path(folder, f"{name}.tiktoken").read_bytes()).dtype.itemsize
    blocks = pack(encoded, block_tokens, width, range_tokens)
    weights, caps = goal["weight_pm"].to_numpy(float), (goal["blocks"] * goal["max_repeat"]).to_numpy(np.int64)
    usable = weights > 0
    total = int(goal["tokens"][usable].sum()) if total_tokens is None else total_tokens
    n_slots = min(-(-total // block_tokens), int(caps[usable].sum()))
    slots = scratch.write(_slots(spark, goal, weights, caps, n_slots, shard_slots, seed), "slots")
    # Slots grow with the data, and the size of their compressed files says little: never a broadcast.
    out = blocks.join(slots.hint("merge"), ["source", "block_no"], "inner").select(
        "shard", "slot", "source", "block_no", "round", (F.octet_length("ids") / width).cast("int").alias("n_tokens"), "ids", "docs"
    )
    return out, _report(spark, goal, slots, block_tokens, total)


def _whole(amounts: np.ndarray, caps: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers of the given sum next to ``amounts`` and not above ``caps``, by largest remainder."""
    out = np.minimum(np.floor(amounts + 1e-9).astype(np.int64), caps)
    for i in np.argsort(-(amounts - out), kind="stable"):
        if out.sum() >= total:
            break
        out[i] += min(1, caps[i] - out[i])
    while (short := total - int(out.sum())) > 0:
        i = int(np.argmax(caps - out))
        out[i] += min(short, int(caps[i] - out[i]))
    return out


def _slots(spark: SparkSession, goal: pd.DataFrame, weights: np.ndarray, caps: np.ndarray, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, source, block_no, round) of every output slot."""
    schema = "shard bigint, slot int, source string, block_no bigint, round int"
    if n_slots <= 0:
        return spark.createDataFrame([], schema)
    share = fill(weights, caps.astype(float), n_slots)
    share /= share.sum()
    shards = -(-n_slots // shard_slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard in batch.column("id").to_pylist():
                size = min(shard_slots, n_slots - shard * shard_slots)
                k = np.random.default_rng([seed, shard]).multinomial(size, share)
                rows.append(np.stack([np.full(len(k), shard), np.arange(len(k)), np.cumsum(k) - k, k])[:, k > 0])
            shard, source, slot, k = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard, source, slot, k)], names=["shard", "source_no", "slot", "k"])

    drawn = spark.range(shards).mapInArrow(draw, "shard bigint, source_no bigint, slot bigint, k bigint")
    # The slots of a source are numbered through all shards.
    numbered = exclusive_sum(drawn, ["source_no"], ["shard"], {"first": "k"})
    drawn_by = {r[0]: r[1] for r in drawn.groupBy("source_no").agg(F.sum("k")).collect()}
    got = np.array([drawn_by.get(i, 0) for i in range(len(goal))], np.int64)
    over = np.maximum(got - caps, 0)
    spare = np.where(weights > 0, np.maximum(caps - got, 0), 0)
    extra = _whole(fill(weights, spare.astype(float), int(over.sum())), spare, int(over.sum()))
    over_at, extra_end = np.cumsum(over) - over, np.cumsum(extra)
    blocks, names = goal["blocks"].to_numpy(np.int64), goal["source"].to_numpy(object)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, slot, k, first = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "source_no", "slot", "k", "first"))
            i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            shard, source, slot, j = np.repeat(shard, k), np.repeat(source, k), np.repeat(slot, k) + i, np.repeat(first, k) + i
            late = np.flatnonzero(j >= caps[source])  # beyond the cap: these slots go to sources with spare blocks
            o = over_at[source[late]] + j[late] - caps[source[late]]
            to = np.searchsorted(extra_end, o, side="right")
            source[late], j[late] = to, got[to] + o - (extra_end - extra)[to]
            size = np.maximum(blocks[source], 1)
            turn = j // size
            key = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64) + source.astype(np.uint64) * np.uint64(1_000_003) + turn.astype(np.uint64)
            block = permute(j % size, size, key)
            in_shard = np.minimum(shard_slots, n_slots - shard * shard_slots)
            slot = permute(slot, in_shard, shard.astype(np.uint64) ^ np.uint64(0xA5A5A5A5))
            arrays = [pa.array(shard), pa.array(slot.astype(np.int32)), pa.array(list(names[source]), pa.string()), pa.array(block), pa.array(turn.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "slot", "source", "block_no", "round"])

    return numbered.select("shard", "source_no", "slot", "k", "first").mapInArrow(place, schema)


def _report(spark: SparkSession, goal: pd.DataFrame, slots: DataFrame, block_tokens: int, total: int) -> DataFrame:
    """One row for each source of the targets."""
    if not len(goal):
        return spark.createDataFrame([], "source string, weight_pm bigint, actual_pm double, tokens bigint, used_tokens bigint, uses_of_a_block bigint, short_pm double, met boolean")
    weight = goal["weight_pm"].to_numpy(float)
    wanted = weight / max(weight.sum(), 1) * total
    short = np.maximum(wanted - goal["tokens"].to_numpy(float) * goal["max_repeat"].to_numpy(float), 0)
    nothing = (weight > 0) & ((goal["tokens"] * goal["max_repeat"]).to_numpy() == 0)
    goal = goal.assign(short_pm=np.where(nothing, 1000 * weight / max(weight.sum(), 1), short * 1000 / max(total, 1)))
    sizes = spark.createDataFrame(goal[["source", "weight_pm", "max_repeat", "tokens", "blocks", "short_pm"]])
    used = slots.groupBy("source", "block_no").agg(F.count("*").alias("uses"))
    used = lookup(used, sizes.select("source", "tokens", "blocks"), "source")
    size = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("tokens") - F.col("block_no") * block_tokens).otherwise(block_tokens)
    by = used.groupBy("source").agg(F.sum(size * F.col("uses")).alias("used_tokens"), F.max("uses").alias("uses_of_a_block"))
    every = Window.partitionBy(F.lit(0))  # one row a source
    both = sizes.join(by, "source", "left").fillna(0, ["used_tokens", "uses_of_a_block"])
    actual = F.when(F.sum("used_tokens").over(every) > 0, F.col("used_tokens") * 1000.0 / F.sum("used_tokens").over(every)).otherwise(0.0)
    return both.withColumn("actual_pm", actual).select("source", "weight_pm", "actual_pm", "tokens", "used_tokens", "uses_of_a_block", "short_pm", (F.col("short_pm") == 0).alias("met"))
