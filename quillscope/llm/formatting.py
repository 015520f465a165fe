"""Records that differ in formatting only: recursive radix partitioning on canonical bytes and tries of the buckets.

1. Each record gets its canonical bytes: letter case folded; punctuation, white space and invisible characters
   left out; the fields of a JSON object in the order of their names. They are written once.
2. Buckets are the records with the same first 4 bytes. Those over the limit are split by their first 8 bytes,
   16, 32 and so on, until each fits or its strings end. Each round counts only the records of oversized
   buckets, with map-side aggregation, and yields at most total / limit oversized ones.
3. A string that ended within an oversized bucket and is itself over the limit (a text copied very often) has all its copies
   in that one place of the directory: its counter is an aggregate, and its records never meet in one task.
4. All other buckets are read one by one, in the order of an external sort, into a trie whose terminals count.

A bucket's limits are fixed, so a task needs the same memory at every size. The directory grows with the number of
oversized buckets; beyond a million entries it is joined by a salted shuffle in place of a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..plans.skew import lookup
from ..session import Scratch, ship

#: Characters that show nothing but are neither spaces, controls nor format characters by category.
_UNSEEN = r"\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"
_DROPPED = rf"[\p{{P}}\p{{Z}}\p{{Cc}}\p{{Cf}}\s$+<=>^`|~{_UNSEEN}]+"
#: Records and bytes a bucket may hold, and entries of a directory (9 bytes each) that may be broadcast.
BUCKET_ROWS, BUCKET_BYTES, DIRECTORY = 20_000, 16 << 20, 1_000_000


def canonical(content: Column) -> Column:
    """The text without what is formatting only."""
    parsed = F.when(content.rlike(r"^\s*\{"), F.try_parse_json(content))
    # JSON escapes stand for characters; those of white space are dropped, the others' marks are punctuation.
    fields = F.regexp_replace(F.to_json(parsed), r"\\(?:[nrtbf]|u00[01][0-9a-f])", " ")
    folded = F.lower(F.upper(F.coalesce(fields, content)))
    return F.regexp_replace(folded, _DROPPED, "")


class Trie:
    """Path-compressed byte trie whose terminals count.

    A terminal holds the ids that ended there and their counter: copies of one id (repeated deliveries) count once.
    """

    __slots__ = ("_root", "ids", "counts")

    def __init__(self) -> None:
        self._root: list = [b"", {}, -1]  # label, children by first byte, terminal
        self.ids: list[set[str]] = []
        self.counts: list[int] = []

    def _terminal(self) -> int:
        self.ids.append(set())
        self.counts.append(0)
        return len(self.counts) - 1

    def add(self, s: bytes, key: str) -> int:
        """Count a record; gives the number of its terminal, equal for equal strings."""
        t = self._find(s)
        if key not in self.ids[t]:
            self.ids[t].add(key)
            self.counts[t] += 1
        return t

    def _find(self, s: bytes) -> int:
        node, i, n = self._root, 0, len(s)
        while i < n:
            child = node[1].get(s[i])
            if child is None:
                t = self._terminal()
                node[1][s[i]] = [s[i:], {}, t]
                return t
            label = child[0]
            if s.startswith(label, i):
                node, i = child, i + len(label)
                continue
            lo, hi = 1, min(len(label), n - i)  # the length of the common part, by halving
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if s.startswith(label[:mid], i) else (lo, mid - 1)
            middle = [label[:lo], {label[lo]: child}, -1]
            child[0] = label[lo:]
            node[1][s[i]] = middle
            node, i = middle, i + lo
        if node[2] < 0:
            node[2] = self._terminal()
        return node[2]

    def rows(self) -> tuple[list[str], list[str], list[int]]:
        """(first id, id, counter of its terminal) of each record."""
        firsts, keys, counts = [], [], []
        for group, count in zip(self.ids, self.counts, strict=True):
            firsts += [min(group)] * count
            keys += group
            counts += [count] * count
        return firsts, keys, counts


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their buckets go straight into the bucket's trie, and its terminals out at the bucket's end."""
    current, trie = None, Trie()

    def emit() -> pa.RecordBatch:
        firsts, keys, counts = trie.rows()
        return pa.RecordBatch.from_arrays([pa.array(firsts, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["first_id", "id", "n_copies"])

    for batch in batches:
        buckets, ids, texts = (batch.column(c) for c in ("bucket", "id", "canon"))
        for b, key, text in zip(buckets.to_pylist(), ids.to_pylist(), texts, strict=True):
            if b != current:
                if trie.counts:
                    yield emit()
                current, trie = b, Trie()
            trie.add(text.as_py(), key)
    if trie.counts:
        yield emit()


def classes(records: DataFrame, key: Column, content: Column, least_signs: int = 20, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(first_id, id, n_copies): each record with the lowest id of the records with the same canonical text, itself included, and their number.

    Defined results: records with a null key or null content, and those of fewer than ``least_signs`` letters or digits (0: all),
    give no row; repeated keys with the same text count once; an object that names a field twice, and
    broken JSON, is taken as plain text; empty texts (if allowed) are one class; other columns, under any names, are ignored.
    """
    spark = records.sparkSession
    ship(spark)
    scratch = Scratch(spark, "formatting")
    # The generator keeps the optimiser from evaluating the canonical text once more for each filter on it.
    plain = records.select(key.alias("id"), F.explode(F.array(canonical(content))).alias("text")).where("id is not null and text is not null")
    if least_signs > 0:
        plain = plain.where(F.col("text").rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{least_signs}}}"))
    rows = scratch.write(plain.select("id", F.encode("text", "UTF-8").alias("canon")), "canonical")

    def prefix(level: int) -> Column:
        return F.xxhash64(F.substring("canon", 1, 4 << level))

    # The directory: for each level the oversized prefixes, and the oversized strings that end there.
    levels: list[tuple[DataFrame, DataFrame]] = []
    active = rows
    while True:
        level = len(levels)
        counts = active.groupBy(prefix(level).alias("h"), (F.octet_length("canon") <= 4 << level).alias("ended")).agg(
            F.count("*").alias("n"), F.sum(F.octet_length("canon")).alias("b")
        )
        large = scratch.write(counts.where((F.col("n") > bucket_rows) | (F.col("b") > bucket_bytes)).select("h", "ended"), f"level{level}")
        found = {r[0] for r in large.groupBy("ended").count().collect()}
        if not found:
            break
        levels.append((large.where("not ended").select("h"), large.where("ended").select("h")))
        if False not in found:
            break
        active = lookup(active.withColumn("h", prefix(level)), levels[-1][0], "h", "left_semi", most=DIRECTORY).drop("h")

    # Each record goes down the directory to the first bucket that fits, or to the terminal of a string copied very often.
    bucket, often = F.lit(None).cast("bigint"), F.lit(False)
    placed = rows
    deeper = F.lit(True)
    for level, (split, ends) in enumerate(levels):
        placed = placed.withColumn("h", prefix(level))
        placed = lookup(placed, split.withColumn(f"s{level}", F.lit(True)), "h", "left", most=DIRECTORY)
        placed = lookup(placed, ends.withColumn(f"e{level}", F.lit(True)), "h", "left", most=DIRECTORY).drop("h")
        ended = F.octet_length("canon") <= 4 << level
        is_split = F.coalesce(F.col(f"s{level}"), F.lit(False)) & ~ended
        often = often | (deeper & ended & F.coalesce(F.col(f"e{level}"), F.lit(False)))
        bucket = F.coalesce(bucket, F.when(deeper & ~is_split, F.xxhash64(F.lit(level), prefix(level))))
        deeper = deeper & is_split
    bucket = F.coalesce(bucket, F.xxhash64(F.lit(len(levels)), prefix(len(levels))))
    placed = placed.select("id", "canon", bucket.alias("bucket"), often.alias("often"))
    in_tries = placed.where("not often").select("bucket", "id", "canon").repartition("bucket").sortWithinPartitions("bucket")
    out = in_tries.mapInArrow(_count_buckets, "first_id string, id string, n_copies bigint")
    if levels:
        hot = placed.where("often").select("id", "canon").distinct()
        terminals = hot.groupBy("canon").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
        out = out.unionByName(lookup(hot, terminals, "canon", "inner").select("first_id", "id", "n_copies"))
    return out


def event_classes(events: DataFrame, kinds: tuple[int, ...] = (0, 1, 30023), **options: int) -> DataFrame:
    """:func:`classes` of the contents of events of the given kinds."""
    return classes(events.where(F.col("kind").isin(*kinds)), norm_key(F.col("id")), F.col("content"), **options)
