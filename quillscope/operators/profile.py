"""Multi-scale channel profiles: counting, training, convergence and fingerprints.

The token with the 1-based place i of a stream counts at depth d (0 to 7) if i is a multiple of 2^(7-d). A profile is
eight rows, one a depth, each with its eight counts. Documents are counted where they lie: a document that
starts after ``offset`` tokens picks its own places of each stride, so a corpus needs no token rows, only the running sum of token counts.
Texts and token streams never move. A document is boiled down, where it lies, to how many tokens of each channel it has at each residue of their place
modulo 128 (1,024 small numbers, whatever its length): with the offset modulo 128 they give the counts of every depth. Only they meet the offsets, by a
broadcast of these for up to :data:`..plans.skew.BROADCAST_ROWS` documents, else by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.tokens import CHUNK_BYTES, channels
from ..functions.vectors import SIZE, dc, detail_energy, walsh
from ..plans.skew import exclusive_sum, lookup
from ..session import Scratch

DEPTHS = 8
TRAIN_WINDOW = 50_000
#: Neighbouring documents that are compared in one task.
BLOCK = 100_000


def pick_counts(picked: Column) -> Column:
    """The eight counts of an array of channel numbers."""
    code = F.array_join(F.transform(picked, lambda x: x.cast("string")), "")
    return bind(code, lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(str(c)), F.lit("")))).cast("bigint") for c in range(SIZE)]))


def level_counts(stream: Column, offset: Column) -> Column:
    """Array of the counts at each depth of the channels of one document that starts after ``offset`` tokens."""
    def at_depth(depth: int) -> Column:
        if depth == DEPTHS - 1:
            return pick_counts(stream)
        stride = 1 << (DEPTHS - 1 - depth)
        start = (F.lit(stride) - offset % stride).cast("int")
        places = F.when(start <= F.size(stream), F.sequence(start, F.size(stream), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return pick_counts(F.transform(places, lambda p: F.element_at(stream, p)))

    return F.array(*[at_depth(d) for d in range(DEPTHS)])


RESIDUES = 1 << (DEPTHS - 1)


def residue_counts(stream: Column) -> Column:
    """Array of 128 x 8 counts of an array of channel numbers: by the 1-based place modulo 128, then by channel."""
    def at_residue(r: Column) -> Column:
        start = F.when(r == 0, RESIDUES).otherwise(r).cast("int")
        places = F.when(start <= F.size(stream), F.sequence(start, F.size(stream), F.lit(RESIDUES))).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(places) > 0, pick_counts(F.transform(places, lambda p: F.element_at(stream, p)))).otherwise(F.array_repeat(F.lit(0).cast("bigint"), SIZE))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(RESIDUES - 1)), at_residue)).cast("array<int>")


def counts_at(residues: Column, offset: Column) -> Column:
    """The counts at each depth, as :func:`level_counts` gives them, from those by residue."""
    def at_depth(depth: int) -> Column:
        stride = 1 << (DEPTHS - 1 - depth)
        first = F.pmod(-offset, F.lit(stride)).cast("int")
        places = F.sequence(first, F.lit(RESIDUES - 1), F.lit(stride))
        return F.array(*[F.aggregate(places, F.lit(0).cast("bigint"), lambda a, r: a + F.get(residues, r * SIZE + c)) for c in range(SIZE)])

    return F.array(*[at_depth(d) for d in range(DEPTHS)])


def document_counts(docs: DataFrame, order: str, text: str, window: int | None = TRAIN_WINDOW, chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """(file, size, residues): the number of each document's first ``window`` tokens, and their counts by residue. Written once."""
    streams = docs.select(F.col(order).cast("bigint").alias("file"), F.explode(F.array(channels(F.col(text), chunk_bytes, window))).alias("stream"))
    counted = streams.select("file", F.size("stream").cast("bigint").alias("size"), residue_counts(F.col("stream")).alias("residues"))
    return Scratch(docs.sparkSession, "counts").write(counted, "counts")


def with_offsets(counts: DataFrame) -> DataFrame:
    """Adds ``offset``: the tokens of all documents before, in the order of ``file``."""
    placed = exclusive_sum(counts.select("file", "size"), [], ["file"], {"offset": "size"})
    return lookup(counts, placed.select("file", "offset"), "file", "inner")


def with_levels(placed: DataFrame) -> DataFrame:
    """(file, levels) of documents with their offsets."""
    return placed.select("file", counts_at(F.col("residues"), F.col("offset")).alias("levels"))


def sum_levels(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum the ``levels`` of many documents to one row a depth: ([by,] depth, spatial)."""
    by = by or []
    # The generator makes sure that the levels of a document are counted once, not once for each of the 64 sums.
    each = counted.select(*by, F.posexplode("levels").alias("depth", "c"))
    wide = each.groupBy(*by, "depth").agg(*[F.sum(F.get("c", F.lit(c))).alias(f"s{c}") for c in range(SIZE)])
    if not by:  # an empty corpus has all depths too
        wide = counted.sparkSession.range(DEPTHS).select(F.col("id").cast("int").alias("depth")).join(wide, "depth", "left")
    return wide.select(*by, "depth", F.array(*[F.coalesce(f"s{c}", F.lit(0)).cast("bigint") for c in range(SIZE)]).alias("spatial"))


def with_spectrum(levels: DataFrame) -> DataFrame:
    """Adds the transform of each depth, the count of tokens, and the counts that equal it by construction."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), SIZE)
    return levels.withColumn("walsh", walsh(F.col("spatial"))).withColumn("total", F.get("walsh", F.lit(0))).withColumns(
        {"bond_count": F.col("spatial"), "miss_count": zero, "total_walk_dist": zero}
    )


def train(docs: DataFrame, order: str, text: str, window: int | None = TRAIN_WINDOW, threshold: int | None = 100, chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """The profile of a corpus in the order of ``order``: (depth, spatial, walsh, total, ...).

    With a ``threshold`` only the documents up to the first at which the root's shape has converged are counted.
    """
    counted = with_levels(with_offsets(document_counts(docs, order, text, window, chunk_bytes)))
    if threshold is not None:
        stop = convergence(counted, threshold).agg(F.min(F.when(F.col("converged"), F.col("file"))).alias("stop"))
        counted = counted.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("file") <= F.col("stop")))  # one row
    return with_spectrum(sum_levels(counted.select("levels")))


def convergence(counted: DataFrame, threshold: int = 100, block: int = BLOCK) -> DataFrame:
    """(file, root, converged): the root's running counts, and whether the last 16 of them (8 at least) keep their shape.

    Each pair of neighbours c, p must have floor(max |c_k DC_p - p_k DC_c| / floor(DC_c DC_p / 1000)) <= threshold, with all divisors over 0.
    """
    roots = counted.select("file", F.get("levels", F.lit(0)).alias("root"))
    columns = [f"r{c}" for c in range(SIZE)]
    wide = roots.select("file", F.lit(1).cast("bigint").alias("one"), *[F.get("root", F.lit(c)).alias(f"r{c}") for c in range(SIZE)])
    wide = exclusive_sum(wide, [], ["file"], {"place": "one", **{f"b{c}": c for c in columns}})
    running = wide.select("file", "place", F.array(*[F.col(c) + F.col(f"b{c}") for c in columns]).alias("root")).withColumn("w", walsh(F.col("root")))
    # Blocks of neighbours; the last rows of each go to the next one too, as far as its windows look back.
    back = 16
    here = F.expr(f"place div {block}")
    halo = F.when(F.col("place") % block >= block - back, F.array(here, here + 1)).otherwise(F.array(here))
    spread = running.withColumn("block", F.explode(halo))
    order = Window.partitionBy("block").orderBy("place")
    pair = spread.withColumn("p", F.lag("w").over(order))
    exact = F.expr("array_max(transform(arrays_zip(w, p), x -> abs(x.w * p[0] - x.p * w[0]))) div nullif(w[0] * p[0] div 1000, 0)")
    close = F.coalesce((dc(F.col("w")) > 0) & (dc(F.col("p")) > 0) & (exact <= threshold), F.lit(False))
    kept = F.min(F.when(F.col("place") > 0, close.cast("int"))).over(order.rowsBetween(-14, 0))
    judged = pair.select("file", "root", "block", "place", ((F.col("place") >= 7) & (kept == 1)).alias("converged"))
    return judged.where(F.col("block") == here).select("file", "root", "converged")


def fingerprint(docs: DataFrame, group: str, order: str, text: str, window: int | None = TRAIN_WINDOW, chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """The profile of each author's documents: ([group], depth, spatial, walsh, ..., origin_tokens).

    After each document follow max(1, floor(3 n / 100)) origin tokens in the same stream.
    """
    stream = F.explode(F.array(channels(F.col(text), chunk_bytes, window))).alias("stream")
    rows = docs.where(F.col(group).isNotNull()).select(F.col(group).alias("who"), F.col(order).cast("bigint").alias("file"), stream)
    extra = F.greatest(F.lit(1), F.expr("3 * size(stream) div 100")).cast("int")
    rows = rows.select("who", "file", extra.alias("extra"), F.explode(F.array(F.concat("stream", F.array_repeat(F.lit(7), extra)))).alias("stream"))
    rows = rows.select("who", "file", "extra", F.size("stream").cast("bigint").alias("size"), residue_counts(F.col("stream")).alias("residues"))
    rows = Scratch(docs.sparkSession, "counts").write(rows, "counts")
    placed = exclusive_sum(rows.select("who", "file", "size"), ["who"], ["file"], {"offset": "size"})
    counted = lookup(rows, placed.select("who", "file", "offset"), ["who", "file"], "inner").select("who", "extra", counts_at(F.col("residues"), F.col("offset")).alias("levels"))
    levels = with_spectrum(sum_levels(counted, ["who"]))
    origin = counted.groupBy("who").agg(F.sum("extra").alias("origin_tokens"))
    return lookup(levels, origin, "who").withColumnRenamed("who", group)


def balance(w: Column) -> Column:
    """Share of the detail in a spectrum; null where it is all zero."""
    whole = F.abs(dc(w)) + detail_energy(w)
    return F.when(whole > 0, detail_energy(w) / whole)


def stats_at(levels: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, spatial, walsh, total, bond_count, miss_count, total_walk_dist) of the asked depths of a profile; a depth that is none has zeros."""
    asked = levels.sparkSession.createDataFrame([(d,) for d in depths], "depth int")
    vectors = ["spatial", "walsh", "bond_count", "miss_count", "total_walk_dist"]
    zero = F.array_repeat(F.lit(0).cast("bigint"), SIZE)
    both = asked.join(F.broadcast(levels), "depth", "left")  # eight rows
    return both.select("depth", *[F.coalesce(c, zero).alias(c) for c in vectors], F.coalesce("total", F.lit(0)).alias("total"))


def health(levels: DataFrame, converged: Column) -> DataFrame:
    """One row: the count of tokens, the root's spectrum, the finest depth's counts, and whether training had converged."""
    at_depth = lambda d, c: F.max_by(c, F.when(F.col("depth") == d, 1))
    return levels.agg(at_depth(DEPTHS - 1, "total").alias("token_count"), at_depth(0, "walsh").alias("root_walsh"), at_depth(DEPTHS - 1, "spatial").alias("leaf")).withColumn("converged", converged)
