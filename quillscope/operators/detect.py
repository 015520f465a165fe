"""Comparing documents with trained profiles and scoring them: one narrow projection a document, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import at, bind, longs
from ..functions.text import fixed
from ..functions.tokens import CHUNK_BYTES, channels
from ..functions.vectors import SIZE, walsh
from .profile import DEPTHS, level_counts

WINDOW, LEAST_TOKENS = 500, 32
# The calibrated boundaries by pass (pass 0 is depth 7), the weights of the four voters and their boundaries.
WALK_BOUNDARY = [0.093, 0.125, 0.130, 0.138, 0.140, 0.140, 0.140, 0.140]
BOND_BOUNDARY = [0.733, 0.697, 0.673, 0.638, 0.650, 0.650, 0.650, 0.650]
WALK_WEIGHT, BOND_WEIGHT, PUNCT_WEIGHT, MISS_WEIGHT = 0.20, 0.20, 0.55, 0.05
MISS_BOUNDARY, PUNCT_BOUNDARY = 0.11, 0.080
LEGACY_WALK_BOUNDARY, LEGACY_MISS_BOUNDARY = 0.110, 0.18
TROLL_START, TROLL_SPAN = 0.67, 0.13
SNAPSHOT_VERSION = 2


@dataclass(frozen=True)
class Model:
    """A trained profile: eight vectors of eight counts, small whatever the corpus."""

    spatial: tuple[tuple[int, ...], ...]

    @classmethod
    def from_rows(cls, levels: DataFrame) -> Model:
        """From the eight rows (depth, spatial) of a trained profile."""
        rows = sorted((r["depth"], tuple(r["spatial"])) for r in levels.select("depth", "spatial").limit(DEPTHS + 1).collect())
        if [d for d, _ in rows] != list(range(DEPTHS)):
            raise ValueError("a profile has one row for each of the depths 0 to 7")
        return cls(tuple(s for _, s in rows))

    def to_json(self) -> str:
        import json
        from datetime import datetime, timezone

        levels = [
            {"spatial": list(s), "walsh": _walsh(s), "bond_count": list(s), "miss_count": [0] * SIZE, "total_walk_dist": [0] * SIZE}
            for s in self.spatial
        ]
        at_leaf = list(self.spatial[-1])
        return json.dumps({"version": SNAPSHOT_VERSION, "frozen_at": datetime.now(timezone.utc).isoformat(), "levels": levels, "origin_profile": [0] * 7 + [at_leaf[7]], "token_count": sum(at_leaf)})

    @classmethod
    def from_json(cls, text: str) -> Model:
        import json

        data = json.loads(text)
        if data.get("version") != SNAPSHOT_VERSION or len(data.get("levels", [])) != DEPTHS:
            raise ValueError("not a profile of version 2 with eight levels")
        return cls(tuple(tuple(int(x) for x in level["spatial"]) for level in data["levels"]))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls.from_json(spark.read.text(path).limit(1).first()[0])


def _walsh(v: tuple[int, ...]) -> list[int]:
    return [sum(-x if (k & j).bit_count() % 2 else x for j, x in enumerate(v)) for k in range(SIZE)]


def compare_level(probe: Column, trained: tuple[int, ...]) -> Column:
    """(bonded, missed, total, long_misses, walk) of one depth's counts against the trained ones."""
    total = sum(trained)
    spectrum = _walsh(trained)
    nothing = F.struct(F.lit(0).alias("bonded"), F.lit(8).alias("missed"), F.lit(8).alias("total"), F.lit(0).alias("long_misses"), F.lit(8.0).alias("walk"))
    if total == 0:
        return nothing

    def of(x: Column) -> Column:
        p, w = x["p"], x["w"]
        n = at(w, 0)
        hit = []
        for c, t in enumerate(trained):
            own = at(p, c)
            hit.append((own > 0) & (2 * own * total >= t * n) & (own * total <= 2 * t * n) if t else F.lit(False))
        bonded = sum((h.cast("int") for h in hit[1:]), hit[0].cast("int"))
        walk = F.lit(0.0)
        for k in range(1, SIZE):
            walk = walk + F.abs(F.lit(spectrum[k] / spectrum[0]) - at(w, k) / n)
        long = (~hit[3]).cast("int") + (~hit[4]).cast("int")
        full = F.struct(bonded.alias("bonded"), (8 - bonded).alias("missed"), F.lit(8).alias("total"), long.alias("long_misses"), (walk / 7.0).alias("walk"))
        return F.when(n > 0, full).otherwise(nothing)

    return bind(F.struct(probe.alias("p"), walsh(probe).alias("w")), of)


def passes(levels: Column, model: Model, least: int = LEAST_TOKENS) -> Column:
    """Array of (pass, bonded, missed, total, long_misses, walk) of the depths with enough tokens, the finest first."""
    def one(i: int) -> Column:
        counts = at(levels, DEPTHS - 1 - i)
        enough = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x) >= least
        stats = compare_level(counts, model.spatial[DEPTHS - 1 - i])
        return F.when(enough, bind(stats, lambda s: F.struct(F.lit(i).alias("pass"), s["bonded"].alias("bonded"), s["missed"].alias("missed"), s["total"].alias("total"), s["long_misses"].alias("long_misses"), s["walk"].alias("walk"))))

    return F.filter(F.array(*[one(i) for i in range(DEPTHS)]), lambda x: x.isNotNull())


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))


def score(stats: Column, leaf: Column) -> Column:
    """The verdict of the four voters: human, confidence, deep_walk, long_miss_rate, pass_hits, label."""
    def of(x: Column) -> Column:
        used, leaf = x["s"], x["leaf"]
        n = F.size(used)
        walk_b, bond_b = F.array(*map(F.lit, WALK_BOUNDARY)), F.array(*map(F.lit, BOND_BOUNDARY))

        def walk_vote(s: Column) -> Column:
            b = F.get(walk_b, s["pass"])
            return (s["walk"] - b) / b

        def bond_vote(s: Column) -> Column:
            b = F.get(bond_b, s["pass"])
            return (b - s["bonded"] / F.lit(8.0)) / b

        some = n > 0
        walk = F.when(some, _sum(used, walk_vote) / n).otherwise(0.0)
        bond = F.when(some, _sum(used, bond_vote) / n).otherwise(0.0)
        missed, long = _sum(used, lambda s: s["missed"].cast("double")), _sum(used, lambda s: s["long_misses"].cast("double"))
        rate = F.when(missed > 0, long / missed).otherwise(0.0)
        tokens = F.aggregate(leaf, F.lit(0).cast("bigint"), lambda a, y: a + y)
        punct = F.when(tokens > 0, at(leaf, 5) / tokens).otherwise(0.0)
        combined = WALK_WEIGHT * walk + BOND_WEIGHT * bond + PUNCT_WEIGHT * ((PUNCT_BOUNDARY - punct) / PUNCT_BOUNDARY) + MISS_WEIGHT * ((rate - MISS_BOUNDARY) / MISS_BOUNDARY)
        return bind(
            F.struct(combined.alias("combined"), F.when(some, _sum(used, lambda s: s["walk"]) / n).otherwise(0.0).alias("deep_walk"), rate.alias("rate"), punct.alias("punct"), used.alias("used")),
            named,
        )

    def named(x: Column) -> Column:
        human, sure = x["combined"] < 0, F.least(F.lit(1.0), F.abs(x["combined"]) * 3)
        return F.struct(
            human.alias("human"), sure.alias("confidence"), x["deep_walk"].alias("deep_walk"), x["rate"].alias("long_miss_rate"),
            F.concat(F.transform(x["used"], lambda s: s["bonded"] / F.lit(8.0)), F.array_repeat(F.lit(0.0), F.lit(DEPTHS) - F.size(x["used"]))).alias("pass_hits"), x["punct"].alias("punct_ratio"), verdict_label(human, sure).alias("label"),
        )

    return bind(F.struct(stats.alias("s"), leaf.alias("leaf")), of)


def verdict_label(human: Column, confidence: Column) -> Column:
    """``HUMAN (63%)`` or ``AI (63%)``, halves rounded to even."""
    percent = F.bround(confidence * 100, 0).cast("int").cast("string")
    return F.concat(F.when(human, "HUMAN (").otherwise("AI ("), percent, F.lit("%)"))


def legacy_score(stats: Column) -> Column:
    """The older rule: the mean vote of walk (a sum over channels) and long misses of the last pass only."""
    def of(last: Column) -> Column:
        walk = F.when(last["total"] > 0, last["walk"] / last["total"]).otherwise(0.0)
        rate = F.when(last["missed"] > 0, last["long_misses"] / last["missed"]).otherwise(0.0)
        vote = ((walk - LEGACY_WALK_BOUNDARY) / LEGACY_WALK_BOUNDARY + (rate - LEGACY_MISS_BOUNDARY) / LEGACY_MISS_BOUNDARY) / 2
        return bind(vote, lambda v: F.struct((v < 0).alias("human"), F.least(F.lit(1.0), F.abs(v) * 3).alias("confidence")))

    return F.when(F.size(stats) > 0, bind(F.get(stats, F.size(stats) - 1), of))


def manipulation_score(root: Column, model: Model) -> Column:
    """0 up to a bond rate of 0.67 at the root, then rising to 1 at 0.80."""
    rate = compare_level(root, model.spatial[0])["bonded"] / F.lit(8.0)
    return F.when(rate <= TROLL_START, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (rate - TROLL_START) / TROLL_SPAN)))


def probe_channel(counts: Column, channel: Column) -> Column:
    """(bonded, distance) of one channel of a depth's counts."""
    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
        own = F.get(c, F.when((channel >= 0) & (channel < SIZE), channel))
        none = F.coalesce((total == 0) | (own == 0) | own.isNull(), F.lit(True))
        eighth, sixteenth = F.greatest(F.lit(1), F.floor(total / 8)), F.greatest(F.lit(1), F.floor(total / 16))
        return F.struct(F.when(none, False).otherwise(own >= sixteenth).alias("bonded"), F.when(none, 8).otherwise(F.abs(own - eighth)).cast("bigint").alias("distance"))

    return bind(counts, of)


def probe_levels(text: Column, window: int | None = WINDOW, chunk_bytes: int | None = CHUNK_BYTES) -> Column:
    """Counts at each depth of the first ``window`` tokens of a text on its own."""
    return bind(channels(text, chunk_bytes, window), lambda s: level_counts(s, F.lit(0).cast("bigint")))


def detect(docs: DataFrame, text: str, model: Model, window: int | None = WINDOW, troll: Model | None = None, troll_window: int | None = None, chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``verdict``: human, confidence, deep_walk, long_miss_rate, pass_hits, punct_ratio, label[, troll_score, troll_label].

    ``troll_window`` defaults to ``window``. A null text is scored as an empty one. Spread the
    documents over enough partitions before (one Parquet file may be one task).
    """
    levels = probe_levels(F.col(text), window, chunk_bytes)
    verdict = bind(levels, lambda x: score(passes(x, model), at(x, DEPTHS - 1)))
    if troll is None:
        return docs.withColumn("verdict", verdict)
    if troll_window is not None and troll_window != window:
        points = bind(probe_levels(F.col(text), troll_window or None, chunk_bytes), lambda x: manipulation_score(at(x, 0), troll))
        with_score = bind(F.struct(verdict.alias("v"), points.alias("t")), _with_troll)
    else:
        with_score = bind(bind(levels, lambda x: F.struct(score(passes(x, model), at(x, DEPTHS - 1)).alias("v"), manipulation_score(at(x, 0), troll).alias("t"))), _with_troll)
    return docs.withColumn("verdict", with_score)


def _with_troll(x: Column) -> Column:
    v, t = x["v"], x["t"]
    label = F.when(t > 0, F.concat(F.lit("MANIPULATION ("), F.bround(t * 100, 0).cast("int").cast("string"), F.lit("%)"))).otherwise("")
    names = ["human", "confidence", "deep_walk", "long_miss_rate", "pass_hits", "punct_ratio", "label"]
    return F.struct(*[v[n].alias(n) for n in names], t.alias("troll_score"), label.alias("troll_label"))


def triggered(verdict: Column, threshold: float = 0.5, troll_threshold: float = 0.05) -> Column:
    """Whether a verdict is worth a reply."""
    return (~verdict["human"] & (verdict["confidence"] >= threshold)) | ((verdict["troll_score"] >= troll_threshold) & (verdict["troll_label"] != ""))


def verdict_text(verdict: Column) -> Column:
    """The verdict in lines of text; the display limits 0.120 and 0.18 differ from those of the score."""
    def percent(x: Column) -> Column:
        return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))

    def limit(x: Column, most: float) -> Column:
        return F.when(x <= most, " (human range)").otherwise(" (AI range)")

    # The format of the report.
    some = verdict["troll_label"] != ""
    return F.concat(
        F.lit("verdict: "), verdict["label"], F.when(some, F.concat(F.lit(" | "), verdict["troll_label"])).otherwise(""), F.lit("\n"),
        F.lit("  deep walk avg:    "), fixed(verdict["deep_walk"], 4), limit(verdict["deep_walk"], 0.120), F.lit("\n"),
        F.lit("  long-miss rate:   "), F.concat(fixed(verdict["long_miss_rate"] * 100, 1), F.lit("%")), limit(verdict["long_miss_rate"], 0.18), F.lit("\n"),
        F.lit("  pass hit rates:  "), F.array_join(F.transform(verdict["pass_hits"], percent), " \u2192 "), F.lit("\n"),
        F.when(some, F.concat(F.lit("  troll match:     "), fixed(verdict["troll_score"] * 100, 1), F.lit("%\n"))).otherwise(""),
    )


def replies(judged: DataFrame, hint: str, topics: list[str], troll_topic: str, extra: Column | None = None) -> DataFrame:
    """(kind, tags, content) of the note that answers each judged event (``id``, ``pubkey``, ``verdict``): rows for a table; nothing is signed or sent.

    Tags: the event as the one replied to, with ``hint`` as its relay; its author; the topics, and one more where manipulation was found.
    """
    pair = lambda *x: F.array(*[F.lit(y) if isinstance(y, str) else y for y in x])
    fixed_tags = F.array(pair("e", F.col("id"), hint, "reply"), pair("p", F.col("pubkey")), *[pair("t", t) for t in topics])
    none = F.array().cast("array<array<string>>")
    tags = F.concat(fixed_tags, F.when(F.col("verdict.troll_label") != "", F.array(pair("t", troll_topic))).otherwise(none))
    content = verdict_text(F.col("verdict"))
    return judged.select(F.lit(1).alias("kind"), tags.alias("tags"), (content if extra is None else F.concat(content, extra)).alias("content"))


def model_columns(model: Model) -> Column:
    """The model as an array column, for joins in SQL."""
    return F.array(*[longs(list(s)) for s in model.spatial])
