"""Queries over verdicts and profiles: reports as text, stored models, replies, single statistics of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens as tok
from .functions import vectors as vec
from .functions.arrays import bind
from .operators import detect as det
from .operators import profile as prof
from .operators import report as rep
from .registry import Registry
from .session import Scratch, load
from .sources import files
from .text_queries import _COUNTS, _LEVELS, _PROBE, _RHETORIC, _SCORED, _SPATIAL, TOKENS, _docs, _human, _some_text, _trained, _walsh_sql, train_model

REGISTRY = Registry()

# Verdicts by the profile of human text (500 tokens), and manipulation by that of rhetorical text (whole documents).
_BOTH = f"""{_trained("model IS NULL")}, {_PROBE.replace("WINDOW", "500")}, {_SCORED},
r_own AS (SELECT t.*, row_number() OVER (ORDER BY doc_id, pos) AS i FROM tok t JOIN documents USING (doc_id) WHERE source = 'longform' AND pos <= 50000),
r_root AS (SELECT {_COUNTS} FROM r_own WHERE i % 128 = 0),
p_root AS (SELECT d.doc_id, {", ".join(f"count(t.pos) FILTER (ch = {c}) AS p{c}" for c in range(8))} FROM documents d LEFT JOIN tok t ON t.doc_id = d.doc_id AND t.pos % 128 = 0 GROUP BY d.doc_id),
r_sum AS (SELECT doc_id, {", ".join(f"p{c}" for c in range(8))}, {", ".join(f"c{c}" for c in range(8))}, {"+".join(f"p{c}" for c in range(8))} AS pn, {"+".join(f"c{c}" for c in range(8))} AS tn FROM p_root, r_root),
troll AS (SELECT doc_id, CASE WHEN pn = 0 OR tn = 0 THEN 0 ELSE {"+".join(f"(c{c} > 0 AND p{c} > 0 AND 2 * p{c} * tn >= c{c} * pn AND p{c} * tn <= 2 * c{c} * pn)::INT" for c in range(8))} END / 8.0::DOUBLE AS bond FROM r_sum),
v AS (
  SELECT s.doc_id, d.model IS NULL AS is_human, coalesce(d.model, 'human') AS model, combined < 0 AS human, least(1.0::DOUBLE, 3 * abs(combined)) AS confidence, deep_walk, rate AS long_miss_rate,
    CASE WHEN bond <= 0.67 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bond - 0.67::DOUBLE) / 0.13::DOUBLE)) END AS troll_score, (d.doc_id % 7)::DOUBLE AS ms
  FROM scored s JOIN documents d USING (doc_id) JOIN troll USING (doc_id)),
known AS (SELECT * FROM v WHERE doc_id % 11 > 0),
one AS (
  SELECT *, hc * 100.0::DOUBLE / hn AS h_right, ad * 100.0::DOUBLE / an AS caught FROM (
    SELECT count(*) FILTER (is_human) AS hn, count(*) FILTER (is_human AND human) AS hc, count(*) FILTER (NOT is_human) AS an, count(*) FILTER (NOT is_human AND NOT human) AS ad,
      avg(deep_walk) FILTER (is_human) AS walk, avg(long_miss_rate) FILTER (is_human) AS miss, avg(troll_score) FILTER (is_human) AS troll, avg(ms) FILTER (is_human) AS ms FROM known)),
m AS (
  SELECT *, row_number() OVER (ORDER BY troll DESC, model) AS place FROM (
    SELECT model, count(*) AS n, count(*) FILTER (NOT human) AS d, avg(deep_walk) AS walk, avg(long_miss_rate) AS miss, avg(troll_score) AS troll FROM known WHERE NOT is_human GROUP BY model))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its verdict and manipulation score; each eleventh stands for one that could not be read, and the time is made up."""
    docs = _docs(spark, sf_dir)
    model = det.Model.from_rows(train_model(spark, sf_dir))
    troll = det.Model.from_rows(prof.train(docs.where("source = 'longform'"), "doc_id", "text", threshold=None))
    rows = docs.select("doc_id", F.col("model").isNull().alias("is_human"), F.coalesce("model", F.lit("human")).alias("model"), "text")
    v = det.detect(rows, "text", model, troll=troll, troll_window=0).select("doc_id", "is_human", "model", F.inline(F.array("verdict")))
    return v.withColumn("human", F.when(F.col("doc_id") % 11 > 0, F.col("human"))).withColumn("ms", (F.col("doc_id") % 7).cast("double"))


def _page_sql(parts: list[str]) -> str:
    """Numbered lines of parts, each a query of (o, i, line)."""
    each = " UNION ALL ".join(f"SELECT {k} AS part, o, i, line FROM ({p})" for k, p in enumerate(parts))
    return f"WITH {_BOTH} SELECT row_number() OVER (ORDER BY part, o, i) AS line_no, line FROM ({each})"


def _rows_sql(lines: list[str], source: str = "one", order: str = "''") -> str:
    """The lines of each row; a line is an SQL expression."""
    return f"SELECT {order} AS o, unnest(range({len(lines)})) AS i, unnest([{', '.join(lines)}]) AS line FROM {source}"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MARKDOWN = _page_sql([
    _rows_sql([_s(x) for x in ("# Detection Benchmark", "", "Deterministic detection of machine text.", "")]),
    _rows_sql([*map(_s, ("## Overall Accuracy", "", "| Metric | Value |", "|--------|-------|")), "printf('| Human correct (true negative) | %.1f%% |', h_right)", "printf('| AI detected (true positive) | %.1f%% |', caught)",
               "printf('| **Balanced accuracy** | **%.1f%%** |', (h_right + caught) / 2)", "''"]),
    _rows_sql([_s("## Human Text"), "''", "printf('- **%d** samples, **%.1f%%** correctly identified as human', hn, h_right)", "printf('- Avg deep walk: %.3f (boundary: multi-level)', walk)",
               "printf('- Avg long-miss rate: %.3f (boundary: multi-level)', miss)", "printf('- Avg detection time: %.0f ms/sample', ms)", "printf('- Avg manipulation score: %.1f%% (human baseline)', troll * 100)", "''"]),
    _rows_sql([*map(_s, ("## AI Detection by Model", "", "| Model | Detected | Rate | Avg Walk | Avg Miss | Manipulation |", "|-------|----------|------|----------|----------|-------------|"))]),
    _rows_sql(["printf('| %s | %d/%d | %.0f%% | %.3f | %.3f | %.1f%% |', model, d, n, d * 100.0::DOUBLE / n, walk, miss, troll * 100)"], "m", "model"),
    _rows_sql(["printf('| **Total** | **%d/%d** | **%.1f%%** | | | |', ad, an, caught)", "''"]),
    _rows_sql([*map(_s, ("## Manipulation Score Leaderboard", "", "Structural match against a manipulation/rhetoric lattice.", "Higher = more manipulation-like prosodic patterns.", "", "| Rank | Model | Score |", "|------|-------|-------|"))]),
    _rows_sql(["printf('| %d | %s | %.1f%% |', place, model, troll * 100)"], "m", "lpad(place::VARCHAR, 9, '0')"),
    _rows_sql(["printf('| -- | *human baseline* | *%.1f%%* |', troll * 100)"]), _rows_sql(["''"]), _rows_sql(["'---'"]),
])
_RULE, _BLANK = "║  " + "─" * 57 + "    ║", "║" + " " * 63 + "║"
_MIDDLE = "╠" + "═" * 63 + "╣"


def _head(text: str) -> str:
    return "║" + ("  " + text).ljust(63) + "║"


def _bar(sign: str) -> str:
    return f"repeat('{sign}', floor(troll * 20)::INT) || repeat(' ', (20 - floor(troll * 20))::INT)"


_BOX = _page_sql([
    _rows_sql([_s("╔" + "═" * 63 + "╗"), _s("║" + "DETECTION BENCHMARK REPORT".center(63) + "║"), _s(_MIDDLE)]),
    _rows_sql([*map(_s, (_BLANK, _head("HUMAN TEXT (known-human corpus)"), _RULE)), "printf('║  samples:         %-44d║', hn)", f"printf('║  correct (HUMAN): %-5d  (%.1f%%)', hc, h_right) || '{' ' * 31}║'",
               f"printf('║  false positive:  %-5d  (%.1f%% misclassified as AI)', hn - hc, 100 - h_right) || '{' ' * 14}║'", f"printf('║  avg deep walk:   %.3f  (boundary: multi-level)', walk) || '{' ' * 18}║'",
               f"printf('║  avg long-miss:   %.3f  (boundary: multi-level)', miss) || '{' ' * 18}║'", f"printf('║  avg time:        %.0f ms/sample', ms) || '{' ' * 30}║'", f"printf('║  avg troll score: %.3f', troll) || '{' ' * 38}║'"]),
    _rows_sql([*map(_s, (_BLANK, _head("MACHINE TEXT (by model)"), _RULE))]),
    _rows_sql(["printf('║  %-20s %2d/%-3d detected  (walk=%.3f miss=%.3f troll=%.1f%%)  ║', model, d, n, walk, miss, troll * 100)"], "m", "model"),
    _rows_sql([_s(_RULE), f"printf('║  TOTAL:            %3d/%-4d  (%.1f%%)', ad, an, caught) || '{' ' * 26}║'"]),
    _rows_sql([*map(_s, (_BLANK, _MIDDLE, _head("MANIPULATION SCORE LEADERBOARD"), _RULE))]),
    _rows_sql([f"printf('║  %-20s %.1f%% ', model, troll * 100) || {_bar('█')} || '║'"], "m", "lpad(place::VARCHAR, 9, '0')"),
    _rows_sql([f"printf('║  %-20s %.1f%% ', 'human', troll * 100) || {_bar('░')} || '(human baseline)  ║'"]),
    _rows_sql([*map(_s, (_BLANK, _MIDDLE, _head("COMBINED ACCURACY"), _RULE)), f"printf('║  human correct:   %5.1f%%  (true negative rate)', h_right) || '{' ' * 15}║'",
               f"printf('║  AI detected:     %5.1f%%  (true positive rate)', caught) || '{' ' * 15}║'", f"printf('║  balanced acc:    %5.1f%%', (h_right + caught) / 2) || '{' ' * 37}║'"]),
    _rows_sql([_s(_BLANK), _s("╚" + "═" * 63 + "╝")]),
])


@REGISTRY.add(_MARKDOWN)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy report in Markdown, line by line."""
    return rep.markdown_report(_judged(spark, sf_dir))


@REGISTRY.add(_BOX)
def box_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy report in a box, line by line."""
    return rep.box_report(_judged(spark, sf_dir))


@REGISTRY.add(f"""WITH {_BOTH} SELECT is_human, count(*) FILTER (doc_id % 11 > 0) AS n, count(*) FILTER (doc_id % 11 = 0) AS errors, count(*) FILTER (doc_id % 11 > 0 AND human) AS human,
  round(100.0::DOUBLE * count(*) FILTER (doc_id % 11 > 0 AND human) / count(*) FILTER (doc_id % 11 > 0), 4) AS accuracy, round(avg(confidence), 6) AS avg_confidence, round(avg(deep_walk), 6) AS avg_walk,
  round(avg(long_miss_rate), 6) AS avg_miss, round(avg(troll_score), 6) AS avg_troll, round(avg(ms), 6) AS avg_ms FROM v GROUP BY is_human""")
def side_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, manipulation and time of human and machine text."""
    return rep.group_stats(_judged(spark, sf_dir), "is_human")


@REGISTRY.add(f"""WITH {_BOTH} SELECT model, count(*) AS n, round(avg(troll_score), 6) AS avg_score, row_number() OVER (ORDER BY round(avg(troll_score), 6) DESC, model) AS place FROM known WHERE NOT is_human GROUP BY model""")
def troll_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine models by their mean manipulation score."""
    return rep.leaderboard(_judged(spark, sf_dir).where("not is_human and human is not null"), "model", "troll_score")


@REGISTRY.add(f"""WITH {_BOTH}, t AS (SELECT *, CASE WHEN troll_score > 0 THEN 'MANIPULATION (' || round_even(troll_score * 100, 0)::INT || '%)' ELSE '' END AS troll_label FROM v)
SELECT doc_id, CASE WHEN (NOT human AND confidence >= 0.5) OR (troll_score >= 0.05 AND troll_label <> '') THEN true ELSE false END AS is_triggered FROM t""")
def verdict_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents would be answered."""
    docs = _docs(spark, sf_dir)
    model = det.Model.from_rows(train_model(spark, sf_dir))
    troll = det.Model.from_rows(prof.train(docs.where("source = 'longform'"), "doc_id", "text", threshold=None))
    return det.detect(docs.select("doc_id", "text"), "text", model, troll=troll, troll_window=0).select("doc_id", F.coalesce(det.triggered(F.col("verdict")), F.lit(False)).alias("is_triggered"))


_LOG = f"""WITH {_BOTH} SELECT d.created_at AS "timestamp", v.doc_id::VARCHAR AS event_id, d.pubkey, v.human, printf('%.4f', confidence) AS confidence, printf('%.4f', deep_walk) AS deep_walk, printf('%.4f', long_miss_rate) AS long_miss, printf('%.4f', troll_score) AS troll_score,
  CASE WHEN v.human THEN 'HUMAN (' ELSE 'AI (' END || round_even(confidence * 100, 0)::INT || '%)' AS label, CASE WHEN troll_score > 0 THEN 'MANIPULATION (' || round_even(troll_score * 100, 0)::INT || '%)' ELSE '' END AS troll_label
FROM v JOIN documents d USING (doc_id)"""


@REGISTRY.add(_LOG)
def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of verdicts, written as CSV files and read again."""
    docs = _docs(spark, sf_dir)
    model = det.Model.from_rows(train_model(spark, sf_dir))
    troll = det.Model.from_rows(prof.train(docs.where("source = 'longform'"), "doc_id", "text", threshold=None))
    judged = det.detect(docs.select("created_at", F.col("doc_id").cast("string").alias("id"), "pubkey", "text"), "text", model, troll=troll, troll_window=0)
    path = Scratch(spark, "log").path("verdicts")
    files.write_crawl_csv(judged, path)
    schema = "timestamp bigint, event_id string, pubkey string, human boolean, confidence string, deep_walk string, long_miss string, troll_score string, label string, troll_label string"
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True).fillna("", ["troll_label"])


@REGISTRY.add(f"WITH {_trained('model IS NULL')} SELECT depth, {_SPATIAL} AS spatial FROM trained")
def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of human text after it was frozen, saved, loaded and thawed."""
    path = Scratch(spark, "model").path("profile")
    det.Model.from_rows(train_model(spark, sf_dir)).save(spark, path)
    model = det.Model.load(spark, path)
    return spark.createDataFrame([(d, list(s)) for d, s in enumerate(model.spatial)], "depth int, spatial array<bigint>")


_ZERO = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"


@REGISTRY.add(f"""WITH {_trained('model IS NULL')}, asked(depth) AS (VALUES (0), (7), (-1), (8))
SELECT asked.depth, coalesce({_SPATIAL.replace("c", "t.c")}, {_ZERO}) AS spatial, coalesce(t.c0 + t.c1 + t.c2 + t.c3 + t.c4 + t.c5 + t.c6 + t.c7, 0)::BIGINT AS total, CASE WHEN t.depth IS NULL THEN {_ZERO} ELSE [{", ".join(_walsh_sql("t.c"))}] END AS walsh
FROM asked LEFT JOIN trained t USING (depth)""".replace(f"coalesce({_SPATIAL.replace('c', 't.c')}, {_ZERO})", f"CASE WHEN t.depth IS NULL THEN {_ZERO} ELSE {_SPATIAL.replace('c', 't.c')} END"))
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of single depths of the profile of human text, two of which do not exist."""
    levels = prof.train(_human(spark, sf_dir), "doc_id", "text", threshold=None)
    return prof.stats_at(levels, [0, 7, -1, 8]).select("depth", "spatial", "total", "walsh")


@REGISTRY.add(f"""WITH {_trained('model IS NULL')} SELECT (SELECT c0+c1+c2+c3+c4+c5+c6+c7 FROM trained WHERE depth = 7) AS token_count, (SELECT [{", ".join(_walsh_sql("c"))}] FROM trained WHERE depth = 0) AS root_walsh,
  (SELECT {_SPATIAL} FROM trained WHERE depth = 7) AS leaf, false AS converged""")
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the profile of human text."""
    return prof.health(prof.train(_human(spark, sf_dir), "doc_id", "text", threshold=None), F.lit(False))


@REGISTRY.add(f"WITH {TOKENS}, c AS (SELECT doc_id, {_COUNTS} FROM tok GROUP BY doc_id) SELECT doc_id, {_SPATIAL} AS counts FROM c")
def walsh_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts, transformed twice and divided by eight."""
    counts = _some_text(_docs(spark, sf_dir)).select("doc_id", prof.pick_counts(tok.channels(F.col("text"))).alias("c"))
    return counts.select("doc_id", F.transform(vec.walsh(vec.walsh(F.col("c"))), lambda x: F.call_function("div", x, F.lit(8))).alias("counts"))


@REGISTRY.add(f"""WITH {TOKENS}, {_LEVELS}, k AS (SELECT doc_id, depth::INT AS depth, unnest(range(-1, 9))::INT AS channel, {_SPATIAL} AS c FROM levels),
s AS (SELECT *, list_sum(c)::BIGINT AS n, CASE WHEN channel BETWEEN 0 AND 7 THEN c[channel + 1] ELSE 0 END AS own FROM k)
SELECT doc_id, depth, channel, own > 0 AND own >= greatest(1, n // 16) AS bonded, CASE WHEN own = 0 THEN 8 ELSE abs(own - greatest(1, n // 8)) END::BIGINT AS distance FROM s""")
def channel_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each channel of each depth of each document is bonded, with two channels that are none."""
    levels = _some_text(_docs(spark, sf_dir)).select("doc_id", F.posexplode(det.probe_levels(F.col("text"), None)).alias("depth", "c")).where(vec.total(F.col("c")) > 0)
    each = levels.select("doc_id", "depth", "c", F.explode(F.sequence(F.lit(-1), F.lit(8))).alias("channel"))
    return each.select("doc_id", "depth", "channel", det.probe_channel(F.col("c"), F.col("channel")).alias("p")).select("doc_id", "depth", "channel", "p.bonded", "p.distance")


@REGISTRY.add(f"""WITH {_trained('model IS NULL')}, {_PROBE.replace('WINDOW', '500')},
last AS (SELECT * FROM cmp WHERE pn >= 32 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1),
vote AS (SELECT doc_id, ((walk / 8.0::DOUBLE - 0.110::DOUBLE) / 0.110::DOUBLE + (CASE WHEN bonded < 8 THEN long_misses::DOUBLE / (8 - bonded) ELSE 0 END - 0.18::DOUBLE) / 0.18::DOUBLE) / 2 AS v FROM last)
SELECT d.doc_id, v < 0 AS human, CASE WHEN v IS NOT NULL THEN round(least(1.0::DOUBLE, 3 * abs(v)), 6) END AS confidence FROM documents d LEFT JOIN vote USING (doc_id)""")
def legacy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older verdict on every document; null where there are too few tokens."""
    model = det.Model.from_rows(train_model(spark, sf_dir))
    judged = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(bind(det.probe_levels(F.col("text")), lambda x: bind(det.passes(x, model), det.legacy_score)))).alias("v"))
    return judged.select("doc_id", "v.human", F.round("v.confidence", 6).alias("confidence"))


@REGISTRY.add(f"""WITH {_BOTH} SELECT doc_id, [['e', doc_id::VARCHAR, 'wss://relay.example', 'reply'], ['p', pubkey], ['t', 'ai-detection']] || CASE WHEN troll_score > 0 THEN [['t', 'troll-detection']] ELSE [] END AS tags
FROM v JOIN documents d USING (doc_id) WHERE pubkey IS NOT NULL""")
def reply_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of the note that would answer each document."""
    docs = _docs(spark, sf_dir).where("pubkey is not null")
    model = det.Model.from_rows(train_model(spark, sf_dir))
    troll = det.Model.from_rows(prof.train(_docs(spark, sf_dir).where("source = 'longform'"), "doc_id", "text", threshold=None))
    judged = det.detect(docs.select(F.col("doc_id").cast("string").alias("id"), "pubkey", "text"), "text", model, troll=troll, troll_window=0)
    notes = det.replies(judged, "wss://relay.example", ["ai-detection"], "troll-detection")
    return notes.select(F.get(F.get("tags", F.lit(0)), F.lit(1)).cast("bigint").alias("doc_id"), "tags")


_PASSES = "list_transform(range(8), lambda i: round_even(coalesce(h[i + 1], 0) * 100, 0)::INT || '%')"


@REGISTRY.add(f"""WITH {_trained('model IS NULL')}, {_PROBE.replace('WINDOW', '500')}, {_SCORED},
hit_rates AS (SELECT doc_id, list(bonded / 8.0::DOUBLE ORDER BY depth DESC) AS h FROM used GROUP BY doc_id),
x AS (SELECT s.*, coalesce(h, []) AS h, least(1.0::DOUBLE, 3 * abs(combined)) AS sure FROM scored s LEFT JOIN hit_rates USING (doc_id))
SELECT doc_id, 'verdict: ' || CASE WHEN combined < 0 THEN 'HUMAN (' ELSE 'AI (' END || round_even(sure * 100, 0)::INT || '%)' || chr(10)
  || printf('  deep walk avg:    %.4f', deep_walk) || CASE WHEN deep_walk <= 0.120 THEN ' (human range)' ELSE ' (AI range)' END || chr(10)
  || printf('  long-miss rate:   %.1f%%', rate * 100) || CASE WHEN rate <= 0.18 THEN ' (human range)' ELSE ' (AI range)' END || chr(10)
  || '  pass hit rates:  ' || array_to_string({_PASSES}, ' → ') || chr(10) AS report FROM x""")
def verdict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document as text; a window of 500 tokens never has a manipulation score."""
    model = det.Model.from_rows(train_model(spark, sf_dir))
    return det.detect(_docs(spark, sf_dir).select("doc_id", "text"), "text", model, troll=model).select("doc_id", det.verdict_text(F.col("verdict")).alias("report"))


@REGISTRY.add("""WITH v AS (SELECT is_human, model, human FROM (SELECT true AS is_human, 'human' AS model, human FROM crawl_csv WHERE label IS NOT NULL UNION ALL SELECT false, coalesce(troll_label, ''), human FROM crawl_csv WHERE label IS NULL
  UNION ALL SELECT false, model, NULL FROM raid_csv WHERE model <> 'human'))
SELECT is_human, model, count(*) AS n, count(human) AS judged FROM v GROUP BY ALL""")
def group_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged verdicts of two kinds, which stand for human text and one group of machine text, and samples that have none yet, as one bag."""
    logged = load(spark, sf_dir, "crawl_csv").select("human", "label", F.coalesce("troll_label", F.lit("")).alias("model"))
    samples = load(spark, sf_dir, "raid_csv").where("model <> 'human'").select("model")
    bag = rep.together(logged.where("label is not null"), logged.where("label is null"), samples)
    return bag.groupBy("is_human", "model").agg(F.count("*").alias("n"), F.count("human").alias("judged"))
