"""Queries over documents: tokens, channels, profiles, verdicts and reports.

The corpus of human text is the documents without a ``model``; those of the source ``longform`` stand for rhetorical text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens as tok
from .functions import vectors as vec
from .operators import detect as det
from .operators import profile as prof
from .operators.report import balanced, by_model
from .plans.skew import spread
from .registry import Registry
from .session import load

REGISTRY = Registry()

_PAT = "(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|AA|B5|BA|C[0-9A-F]|D[0-689A-F]|E[0-9A-F]|F[0-689A-F])+|(?:09|0A|0B|0C|0D|20|85|A0)+|.."
_SEQ = "(?:C[2-9A-F]|D[0-689A-F]) (?:AA|B5|BA) |E[0-9A-CEF] (?:AA|B5|BA) (?:AA|B5|BA) |F[0-3] (?:AA|B5|BA) (?:AA|B5|BA) (?:AA|B5|BA) "
#: Every token of every document with its place and channel.
TOKENS = f"""
hexed AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, i, regexp_extract_all(substr(h, i * 8192 + 1, 8192), '{_PAT}') AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(0, (length(h) // 2 - 1) // 4096) + 1)) AS i FROM hexed)),
each AS (SELECT doc_id, i, unnest(range(len(w))) AS j, unnest(w) AS t FROM piece),
sized AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos, t, substr(t, 1, 2) AS b,
    length(regexp_replace(regexp_replace(t, '(..)', '\\1 ', 'g'), '{_SEQ}', 'xx ', 'g')) // 3 AS n,
    replace(regexp_extract(regexp_replace(t, '(..)', '\\1 ', 'g'), '^(?:{_SEQ})'), ' ', '') AS head
  FROM each),
tok AS MATERIALIZED (
  SELECT doc_id, pos, t, CASE WHEN b IN ('09', '0A', '0B', '0C', '0D', '20') THEN 6
    WHEN regexp_matches(b, '^(3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$') OR (head <> '' AND regexp_matches(decode(unhex(head)), '^[\\p{{L}}\\p{{Nd}}]'))
    THEN CASE WHEN n <= 1 THEN 0 WHEN n <= 3 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 8 THEN 3 ELSE 4 END ELSE 5 END AS ch
  FROM sized)"""
_COUNTS = ", ".join(f"count(*) FILTER (ch = {c}) AS c{c}" for c in range(8))
_NAMED = ", ".join(f"count(*) FILTER (ch = {c}) AS {n}" for c, n in enumerate(tok.CHANNELS))


def _walsh_sql(prefix: str) -> list[str]:
    return ["".join(("-" if (k & j).bit_count() % 2 else "+") + f"{prefix}{j}" for j in range(8)) for k in range(8)]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"))


def _some_text(docs: DataFrame) -> DataFrame:
    """Documents with any token: every byte belongs to one. A filter on counts would make the scan count them twice."""
    return docs.where("octet_length(text) > 0")


@REGISTRY.add(f"WITH {TOKENS} SELECT doc_id, {_NAMED} FROM tok GROUP BY doc_id")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each channel of each document with any token."""
    counts = _some_text(_docs(spark, sf_dir)).select("doc_id", prof.pick_counts(tok.channels(F.col("text"))).alias("c"))
    return counts.select("doc_id", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(tok.CHANNELS)])


@REGISTRY.add(f"""WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, round(avg((ch = 5)::INT), 6) AS punct_ratio, round(avg((ch IN (3, 4))::INT), 6) AS long_word_ratio
FROM tok WHERE pos <= 500 GROUP BY doc_id""")
def token_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the first 500 tokens."""
    counts = _some_text(_docs(spark, sf_dir)).select("doc_id", prof.pick_counts(tok.channels(F.col("text"), most=500)).alias("c"))
    n = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    c = [F.get("c", F.lit(i)) for i in range(8)]
    return counts.withColumn("n_tokens", n).select("doc_id", "n_tokens", F.round(c[5] / F.col("n_tokens"), 6).alias("punct_ratio"), F.round((c[3] + c[4]) / F.col("n_tokens"), 6).alias("long_word_ratio"))


@REGISTRY.add(f"""WITH {TOKENS} SELECT t.t AS token_hex, CASE ch {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(tok.CHANNELS))} END AS tag, count(*) AS n
FROM tok t GROUP BY ALL""")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct token with its tag and how often it occurs."""
    each = _docs(spark, sf_dir).select(F.inline(tok.elements(F.col("text"))))
    return each.groupBy(F.hex(F.encode("value", "ISO-8859-1")).alias("token_hex"), "tag").agg(F.count("*").alias("n"))


_LEVELS = f"""levels AS (
  SELECT doc_id, d AS depth, {_COUNTS} FROM tok, range(8) r(d) WHERE pos % (1 << (7 - d)::INT) = 0 GROUP BY doc_id, d)"""


@REGISTRY.add(f"WITH {TOKENS}, {_LEVELS} SELECT doc_id, depth::INT AS depth, {', '.join(f'c{c}' for c in range(8))} FROM levels")
def multiscale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document on its own at each depth with any token."""
    levels = _docs(spark, sf_dir).select("doc_id", F.posexplode(det.probe_levels(F.col("text"), None)).alias("depth", "c"))
    out = levels.where(vec.total(F.col("c")) > 0)
    return out.select("doc_id", "depth", *[F.get("c", F.lit(i)).alias(f"c{i}") for i in range(8)])


@REGISTRY.add(f"""WITH {TOKENS}, c AS (SELECT doc_id, {_COUNTS} FROM tok GROUP BY doc_id)
SELECT doc_id, {", ".join(f"{e} AS k{k}" for k, e in enumerate(_walsh_sql("c")))}, {"+".join(f"abs({e})" for e in _walsh_sql("c")[1:])} AS detail FROM c""")
def walsh_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum of each document's counts, and its detail."""
    w = _some_text(_docs(spark, sf_dir)).select("doc_id", vec.walsh(prof.pick_counts(tok.channels(F.col("text")))).alias("w"))
    return w.select("doc_id", *[F.get("w", F.lit(k)).alias(f"k{k}") for k in range(8)], vec.detail_energy(F.col("w")).alias("detail"))


def _trained(where: str) -> str:
    """Counts by depth of the documents that meet a condition, in the order of doc_id, 50,000 tokens of each."""
    return f"""{TOKENS},
own AS (SELECT t.*, row_number() OVER (ORDER BY doc_id, pos) AS i FROM tok t JOIN documents USING (doc_id) WHERE ({where}) AND pos <= 50000),
trained AS (SELECT d::INT AS depth, {_COUNTS} FROM own, range(8) r(d) WHERE i % (1 << (7 - d)::INT) = 0 GROUP BY d)"""


_SPATIAL = "[" + ", ".join(f"c{c}" for c in range(8)) + "]"


def _human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("model is null")


@REGISTRY.add(f"WITH {_trained('model IS NULL')} SELECT depth, {_SPATIAL} AS spatial, [{', '.join(_walsh_sql('c'))}] AS walsh, {'+'.join(f'c{c}' for c in range(8))} AS total FROM trained")
def train_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of all human text."""
    return prof.train(_human(spark, sf_dir), "doc_id", "text", threshold=None).select("depth", "spatial", "walsh", "total")


@REGISTRY.add(f"""WITH {TOKENS}, n AS (SELECT doc_id, least(count(*), 50000) AS n FROM tok JOIN documents USING (doc_id) WHERE model IS NULL GROUP BY doc_id)
SELECT doc_id AS file, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS "offset" FROM n""")
def train_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens before each document of the corpus."""
    return prof.with_offsets(prof.document_counts(_human(spark, sf_dir), "doc_id", "text")).where("size > 0").select("file", "offset")


_RUN = ", ".join(f"sum(r{c}) OVER w AS s{c}" for c in range(8))
_CONVERGENCE = f"""{_trained("model IS NULL")},
root AS (SELECT d.doc_id AS file, {", ".join(f"count(o.i) FILTER (ch = {c}) AS r{c}" for c in range(8))}
  FROM documents d LEFT JOIN own o ON o.doc_id = d.doc_id AND o.i % 128 = 0 WHERE d.model IS NULL GROUP BY d.doc_id),
run AS (SELECT file, {_RUN} FROM root WINDOW w AS (ORDER BY file ROWS UNBOUNDED PRECEDING)),
spec AS (SELECT file, {", ".join(f"({e})::HUGEINT AS k{k}" for k, e in enumerate(_walsh_sql("s")))} FROM run),
pair AS (SELECT *, row_number() OVER w AS rn, {", ".join(f"lag(k{k}) OVER w AS p{k}" for k in range(8))} FROM spec WINDOW w AS (ORDER BY file)),
fit AS (SELECT file, rn, CASE WHEN rn = 1 THEN NULL WHEN k0 > 0 AND p0 > 0 AND k0 * p0 // 1000 > 0
  AND greatest({", ".join(f"abs(k{k} * p0 - p{k} * k0)" for k in range(8))}) // (k0 * p0 // 1000) <= 100 THEN 1 ELSE 0 END AS ok FROM pair),
shape AS (SELECT file, rn >= 8 AND coalesce(min(ok) OVER (ORDER BY file ROWS 14 PRECEDING) = 1, false) AS converged FROM fit)"""


@REGISTRY.add(f"WITH {_CONVERGENCE} SELECT file, converged FROM shape")
def convergence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the root's shape has converged after each document."""
    placed = prof.with_offsets(prof.document_counts(_human(spark, sf_dir), "doc_id", "text"))
    return prof.convergence(prof.with_levels(placed)).select("file", "converged")


@REGISTRY.add(f"""WITH {_CONVERGENCE}, early AS (SELECT * FROM own WHERE doc_id <= (SELECT coalesce(min(file) FILTER (converged), 1 << 60) FROM shape))
SELECT d::INT AS depth, [{", ".join(f"count(*) FILTER (ch = {c})" for c in range(8))}] AS spatial FROM early, range(8) r(d) WHERE i % (1 << (7 - d)::INT) = 0 GROUP BY d""")
def train_until_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the human text up to convergence."""
    return prof.train(_human(spark, sf_dir), "doc_id", "text").where("total > 0").select("depth", "spatial")


_FINGER = f"""WITH {TOKENS},
named AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL),
few AS (SELECT doc_id, pos, ch FROM tok WHERE pos <= 50000),
n AS (SELECT s.doc_id, source, count(t.pos) AS n FROM named s LEFT JOIN few t USING (doc_id) GROUP BY ALL),
extra AS (SELECT doc_id, source, n + unnest(range(1, greatest(1, 3 * n // 100) + 1)) AS pos, 7 AS ch FROM n),
own AS (
  SELECT source, ch, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS i
  FROM (SELECT doc_id, source, pos, ch FROM few JOIN named USING (doc_id) UNION ALL SELECT doc_id, source, pos, ch FROM extra))"""


@REGISTRY.add(f"""{_FINGER}
SELECT source, d::INT AS depth, [{", ".join(f"count(*) FILTER (ch = {c})" for c in range(8))}] AS spatial FROM own, range(8) r(d) WHERE i % (1 << (7 - d)::INT) = 0 GROUP BY source, d""")
def fingerprint_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each source with its origin tokens."""
    return prof.fingerprint(_docs(spark, sf_dir), "source", "doc_id", "text").where("total > 0").select("source", "depth", "spatial")


@REGISTRY.add(f"""{_FINGER}, root AS (SELECT source, {_COUNTS} FROM own WHERE i % 128 = 0 GROUP BY source),
more AS (SELECT source, count(*) AS origin_tokens FROM extra GROUP BY source)
SELECT source, CASE WHEN c0 IS NOT NULL THEN round(({"+".join(f"abs({e})" for e in _walsh_sql("c")[1:])})::DOUBLE / nullif(abs({_walsh_sql("c")[0]}) + {"+".join(f"abs({e})" for e in _walsh_sql("c")[1:])}, 0), 6) END AS balance, origin_tokens
FROM more LEFT JOIN root USING (source)""")
def balance_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of each source's spectrum at the root."""
    levels = prof.fingerprint(_docs(spark, sf_dir), "source", "doc_id", "text").where("depth = 0")
    return levels.select("source", F.round(prof.balance(F.col("walsh")), 6).alias("balance"), "origin_tokens")


_PROBE = f"""
probe AS (SELECT d.doc_id, r.d::INT AS depth, {", ".join(f"count(t.pos) FILTER (ch = {c}) AS p{c}" for c in range(8))}
  FROM documents d CROSS JOIN range(8) r(d) LEFT JOIN tok t ON t.doc_id = d.doc_id AND t.pos <= WINDOW AND t.pos % (1 << (7 - r.d)::INT) = 0 GROUP BY ALL),
both_ AS (
  SELECT doc_id, depth, {", ".join(f"p{c}" for c in range(8))}, {", ".join(f"coalesce(c{c}, 0) AS t{c}" for c in range(8))}, {"+".join(f"p{c}" for c in range(8))} AS pn, {"+".join(f"coalesce(c{c}, 0)" for c in range(8))} AS tn
  FROM probe LEFT JOIN trained USING (depth)),
hits AS (SELECT *, {", ".join(f"(t{c} > 0 AND p{c} > 0 AND 2 * p{c} * tn >= t{c} * pn AND p{c} * tn <= 2 * t{c} * pn)::INT AS h{c}" for c in range(8))} FROM both_),
cmp AS (
  SELECT doc_id, depth, pn, p5, CASE WHEN tn = 0 OR pn = 0 THEN 0 ELSE {"+".join(f"h{c}" for c in range(8))} END AS bonded,
    CASE WHEN tn = 0 OR pn = 0 THEN 0 ELSE 2 - h3 - h4 END AS long_misses,
    CASE WHEN tn = 0 OR pn = 0 THEN 8.0 ELSE ({"+".join(f"abs(({a})::DOUBLE / nullif(tn, 0) - ({b})::DOUBLE / nullif(pn, 0))" for a, b in list(zip(_walsh_sql("t"), _walsh_sql("p")))[1:])}) / 7.0 END AS walk
  FROM hits)"""


@REGISTRY.add(f"WITH {_trained('model IS NULL')}, {_PROBE.replace('WINDOW', '500')} SELECT doc_id, depth, bonded, 8 - bonded AS missed, long_misses, round(walk, 6) AS walk FROM cmp")
def compare_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first 500 tokens against the profile of human text, at each depth."""
    model = det.Model.from_rows(train_model(spark, sf_dir))
    levels = _docs(spark, sf_dir).select("doc_id", det.probe_levels(F.col("text")).alias("levels"))
    stats = F.array(*[F.struct(F.lit(d).alias("depth"), det.compare_level(F.get("levels", F.lit(d)), model.spatial[d]).alias("s")) for d in range(8)])
    each = levels.select("doc_id", F.inline(stats)).select("doc_id", "depth", "s.bonded", "s.missed", "s.long_misses", F.round("s.walk", 6).alias("walk"))
    return each


_CASES = lambda values: "CASE depth " + " ".join(f"WHEN {7 - i} THEN {v}" for i, v in enumerate(values)) + " END"
_SCORED = f"""
used AS (SELECT *, {_CASES(det.WALK_BOUNDARY)}::DOUBLE AS wb, {_CASES(det.BOND_BOUNDARY)}::DOUBLE AS bb FROM cmp WHERE pn >= 32),
votes AS (
  SELECT doc_id, count(*) AS n_levels, avg((walk - wb) / wb) AS wv, avg((bb - bonded / 8.0::DOUBLE) / bb) AS bv, avg(walk) AS deep_walk,
    coalesce(sum(long_misses)::DOUBLE / nullif(sum(8 - bonded), 0), 0) AS rate FROM used GROUP BY doc_id),
leaf AS (SELECT doc_id, coalesce(p5::DOUBLE / nullif(pn, 0), 0) AS punct FROM cmp WHERE depth = 7),
scored AS (
  SELECT doc_id, coalesce(n_levels, 0) AS n_levels, coalesce(deep_walk, 0) AS deep_walk, coalesce(rate, 0) AS rate, punct,
    0.20::DOUBLE * coalesce(wv, 0) + 0.20::DOUBLE * coalesce(bv, 0) + 0.55::DOUBLE * ((0.080::DOUBLE - punct) / 0.080::DOUBLE) + 0.05::DOUBLE * ((coalesce(rate, 0) - 0.11::DOUBLE) / 0.11::DOUBLE) AS combined
  FROM leaf LEFT JOIN votes USING (doc_id))"""
_VERDICTS = f"{_trained('model IS NULL')}, {_PROBE.replace('WINDOW', '500')}, {_SCORED}"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = det.Model.from_rows(train_model(spark, sf_dir))
    return det.detect(_docs(spark, sf_dir).select("doc_id", "source", "model", "text"), "text", model)


@REGISTRY.add(f"""WITH {_VERDICTS} SELECT doc_id, combined < 0 AS human, round(least(1.0::DOUBLE, 3 * abs(combined)), 6) AS confidence, round(deep_walk, 6) AS deep_walk, round(rate, 6) AS long_miss_rate,
  CASE WHEN combined < 0 THEN 'HUMAN (' ELSE 'AI (' END || round_even(least(1.0::DOUBLE, 3 * abs(combined)) * 100, 0)::INT || '%)' AS label FROM scored""")
def detect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    v = _verdicts(spark, sf_dir).select("doc_id", "verdict.*")
    return v.select("doc_id", "human", F.round("confidence", 6).alias("confidence"), F.round("deep_walk", 6).alias("deep_walk"), F.round("long_miss_rate", 6).alias("long_miss_rate"), "label")


_RHETORIC = _trained("source = 'longform'")
_TROLL = f"""WITH {_RHETORIC}, {_PROBE.replace("WINDOW", "1000000000")}
SELECT doc_id, bonded, round(CASE WHEN bonded / 8.0::DOUBLE <= 0.67 THEN 0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bonded / 8.0::DOUBLE - 0.67::DOUBLE) / 0.13::DOUBLE)) END, 6) AS troll_score FROM cmp WHERE depth = 0"""


@REGISTRY.add(_TROLL)
def manipulation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document against the profile of rhetorical text."""
    docs = _docs(spark, sf_dir)
    troll = det.Model.from_rows(prof.train(docs.where("source = 'longform'"), "doc_id", "text", threshold=None))
    root = docs.select("doc_id", F.get(det.probe_levels(F.col("text"), None), F.lit(0)).alias("root"))
    return root.select("doc_id", det.compare_level(F.col("root"), troll.spatial[0])["bonded"].alias("bonded"), F.round(det.manipulation_score(F.col("root"), troll), 6).alias("troll_score"))


_MODEL_NAME = "coalesce(d.model, 'human')"


@REGISTRY.add(f"""WITH {_VERDICTS} SELECT {_MODEL_NAME} AS model, grouping({_MODEL_NAME})::INT AS is_total, count(*) AS n, count(*) FILTER (combined >= 0) AS detected,
  round(100.0::DOUBLE * count(*) FILTER (combined >= 0) / count(*), 4) AS rate, round(avg(deep_walk), 6) AS avg_walk, round(avg(rate), 6) AS avg_miss
FROM scored JOIN documents d USING (doc_id) GROUP BY ROLLUP ({_MODEL_NAME})""")
def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection by model, with a total row."""
    v = _verdicts(spark, sf_dir).select(F.coalesce("model", F.lit("human")).alias("model"), "verdict.*")
    return by_model(v)


@REGISTRY.add(f"""WITH {_VERDICTS}, m AS (SELECT d.model IS NULL AS is_human, combined < 0 AS human, least(1.0::DOUBLE, 3 * abs(combined)) AS confidence FROM scored JOIN documents d USING (doc_id))
SELECT round(100.0::DOUBLE * count(*) FILTER (is_human AND human) / count(*) FILTER (is_human), 4) AS human_correct, round(100.0::DOUBLE * count(*) FILTER (NOT is_human AND NOT human) / count(*) FILTER (NOT is_human), 4) AS ai_detected,
  round((100.0::DOUBLE * count(*) FILTER (is_human AND human) / count(*) FILTER (is_human) + 100.0::DOUBLE * count(*) FILTER (NOT is_human AND NOT human) / count(*) FILTER (NOT is_human)) / 2, 4) AS balanced, round(avg(confidence), 6) AS avg_confidence FROM m""")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on human and machine text and their mean."""
    return balanced(_verdicts(spark, sf_dir).select(F.col("model").isNull().alias("is_human"), "verdict.*"))
