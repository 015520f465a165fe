"""Queries of the operators for large text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..plans.skew import spread
from ..registry import Registry
from ..session import load
from . import quality, repetition
from .formatting import event_classes
from .language import NAMES, fit_model, infer_languages, normal_label
from .mixing import mix
from .sampling import sample_by_targets
from .splitting import split_oversized
from .tokenizer import encode_texts

REGISTRY = Registry()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec, text) of the long texts of events and of all samples, deliveries and loads as they stand."""
    events = spread(load(spark, sf_dir, "nostr_event").select("id", "kind", "content")).where(F.col("kind").isin(1, 30023) & F.col("id").isNotNull())
    samples = spread(load(spark, sf_dir, "raid_csv").select("sample_id", "generation")).where("sample_id is not null")
    return events.select(F.lit("nostr_event").alias("tab"), norm_key(F.col("id")).alias("rec"), F.col("content").alias("text")).unionByName(
        samples.select(F.lit("raid_csv").alias("tab"), F.col("sample_id").cast("string").alias("rec"), F.col("generation").alias("text"))
    )


_TEXTS = r"""
texts AS (
  SELECT 'nostr_event' AS tab, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS rec, content AS text
  FROM nostr_event WHERE kind IN (1, 30023) AND id IS NOT NULL
  UNION ALL SELECT 'raid_csv', sample_id::VARCHAR, generation FROM raid_csv WHERE sample_id IS NOT NULL)"""

def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and long texts that are prose of at least 40 letters, with their languages."""
    events = spread(load(spark, sf_dir, "nostr_event").select("id", "kind", "content", "lang")).where(F.col("kind").isin(1, 30023) & F.col("id").isNotNull() & F.col("content").isNotNull())
    model = fit_model(events, F.col("content"), F.col("lang"))
    prose = events.where(F.col("content").rlike(r"^(?:\P{L}*+\p{L}){40}") & ~quality.is_no_prose(F.col("content")))
    return infer_languages(prose, {"id": norm_key(F.col("id")), "label": normal_label(F.col("lang"))}, F.col("content"), model)


@REGISTRY.add()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _languages(spark, sf_dir)
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | (F.col("label") != F.get("langs", F.lit(0)))
    return said.where((F.size("langs") > 0) & wrong).select("id", F.explode("langs").alias("lang")).distinct()


@REGISTRY.add()
def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each content, with its confidence, beside its label."""
    return _languages(spark, sf_dir).select("id", "label", F.get("langs", F.lit(0)).alias("lang"), "confidence").distinct()


@REGISTRY.add()
def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the contents in several languages."""
    mixed = _languages(spark, sf_dir).where("size(langs) > 1")
    return mixed.select("id", F.posexplode("segments").alias("segment_no", "s")).select("id", "segment_no", "s.*").distinct()


_CODES = " ".join(f"WHEN h IN ({', '.join(repr(x) for x in (code, *names))}) THEN '{code}'" for code, names in NAMES.items())


@REGISTRY.add(f"""WITH l AS (SELECT DISTINCT lang AS label FROM nostr_event WHERE lang IS NOT NULL), h AS (SELECT label, string_split(string_split(lower(regexp_replace(label, '^\\s+|\\s+$', '', 'g')), '-')[1], '_')[1] AS h FROM l)
SELECT label, CASE {_CODES} END AS code FROM h""")
def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a label with the language it names, or none."""
    labels = load(spark, sf_dir, "nostr_event").where("lang is not null").select(F.col("lang").alias("label")).distinct()
    return labels.select("label", normal_label(F.col("label")).alias("code"))


@REGISTRY.add()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that fail the table of thresholds as no prose."""
    judged = quality.judge(_texts(spark, sf_dir), {"tab": F.col("tab"), "rec": F.col("rec")}, F.col("text"))
    return judged.where(F.array_contains("reasons", quality.NO_PROSE)).select("tab", "rec").distinct()


@REGISTRY.add()
def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of each text and the reasons for which it fails."""
    return quality.judge(_texts(spark, sf_dir), {"tab": F.col("tab"), "rec": F.col("rec")}, F.col("text"))


_COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in sorted({y for v in quality.COMMON.values() for y in v.split()})) + "]"
_BREAKS_SQL = r"[\r\n\x{85}\x{2028}\x{2029}]+"
_END_SQL = r"""[.!?…。！？]["”»'')\]]*\s*$"""
_SHARE_SQL = lambda a, b: f"round(({a})::DOUBLE / greatest({b}, 1), 6)"


def _reasons_sql(rules, names: dict[str, str], skip: str = "") -> str:
    """The reasons of a table of rules over SQL columns."""
    tests = [f"""CASE WHEN {f"{r.least[0]} >= {r.least[1]} AND " if r.least else ""}{names.get(r.statistic, r.statistic)} {r.op} {r.bound} THEN '{r.reason}' END""" for r in rules if r.reason != skip]
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


_RATIOS = f"""
WITH {_TEXTS},
t AS (SELECT tab, rec, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w, string_split_regex(text, '{_BREAKS_SQL}') AS raw FROM texts WHERE text IS NOT NULL),
b AS (SELECT *, list_transform(raw, lambda x: regexp_replace(x, '{quality._MARK}', '')) AS body FROM t),
c AS (SELECT *, list_transform(body, lambda x: trim(regexp_replace(x, '{quality._SPACES}', ' ', 'g'), ' ')) AS c FROM b),
f AS (
  SELECT tab, rec, length(text)::BIGINT AS n_chars, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS lengths, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]+', '', 'g')) AS symbols,
    len(regexp_extract_all(text, '#|…|\\.\\.\\.')) AS marks, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS alpha, len(list_filter(c, lambda x: x <> ''))::BIGINT AS n_lines,
    len(list_filter(c, lambda x: regexp_matches(x, '{_END_SQL}'))) AS ends, len(list_filter(list_zip(raw, body, c), lambda x: x[3] <> '' AND x[1] <> x[2])) AS bullets, len(list_filter(c, lambda x: ends_with(x, '…'))) AS dots,
    len(list_filter(c, lambda x: x <> '' AND length(x) < 30)) AS short, len(list_filter(w, lambda x: list_contains({_COMMON_SQL}, x)))::BIGINT AS n_common_words, len(regexp_extract_all(text, '[{{}}]'))::INT AS n_braces
  FROM c),
s AS (
  SELECT *, lengths::DOUBLE / greatest(n_words, 1) AS mean_word_length, symbols::DOUBLE / greatest(n_chars, 1) AS symbol_share, marks::DOUBLE / greatest(n_words, 1) AS mark_word_ratio, alpha::DOUBLE / greatest(n_words, 1) AS alpha_word_share,
    ends::DOUBLE / greatest(n_lines, 1) AS end_line_share, bullets::DOUBLE / greatest(n_lines, 1) AS bullet_line_share, dots::DOUBLE / greatest(n_lines, 1) AS ellipsis_line_share, short::DOUBLE / greatest(n_lines, 1) AS short_line_share FROM f)
SELECT tab, rec, n_chars, n_words, n_lines, n_common_words, n_braces, {", ".join(f"round({x}, 6) AS {x}" for x in ("mean_word_length", "symbol_share", "mark_word_ratio", "alpha_word_share", "end_line_share", "bullet_line_share", "ellipsis_line_share", "short_line_share"))},
  {_reasons_sql(quality.RULES, {}, quality.NO_PROSE)} AS reasons FROM s"""


@REGISTRY.add(_RATIOS)
def p3_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that have published thresholds, and the reasons of those thresholds."""
    judged = quality.judge(_texts(spark, sf_dir).where("text is not null"), {"tab": F.col("tab"), "rec": F.col("rec")}, F.col("text"))
    whole, shares = ["n_chars", "n_words", "n_lines", "n_common_words", "n_braces"], ["mean_word_length", "symbol_share", "mark_word_ratio", "alpha_word_share", "end_line_share", "bullet_line_share", "ellipsis_line_share", "short_line_share"]
    return judged.select("tab", "rec", F.col("n_chars"), *[F.col(c).cast("bigint" if c != "n_braces" else "int").alias(c) for c in whole[1:]], *[F.round(c, 6).alias(c) for c in shares], F.array_remove("reasons", quality.NO_PROSE).alias("reasons"))


@REGISTRY.add(f"""
WITH {_TEXTS},
one AS (SELECT tab, rec, min(text) AS text FROM texts WHERE text IS NOT NULL GROUP BY ALL),
w AS (SELECT tab, rec, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM one)
SELECT tab, rec, length(text)::BIGINT AS n_chars, len(w)::BIGINT AS n_words,
  round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / greatest(len(w), 1), 6) AS mean_word_length,
  round(length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]+', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS symbol_share
FROM w WHERE len(w) > 0""")
def p3_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of each text with words, once a record."""
    one = _texts(spark, sf_dir).where("text is not null").groupBy("tab", "rec").agg(F.min("text").alias("text"))
    judged = quality.judge(one, {"tab": F.col("tab"), "rec": F.col("rec")}, F.col("text")).where("n_words > 0")
    return judged.select("tab", "rec", "n_chars", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("symbol_share", 6).alias("symbol_share"))


_RUNS = f"""
WITH {_TEXTS},
w AS (SELECT DISTINCT tab, rec, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts WHERE text IS NOT NULL),
g AS (SELECT tab, rec, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT tab, rec, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT tab, rec, i FROM g QUALIFY row_number() OVER (PARTITION BY tab, rec, g ORDER BY i) > 1),
n AS (
  SELECT tab, rec, sum(least(5, i - prev)) AS covered
  FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY tab, rec ORDER BY i), -5) AS prev FROM again) GROUP BY tab, rec)
"""


@REGISTRY.add(_RUNS + "SELECT w.tab, w.rec FROM w JOIN n USING (tab, rec) WHERE len(w) >= 30 AND covered * 3 >= len(w)")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that fail the table of thresholds for repeated runs of words."""
    measured = repetition.measure(_texts(spark, sf_dir), {"tab": F.col("tab"), "rec": F.col("rec")}, F.col("text"))
    return measured.where(F.array_contains("reasons", repetition.REPEATED_RUNS)).select("tab", "rec").distinct()


@REGISTRY.add(_RUNS + "SELECT w.tab, w.rec, len(w)::BIGINT AS n_words, round(coalesce(covered, 0)::DOUBLE / greatest(len(w), 1), 6) AS run_word_share FROM w LEFT JOIN n USING (tab, rec)")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of words in repeated runs of each text."""
    one = _texts(spark, sf_dir).where("text is not null").groupBy("tab", "rec").agg(F.min("text").alias("text"))
    measured = repetition.measure(one, {"tab": F.col("tab"), "rec": F.col("rec")}, F.col("text"))
    return measured.select("tab", "rec", "n_words", F.round("run_word_share", 6).alias("run_word_share"))


def _repeated_sql(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')), lambda x: x <> '')"


def _again_sql(column: str) -> str:
    total, first = (f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)" for x in (column, f"list_distinct({column})"))
    return f"CASE WHEN {total} > 0 THEN ({total} - {first})::DOUBLE / {total} ELSE 0.0::DOUBLE END"


_REPEATS = f"""
WITH {_TEXTS},
w AS (SELECT DISTINCT tab, rec, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts WHERE text IS NOT NULL),
g AS (SELECT tab, rec, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT tab, rec, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT tab, rec, i FROM g QUALIFY row_number() OVER (PARTITION BY tab, rec, g ORDER BY i) > 1),
n AS (SELECT tab, rec, sum(least(5, i - prev))::BIGINT AS run_words FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY tab, rec ORDER BY i), -5) AS prev FROM again) GROUP BY tab, rec),
top AS (SELECT tab, rec, max(n) AS most FROM (SELECT tab, rec, x, count(*) AS n FROM (SELECT tab, rec, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY ALL),
p AS (
  SELECT tab, rec, text, w, len(w)::BIGINT AS n_words, coalesce(run_words, 0) AS run_words, coalesce(most, 0) AS most, list_filter(string_split_regex(text, '{_BREAKS_SQL}'), lambda x: x <> '') AS lines,
    {_repeated_sql(f"string_split_regex(text, '{_BREAKS_SQL}')")} AS l, {_repeated_sql("string_split_regex(text, '(?:\\r?\\n\\s*){2,}')")} AS pa, {_repeated_sql("string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(57344), 'g'), chr(57344))")} AS se
  FROM w LEFT JOIN n USING (tab, rec) LEFT JOIN top USING (tab, rec)),
s AS (
  SELECT tab, rec, n_words, run_words, run_words::DOUBLE / greatest(n_words, 1) AS run_word_share, 3 * run_words - n_words AS run_surplus, {_again_sql("l")} AS line_share, {_again_sql("pa")} AS paragraph_share, {_again_sql("se")} AS sentence_share,
    most::DOUBLE / greatest(n_words, 1) AS top_word_share, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]+', '', 'g'))::DOUBLE / greatest(length(text), 1) AS symbol_share, len(regexp_extract_all(text, '#|…|\\.\\.\\.'))::DOUBLE / greatest(n_words, 1) AS mark_word_ratio,
    len(list_filter(w, lambda x: list_contains({_COMMON_SQL}, x)))::BIGINT AS n_common_words, len(list_filter(lines, lambda x: regexp_matches(x, '{_END_SQL}')))::DOUBLE / greatest(len(lines), 1) AS end_line_share FROM p)
SELECT tab, rec, n_words, run_words, run_surplus::BIGINT AS run_surplus, n_common_words, {", ".join(f"round({x}, 6) AS {x}" for x in ("run_word_share", "line_share", "paragraph_share", "sentence_share", "top_word_share", "symbol_share", "mark_word_ratio", "end_line_share"))},
  {_reasons_sql(repetition.RULES, {})} AS reasons FROM s"""


@REGISTRY.add(_REPEATS)
def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shares of repeated content of each text, once a record, and the reasons for which it fails."""
    measured = repetition.measure(_texts(spark, sf_dir).where("text is not null").distinct(), {"tab": F.col("tab"), "rec": F.col("rec")}, F.col("text"))
    return measured.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in measured.dtypes])


# DuckDB has no parser that sorts the fields of an object, so its form of profiles is made from their sorted pairs.
_CANON = r"""
ev AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id, min(content) AS content
  FROM nostr_event WHERE kind IN (0, 1, 30023) AND id IS NOT NULL AND content IS NOT NULL GROUP BY 1),
body AS (
  SELECT id, CASE WHEN regexp_matches(content, '^\s*\{') AND json_valid(content)
    THEN list_aggregate(list_sort(list_transform(json_keys(content), lambda k: k || ':' || json_extract_string(content, '$."' || k || '"'))), 'string_agg', ' ') ELSE content END AS text
  FROM ev),
canon AS (
  SELECT id, regexp_replace(lower(upper(text)),
    '[\p{P}\p{Z}\p{Cc}\p{Cf}\s$+<=>^`|~\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+', '', 'g') AS canon
  FROM body
  WHERE length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) >= 20)"""


@REGISTRY.add(f"""
WITH {_CANON}
SELECT first_id AS id_a, id AS id_b FROM (SELECT id, min(id) OVER (PARTITION BY canon) AS first_id FROM canon) WHERE id > first_id""")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = event_classes(spread(load(spark, sf_dir, "nostr_event").select("id", "kind", "content")))
    return pairs.where("id <> first_id").select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))


@REGISTRY.add(f"""
WITH {_CANON}
SELECT min(id) AS first_id, count(*) AS n_copies FROM canon GROUP BY canon HAVING count(*) > 1""")
def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each set of same contents, with its number of copies."""
    records = event_classes(spread(load(spark, sf_dir, "nostr_event").select("id", "kind", "content")))
    return records.where("id = first_id and n_copies > 1").select("first_id", "n_copies")


def _name(c: str):
    return F.regexp_replace(norm_key(F.col(c)), "_", "-")


def _machine_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of the clean machine samples."""
    raid = load(spark, sf_dir, "raid_csv")
    clean = raid.where((F.col("attack") == "none") & (_name("model") != "human") & (F.octet_length("generation") >= 100))
    targets = load(spark, sf_dir, "sample_target")
    targets = targets.select(_name("model").alias("model"), _name("domain").alias("domain"), "share_pm", "min_rows")
    return sample_by_targets(clean, F.col("sample_id"), {"model": _name("model"), "domain": _name("domain")}, targets, "share_pm", "min_rows")


_ELIGIBLE = r"""
eligible AS (
  SELECT sample_id, min(replace(lower(regexp_replace(model, '^\s+|\s+$', '', 'g')), '_', '-')) AS model,
    min(replace(lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')), '_', '-')) AS domain
  FROM raid_csv WHERE attack = 'none' AND lower(regexp_replace(model, '^\s+|\s+$', '', 'g')) <> 'human' AND strlen(generation) >= 100
  GROUP BY sample_id),
goal AS (
  SELECT t.model, t.domain, greatest(t.min_rows, (SELECT count(*) // 10 FROM eligible) * t.share_pm // 1000) AS wanted,
    (SELECT count(*) FROM eligible e WHERE e.model = t.model AND e.domain = t.domain) AS available
  FROM sample_target t)"""


@REGISTRY.add(f"WITH {_ELIGIBLE} SELECT model, domain FROM goal WHERE available < wanted")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine_samples(spark, sf_dir)[1].where("not met").select("model", "domain")


_TAKEN = f"""{_ELIGIBLE},
seat AS (
  SELECT g.model, g.domain, r.r, t.share_pm, t.min_rows, CASE WHEN r.r <= t.min_rows THEN 0 ELSE 1 END AS class, CASE WHEN r.r <= t.min_rows THEN r.r::DOUBLE ELSE (r.r - 0.5)::DOUBLE / t.share_pm END AS priority
  FROM goal g JOIN sample_target t USING (model, domain), LATERAL (SELECT unnest(range(1, g.available + 1)) AS r) r WHERE t.share_pm > 0 OR r.r <= t.min_rows),
drawn AS (SELECT *, row_number() OVER (ORDER BY class, priority, model, domain, r) AS place FROM seat QUALIFY place <= (SELECT count(*) // 10 FROM eligible)),
taken AS (SELECT model, domain, count(*) AS taken FROM drawn GROUP BY ALL)"""


@REGISTRY.add(f"WITH {_TAKEN} SELECT model, domain, r AS rank, round(CASE WHEN class = 1 THEN priority END, 9) AS priority FROM drawn")
def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's records by their rank in their category and their priority (which record has a rank is the hash's choice)."""
    return _machine_samples(spark, sf_dir)[0].select("model", "domain", "rank", F.round("priority", 9).alias("priority"))


@REGISTRY.add(f"WITH {_TAKEN} SELECT model, domain, wanted::BIGINT AS wanted, available, coalesce(taken, 0) AS taken, available >= wanted AS met FROM goal LEFT JOIN taken USING (model, domain)")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine_samples(spark, sf_dir)[1]


@REGISTRY.add()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(load(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id"), F.col("text"))


@REGISTRY.add()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(load(spark, sf_dir, "documents").select("doc_id", "source", "text")), load(spark, sf_dir, "mix_target"))[0]


@REGISTRY.add()
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(load(spark, sf_dir, "documents").select("doc_id", "source", "text")), load(spark, sf_dir, "mix_target"))[1]


@REGISTRY.add()
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(spread(load(spark, sf_dir, "documents").select("doc_id", "source", "text")), load(spark, sf_dir, "split_limit"))


@REGISTRY.add("""SELECT t.source, t.weight_pm::BIGINT AS weight_pm, true AS within_repeats, true AS share_as_wanted, true AS blocks_full, true AS texts_whole FROM mix_target t
WHERE t.source IN (SELECT source FROM documents WHERE length(text) > 0)""")
def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a mix: no block beyond its repeats; shares within the noise of the draw (five deviations) unless a source is short; all blocks but a source's last full; the texts' parts add up to the block."""
    docs, targets = spread(load(spark, sf_dir, "documents").select("doc_id", "source", "text")), load(spark, sf_dir, "mix_target")
    blocks, report = mix(docs, targets)
    by_block = blocks.groupBy("source", "block_no").agg(F.count("*").alias("uses"), F.max("n_tokens").alias("n"), F.min(F.aggregate("docs", F.lit(0), lambda a, d: a + d["n"]) == F.col("n_tokens")).alias("whole"))
    by = by_block.groupBy("source").agg(F.max("uses").alias("uses"), F.sum("uses").alias("slots"), F.count_if(F.col("n") < 1024).alias("parts"), F.min("whole").alias("texts_whole"))
    both = report.join(F.broadcast(targets.groupBy("source").agg(F.max("max_repeat").alias("most"))), "source").join(F.broadcast(by), "source")  # one row a source
    share = F.col("actual_pm") / 1000
    noise = 5 * F.sqrt(share * (1 - share) / F.col("slots")) * 1000 * F.sqrt(share) + 1000 / F.col("slots")
    any_short = F.max(F.col("short_pm") > 0).over(Window.partitionBy(F.lit(0)))  # then the others have more than their weight
    return both.select("source", "weight_pm", (F.col("uses") <= F.col("most")).alias("within_repeats"), (any_short | (F.abs(F.col("actual_pm") - F.col("weight_pm")) <= noise + 20)).alias("share_as_wanted"), (F.col("parts") <= 1).alias("blocks_full"), "texts_whole")


@REGISTRY.add("""SELECT d.doc_id, true AS first_at_start, true AS within_limit, true AS joined_up, true AS text_complete FROM documents d JOIN split_limit l USING (source) WHERE octet_length(encode(text)) > max_tokens
AND d.doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 4 * (SELECT max(max_tokens) FROM split_limit) * 3)""")
def p10_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of the longest texts (over twelve characters for each token of the largest limit, so that they are surely oversized): they start at 0, keep to the limit, overlap, and give the text again."""
    docs, limits = load(spark, sf_dir, "documents").select("doc_id", "source", "text"), load(spark, sf_dir, "split_limit")
    least = limits.agg(F.max("max_tokens")).first()[0] * 12
    pieces = split_oversized(spread(docs), limits)
    rows = docs.where(F.length("text") > least).join(F.broadcast(limits.select("source", "max_tokens")), "source").select("doc_id", "max_tokens", "text")
    each = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start_token", "end_token", "n_tokens", "overlap", F.octet_length("text").alias("bytes"), "text"))).alias("p"))
    both = rows.join(each, "doc_id")
    p = F.col("p")
    pairs = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(F.get(p, i - 1).alias("a"), F.get(p, i).alias("b")))
    joined = F.forall(pairs, lambda x: (x["b"]["start_token"] == x["a"]["end_token"] - x["b"]["overlap"]) & (x["b"]["start_token"] > x["a"]["start_token"]))
    complete = F.startswith(F.col("text"), F.get(p, F.lit(0))["text"]) & F.endswith(F.col("text"), F.get(p, F.size(p) - 1)["text"]) & F.forall(p, lambda x: F.contains(F.col("text"), x["text"]))
    return both.select("doc_id", (F.get(p, F.lit(0))["start_token"] == 0).alias("first_at_start"), F.forall(p, lambda x: x["n_tokens"] <= F.col("max_tokens")).alias("within_limit"), joined.alias("joined_up"), complete.alias("text_complete"))
