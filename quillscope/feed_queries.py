"""Queries over events, their graph, metric tables, samplers and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, codec, grammar, ratio
from .functions import events as ev
from .functions import tokens as tok
from .functions import vectors as vec
from .functions.keys import norm_key
from .operators import graph as gr
from .operators import metrics as mt
from .operators import report as rep
from .operators import sampling as sm
from .plans.skew import spread
from .registry import Registry
from .session import load
from .sources import feed, files, source_code
from .streaming import live

REGISTRY = Registry()

_N = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_GRAPH = f"""
node AS (
  SELECT id, first(pubkey ORDER BY received_at) AS pubkey, first(kind ORDER BY received_at) AS kind, first(tags ORDER BY received_at) AS tags
  FROM (SELECT {_N.format("id")} AS id, {_N.format("pubkey")} AS pubkey, kind, tags, received_at FROM nostr_event WHERE id IS NOT NULL) GROUP BY id),
tag AS (SELECT id, unnest(range(len(tags))) AS pos, unnest(tags) AS t FROM node),
ref AS (SELECT id, pos::INT AS pos, CASE WHEN t[1] = 'e' THEN 'event' ELSE 'pubkey' END AS type, {_N.format("t[2]")} AS key FROM tag WHERE len(t) >= 2 AND t[1] IN ('e', 'p') AND t[2] IS NOT NULL),
known AS (SELECT 'event' AS type, id AS key FROM node UNION SELECT 'pubkey', pubkey FROM node WHERE pubkey IS NOT NULL),
bond AS (SELECT r.* FROM ref r JOIN known USING (type, key) WHERE type = 'event'),
lost AS (SELECT r.* FROM ref r ANTI JOIN known USING (type, key))"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.nodes(load(spark, sf_dir, "nostr_event"))


@REGISTRY.add(f"WITH {_GRAPH} SELECT id, pos, key FROM bond")
def event_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between events that are both there."""
    return gr.bonds(_graph(spark, sf_dir)).select("id", "pos", "key")


@REGISTRY.add(f"WITH {_GRAPH} SELECT id, pos, type, key FROM lost")
def event_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to what is not there."""
    return gr.orphans(_graph(spark, sf_dir))


@REGISTRY.add(f"WITH {_GRAPH} SELECT type, count(*) AS n, count(DISTINCT key) AS n_keys FROM lost GROUP BY type")
def orphans_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.orphans(_graph(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@REGISTRY.add(f"WITH {_GRAPH} SELECT n.id, count(b.id) AS n_in_refs FROM node n LEFT JOIN bond b ON b.key = n.id GROUP BY n.id")
def event_in_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.in_refs(_graph(spark, sf_dir))


@REGISTRY.add(f"""WITH {_GRAPH} SELECT CASE WHEN grouping(pubkey) = 0 THEN 'author' ELSE 'kind' END AS "by", CASE WHEN grouping(pubkey) = 0 THEN pubkey ELSE kind::VARCHAR END AS member, count(*) AS size
FROM node GROUP BY GROUPING SETS ((pubkey), (kind))""")
def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.clusters(_graph(spark, sf_dir))


@REGISTRY.add(f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM node) AS events, (SELECT count(DISTINCT pubkey) FROM node) AS authors, (SELECT count(DISTINCT kind) FROM node) AS kinds,
  (SELECT count(*) FROM bond) AS bonds, (SELECT count(*) FROM lost) AS orphans, (SELECT max(n) FROM (SELECT count(*) AS n FROM node WHERE pubkey IS NOT NULL GROUP BY pubkey)) AS largest_author,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM node WHERE kind IS NOT NULL GROUP BY kind)) AS largest_kind""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.stats(_graph(spark, sf_dir))


@REGISTRY.add("""SELECT delivery_id FROM nostr_event WHERE kind IN (1, 6) AND created_at >= 1741000000 AND created_at <= 1744000000 AND len(list_filter(tags, lambda t: t[1] = 't' AND t[2] IN ('poetry', 'trains'))) > 0""")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription: kinds, a span of time and hashtags."""
    return load(spark, sf_dir, "nostr_event").where(ev.matches(kinds=[1, 6], since=1741000000, until=1744000000, tags={"t": ["poetry", "trains"]})).select("delivery_id")


_CHUNKED = f"""
note AS (SELECT {_N.format("id")} AS id, first(created_at ORDER BY received_at, delivery_id) AS created_at, first(strlen(content) ORDER BY received_at, delivery_id) AS n
  FROM nostr_event WHERE kind = 1 AND created_at >= 0 AND strlen(content) >= 50 GROUP BY 1)"""


@REGISTRY.add(f"WITH {_CHUNKED} SELECT created_at // 86400 AS chunk_no, count(*) AS n_events, sum(n)::BIGINT AS n_bytes FROM note GROUP BY 1")
def crawl_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a replay by chunk of a day."""
    notes = feed.replay(load(spark, sf_dir, "nostr_event"))
    return notes.groupBy("chunk_no").agg(F.count("*").alias("n_events"), F.sum(F.octet_length("content")).alias("n_bytes"))


@REGISTRY.add("""WITH c AS (SELECT ts_unix // 86400 AS chunk_no, count(*) FILTER (human = false) AS d, count(human) AS t FROM crawl_csv GROUP BY 1)
SELECT chunk_no, d AS detected, t AS total, round(coalesce(100.0::DOUBLE * (sum(d) OVER w) / nullif(sum(t) OVER w, 0), 0), 4) AS running_share FROM c WINDOW w AS (ORDER BY chunk_no)""")
def running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative share of machine verdicts by day."""
    days = load(spark, sf_dir, "crawl_csv").groupBy(F.expr("ts_unix div 86400").alias("chunk_no")).agg(F.count_if(~F.col("human")).alias("detected"), F.count("human").alias("total"))
    return rep.running_share(days, "chunk_no", "detected", "total").select("chunk_no", "detected", "total", "running_share")


@REGISTRY.add("""WITH c AS (SELECT human, try_cast(confidence AS DOUBLE) AS confidence, try_cast(deep_walk AS DOUBLE) AS deep_walk, try_cast(long_miss AS DOUBLE) AS long_miss_rate, label IS NULL AS no_label FROM crawl_csv)
SELECT no_label, count(human) AS n, count(*) FILTER (human IS NULL) AS errors, count(*) FILTER (human) AS human, round(100.0::DOUBLE * count(*) FILTER (human) / nullif(count(human), 0), 4) AS accuracy,
  round(avg(confidence) FILTER (NOT isnan(confidence)), 4) AS avg_confidence, round(avg(deep_walk) FILTER (NOT isnan(deep_walk)), 4) AS avg_walk, round(avg(long_miss_rate) FILTER (NOT isnan(long_miss_rate)), 4) AS avg_miss FROM c GROUP BY no_label""")
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of logged verdicts; values that are no numbers are left out."""
    rows = load(spark, sf_dir, "crawl_csv")
    number = lambda c: F.nullif(F.expr(f"try_cast(trim({c}) as double)"), F.lit(float("nan")))
    typed = rows.select(F.col("label").isNull().alias("no_label"), "human", number("confidence").alias("confidence"), number("deep_walk").alias("deep_walk"), number("long_miss").alias("long_miss_rate"))
    out = rep.group_stats(typed, "no_label")
    return out.withColumns({c: F.round(c, 4) for c in ("avg_confidence", "avg_walk", "avg_miss")})


@REGISTRY.add(r"""WITH r AS (SELECT replace(lower(regexp_replace(model, '^\s+|\s+$', '', 'g')), '_', '-') AS model, strlen(generation) AS n FROM raid_csv WHERE generation IS NOT NULL),
m AS (SELECT model, count(*) AS n, round(avg(n), 6) AS avg_score FROM r GROUP BY model) SELECT model, n, avg_score, row_number() OVER (ORDER BY avg_score DESC, model) AS place FROM m""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by the mean size of their samples."""
    rows = load(spark, sf_dir, "raid_csv").where("generation is not null").select(F.regexp_replace(norm_key(F.col("model")), "_", "-").alias("model"), F.octet_length("generation").alias("n_bytes"))
    return rep.leaderboard(rows, "model", "n_bytes")


@REGISTRY.add("""SELECT sample_id, epoch_us(loaded_at) AS loaded_us, model FROM raid_csv WHERE attack = 'none' AND model <> 'human' AND strlen(generation) >= 100
QUALIFY row_number() OVER (PARTITION BY model ORDER BY md5(sample_id::VARCHAR || '/' || epoch_us(loaded_at)::VARCHAR || ':42')) <= 5""")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five clean samples of each model in a seeded order."""
    rows = load(spark, sf_dir, "raid_csv").where("attack = 'none' and model <> 'human' and octet_length(generation) >= 100")
    rows = rows.select("sample_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us"), "model")
    return sm.per_group(rows, "model", F.concat_ws("/", F.col("sample_id").cast("string"), F.col("loaded_us").cast("string")), 5)


@REGISTRY.add("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(1, (SELECT count(*) FROM documents) // 100) AS k FROM documents) WHERE i % k = 0 AND i // k < 100""")
def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.every_kth(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


# The metric tables stand on the table of user events: tag is its type, gen its day, site its id.
_GEN = "dayofyear(ts)::BIGINT"
_TABLES = f"""
e AS (SELECT event_type AS tag, {_GEN} AS gen, event_id AS site, user_id, value FROM events),
type_sig AS (SELECT tag, count(*) AS "count", gen FROM e GROUP BY tag, gen),
bonds AS (SELECT DISTINCT tag, gen, site FROM e WHERE value > 50),
missing AS (SELECT tag, gen, count(*) FILTER (value < 20) AS "count" FROM e GROUP BY tag, gen),
health AS (SELECT gen, count(DISTINCT user_id) AS occupied, (SELECT count(DISTINCT user_id) FROM e) AS total FROM e GROUP BY gen),
fitness AS (SELECT 0 AS dim, gen, count(*) FILTER (value > 50) AS num, count(*) AS denom FROM e GROUP BY gen),
hex_ops AS (SELECT user_id % 9 AS op, gen, count(*) AS "count" FROM e GROUP BY 1, 2)"""


def _metrics(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.dayofyear("ts").cast("bigint").alias("gen"), F.col("event_id").alias("site"), "user_id", "value")
    total = e.agg(F.countDistinct("user_id").alias("total"))
    by_gen = e.groupBy("gen").agg(F.countDistinct("user_id").alias("occupied"))
    quarter = lambda k: F.count_if(F.col("user_id") % 4 == k)
    return {
        "type_sig": e.groupBy("tag", "gen").agg(F.count("*").alias("count")),
        "bonds": e.where("value > 50").select("tag", "gen", "site").distinct(),
        "missing": e.groupBy("tag", "gen").agg(F.count_if(F.col("value") < 20).alias("count")),
        "health": by_gen.join(F.broadcast(total)),  # one row
        "fitness": e.groupBy("gen").agg(F.lit(0).alias("dim"), F.count_if(F.col("value") > 50).alias("num"), F.count("*").alias("denom")),
        "hex_ops": e.groupBy((F.col("user_id") % 9).alias("op"), "gen").agg(F.count("*").alias("count")),
        "adsr": e.groupBy("gen").agg(quarter(0).alias("attack"), quarter(1).alias("decay"), quarter(2).alias("sustain"), quarter(3).alias("release")),
    }


@REGISTRY.add(f"""WITH {_TABLES} SELECT tag, "count", gen FROM type_sig QUALIFY row_number() OVER (PARTITION BY tag ORDER BY "count" DESC, gen DESC) <= 5""")
def trend_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five points of each tag, in the order of counts."""
    return mt.type_trend(_metrics(spark, sf_dir)["type_sig"], 5, per="tag")


@REGISTRY.add(f"""WITH {_TABLES} SELECT tag, gen, "count" FROM missing QUALIFY row_number() OVER (PARTITION BY tag ORDER BY gen DESC) <= 3""")
def trend_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.last_n(_metrics(spark, sf_dir)["missing"], ["gen", "count"], 3, "tag")


@REGISTRY.add(f"WITH {_TABLES} SELECT gen, occupied, total FROM health ORDER BY gen DESC LIMIT 7")
def health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.last_n(_metrics(spark, sf_dir)["health"], ["gen"], 7)


@REGISTRY.add(f"WITH {_TABLES} SELECT tag, gen, count(*) AS bonds FROM bonds GROUP BY tag, gen QUALIFY row_number() OVER (PARTITION BY tag ORDER BY gen DESC) <= 4")
def bond_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.bond_history(_metrics(spark, sf_dir)["bonds"], 4)


@REGISTRY.add(f"""WITH {_TABLES}, top AS (SELECT tag, "count", gen FROM type_sig WHERE "count" > 0 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY "count" DESC, gen DESC) = 1)
SELECT t.tag, t.gen, coalesce(b.n, 0) AS num, t."count" AS denom FROM top t LEFT JOIN (SELECT tag, gen, count(*) AS n FROM bonds GROUP BY tag, gen) b ON b.tag = t.tag AND b.gen = t.gen""")
def bond_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return mt.bond_rates(m["type_sig"], m["bonds"]).select("tag", "gen", "rate.num", "rate.denom")


@REGISTRY.add(f"""WITH {_TABLES}, l AS (SELECT op, arg_max("count", gen) AS n FROM hex_ops GROUP BY op) SELECT sum(n) FILTER (op IN (3, 6))::BIGINT AS num, sum(n)::BIGINT AS denom FROM l""")
def explore_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.explore_ratio(_metrics(spark, sf_dir)["hex_ops"])


@REGISTRY.add(f"""WITH {_TABLES}, s AS (SELECT *, lag(occupied) OVER (ORDER BY gen) AS po, lag(total) OVER (ORDER BY gen) AS pt FROM health),
c AS (SELECT count(*) AS points, count(*) FILTER (occupied * pt > po * total) AS rises, count(*) FILTER (occupied * pt < po * total) AS falls FROM s)
SELECT points, rises, falls, CASE WHEN points < 2 THEN 'flat' WHEN falls > (points - 1) // 2 THEN 'falling' WHEN rises > (points - 1) // 2 THEN 'rising' WHEN points >= 3 AND rises = 0 AND falls = 0 THEN 'stagnant' ELSE 'flat' END AS trend FROM c""")
def trend_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.trend(_metrics(spark, sf_dir)["health"], F.col("occupied"), F.col("total"))


@REGISTRY.add(f"""WITH {_TABLES}, s AS (SELECT tag, gen, "count" - lag("count") OVER (PARTITION BY tag ORDER BY gen) AS d FROM missing) SELECT tag, coalesce(arg_max(d, gen), 0) AS delta FROM s GROUP BY tag""")
def missing_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.missing_delta(_metrics(spark, sf_dir)["missing"])


@REGISTRY.add("""WITH r AS (SELECT event_type = 'error' AS v, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS "window" FROM events),
w AS (SELECT "window", count(*) AS tokens, count(*) FILTER (v) AS vertices FROM r GROUP BY 1 HAVING count(*) >= 1000)
SELECT "window", tokens, vertices, row_number() OVER o >= 3 AND max((vertices * 5 > tokens)::INT) OVER (ORDER BY "window" ROWS 2 PRECEDING) = 0 AS converged FROM w WINDOW o AS (ORDER BY "window")""")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as new vertices in windows of a thousand events, threshold a fifth."""
    return mt.rate_windows(load(spark, sf_dir, "events"), "event_id", F.col("event_type") == "error", 1000, (1, 5))


_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@REGISTRY.add(f"""SELECT p_partkey, list_transform(string_split(base64(encode(p_name)), ''), lambda x: greatest(instr('{_B64}', x) - 1, 0)::INT) AS groups FROM part""")
def hex_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", tok.hex_encode(F.col("p_name")).alias("groups"))


@REGISTRY.add("SELECT p_partkey, p_name AS name FROM part")
def hex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.decode(tok.hex_decode(tok.hex_encode(F.col("p_name")), F.octet_length("p_name")), "UTF-8")
    return load(spark, sf_dir, "part").select("p_partkey", back.alias("name"))


@REGISTRY.add("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS a, l_quantity::BIGINT AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a // gcd(a, b) AS num, b // gcd(a, b) AS denom, (a * 7 + 3 * b) // gcd(a * 7 + 3 * b, b * 7) AS sum_num, (b * 7) // gcd(a * 7 + 3 * b, b * 7) AS sum_denom, a * 100 // b AS scaled, a * 2 < b AS below_half FROM r""")
def ratio_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number over quantity: reduced, plus 3/7, times 100, and below a half."""
    lines = spread(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    rows = lines.select("l_orderkey", "l_linenumber", ratio.new(F.col("l_linenumber"), F.col("l_quantity")).alias("r"))
    rows = rows.withColumn("s", ratio.add(F.col("r"), ratio.new(3, 7)))
    half = F.struct(F.lit(1).cast("bigint").alias("num"), F.lit(2).cast("bigint").alias("denom"))
    return rows.select("l_orderkey", "l_linenumber", "r.num", "r.denom", F.col("s.num").alias("sum_num"), F.col("s.denom").alias("sum_denom"), ratio.scale_int(F.col("r"), 100).alias("scaled"), ratio.less(F.col("r"), half).alias("below_half"))


@REGISTRY.add("""WITH q AS (SELECT vec_id, part::INT AS part, list_transform(range(1, 9), lambda i: round(embedding[part * 8 + i] * 1000)::BIGINT) AS v FROM embeddings, range(8) p(part)),
r AS (SELECT part, v AS r FROM q WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
d AS (SELECT vec_id, part, list_transform(range(1, 9), lambda i: v[i] - r[i]) AS d FROM q JOIN r USING (part)), m AS (SELECT *, list_transform(d, lambda x: abs(x)) AS s FROM d)
SELECT vec_id, part, CASE WHEN list_max(s) = 0 THEN -1 ELSE list_position(s, list_max(s)) - 1 END::INT AS channel, CASE WHEN list_max(s) = 0 THEN 0 ELSE d[list_position(s, list_max(s))] END AS error FROM m""")
def error_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each eighth of each quantised vector differs most from that of the first vector."""
    eighths = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.transform(F.slice("embedding", p * 8 + 1, F.lit(8)), lambda x: F.round(x.cast("float") * 1000).cast("bigint")))
    q = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(eighths).alias("part", "v"))
    first = load(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).select(F.posexplode(eighths).alias("part", "r"))
    return q.join(F.broadcast(first), "part").select("vec_id", "part", vec.error_detect(F.col("v"), F.col("r")).alias("e")).select("vec_id", "part", "e.channel", "e.error")  # eight rows


@REGISTRY.add("""SELECT event_id, upper(substr(sha256(event_type), 1, 16)) || lpad(upper(to_hex(user_id)), 8, '0') AS k FROM events""")
def metric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of fixed width of tag and user."""
    return load(spark, sf_dir, "events").select("event_id", codec.key("", codec.tag_hash(F.col("event_type")), codec.u32(F.col("user_id"))).alias("k"))


@REGISTRY.add("""SELECT user_id, (user_id % 64)::INT AS h, (user_id % 8)::INT AS "inner", (user_id % 64 // 8)::INT AS "outer", xor((user_id % 64)::INT, 1 << (user_id % 6)::INT) AS moved FROM (SELECT DISTINCT user_id FROM events)""")
def line_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = load(spark, sf_dir, "events").select("user_id").distinct()
    h = (F.col("user_id") % 64).cast("int")
    return u.select("user_id", h.alias("h"), bits.inner(h).alias("inner"), bits.outer(h).alias("outer"), bits.move_line(h, F.col("user_id") % 6).alias("moved"))


_TAGS = ", ".join(f"('{t}')" for t in tok.CHANNELS)


@REGISTRY.add(f"""WITH t(tag) AS (VALUES {_TAGS}) SELECT a.tag, list_sort(list(b.tag)) AS neighbors FROM t a, t b WHERE NOT (a.tag = b.tag AND a.tag IN ('w5', 'space', 'origin')) GROUP BY a.tag""")
def grammar_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.neighbors_of(grammar.natural_text(spark))


@REGISTRY.add(r"""WITH r AS (SELECT received_at, unnest(tags) AS t FROM nostr_event WHERE kind = 10002),
u AS (SELECT received_at, regexp_replace(trim(t[2]), '/+$', '') AS url FROM r WHERE t[1] = 'r' AND (t[3] IS NULL OR t[3] <> 'read'))
SELECT url, epoch_us(min(received_at)) AS first_us FROM u WHERE regexp_matches(url, '^wss?://') AND NOT regexp_matches(lower(url), 'localhost|127\.0\.0\.1') GROUP BY url ORDER BY 2, 1 LIMIT 1000""")
def relay_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand relays that can be written to."""
    return live.relay_pool(load(spark, sf_dir, "nostr_event")).select("url", F.unix_micros("first_seen").alias("first_us"))


_NIBBLES = "['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']"
_FOLD = "xor(((c & 33554431) << 5), v)"
for _i, _g in enumerate(("996825010", "642813549", "513874426", "1027748829", "705979059")):  # the generator of the checksum (public standard)
    _FOLD = f"xor({_FOLD}, CASE WHEN (c >> {25 + _i}) & 1 = 1 THEN {_g} ELSE 0 END)"


@REGISTRY.add(f"""WITH r AS (SELECT delivery_id, {_N.format("id")} AS id, relay, {_N.format("pubkey")} AS pubkey, kind FROM nostr_event),
h AS (
  SELECT delivery_id, id, '0020' || id || CASE WHEN relay <> '' AND strlen(relay) < 256 THEN '01' || lower(lpad(to_hex(strlen(relay)), 2, '0')) || lower(hex(encode(relay))) ELSE '' END
    || CASE WHEN pubkey <> '' THEN '02' || lower(lpad(to_hex(length(pubkey) // 2), 2, '0')) || pubkey ELSE '' END || CASE WHEN kind IS NOT NULL THEN '0304' || lower(lpad(to_hex(kind), 8, '0')) ELSE '' END AS h,
    pubkey IS NULL OR (regexp_matches(pubkey, '^[0-9a-f]*$') AND length(pubkey) % 2 = 0) AS ok
  FROM r WHERE regexp_matches(id, '^[0-9a-f]{{64}}$')),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda x: {_NIBBLES}[instr('0123456789abcdef', x)]), '') AS b FROM h),
w AS (
  SELECT *, list_transform(range(0, (length(b) + 4) // 5), lambda i: list_sum(list_transform(range(5), lambda k: CASE WHEN substr(b, i * 5 + k + 1, 1) = '1' THEN 1 << (4 - k)::INT ELSE 0 END))::BIGINT) AS w FROM b),
s AS (
  SELECT *, xor(list_reduce([1]::BIGINT[] || list_transform(string_split('nevent', ''), lambda x: (ascii(x) >> 5)::BIGINT) || [0]::BIGINT[] || list_transform(string_split('nevent', ''), lambda x: (ascii(x) & 31)::BIGINT) || w || [0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, v: {_FOLD}), 1) AS c FROM w)
SELECT id, CASE WHEN ok THEN 'nevent1' || array_to_string(list_transform(w || list_transform(range(6), lambda i: (c >> (5 * (5 - i))::INT) & 31), lambda x: substr('qpzry9x8gf2tvdw0s3jn54khce6mua7l', x::INT + 1, 1)), '') END AS address FROM s""")
def event_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of every delivery of an event with a hexadecimal id."""
    from .session import ship

    ship(spark)
    rows = load(spark, sf_dir, "nostr_event").select(norm_key(F.col("id")).alias("id"), "relay", norm_key(F.col("pubkey")).alias("pubkey"), "kind").where("id rlike '^[0-9a-f]{64}$'")
    return rows.select("id", ev.nevent("id", "relay", "pubkey", "kind").alias("address"))


@REGISTRY.add("SELECT sample_id, coalesce(model, '') AS model FROM raid_csv WHERE attack = 'none' AND model <> 'human' AND strlen(generation) >= 100")
def clean_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean machine samples."""
    rows = load(spark, sf_dir, "raid_csv")
    keep = files.clean_samples(rows.select(F.struct("sample_id", "model").alias("domain"), "model", "attack", "generation"))
    return keep.select("domain.sample_id", "domain.model")


@REGISTRY.add()
def script_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that the reader of scripts finds in each document, counted."""
    docs = spread(load(spark, sf_dir, "documents"))
    each = source_code.source_elements(docs, F.col("doc_id"), F.col("text"), "js")
    return each.groupBy("path", "tag").agg(F.count("*").alias("n"))


@REGISTRY.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS v FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, count(*) AS n_lines, sum(strlen(regexp_replace(v, '\r$', '')))::BIGINT AS n_bytes FROM l GROUP BY doc_id""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document and their bytes without line ends."""
    rows = load(spark, sf_dir, "documents").where("text <> ''").select("doc_id", tok.lines(F.col("text")).alias("l"))
    size = F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["value"]))
    return rows.where("size(l) > 0").select("doc_id", F.size("l").cast("bigint").alias("n_lines"), size.alias("n_bytes"))


@REGISTRY.add(r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '</(?:p|div|h[1-6]|li|tr)\s*>|<br\s*/?>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS t
  FROM documents WHERE source = 'html-extract' AND text IS NOT NULL),
e AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM d)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n ?(?:\n ?)*', chr(10), 'g'), ' ')) AS digest FROM e""")
def html_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the texts of all HTML extracts, which are the documents of one source."""
    rows = load(spark, sf_dir, "documents").where("source = 'html-extract' and text is not null")
    return rows.select("doc_id", F.md5(files.html_text(F.col("text"))).alias("digest"))
