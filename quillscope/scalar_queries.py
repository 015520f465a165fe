"""Queries over scalar functions, grammars, codecs, constraints and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feed_queries import _GRAPH, _N, _TABLES, _graph, _metrics
from .functions import bits, codec, constraints, grammar, ratio
from .functions import events as ev
from .functions import tokens as tok
from .functions.keys import norm_key
from .operators import graph as gr
from .operators import metrics as mt
from .operators import report as rep
from .registry import Registry
from .session import Scratch, load, ship
from .sources import feed, files, source_code

REGISTRY = Registry()


def _values(rules: dict[str, list[str]]) -> str:
    return ", ".join(f"('{tag}', '{n}')" for tag, near in rules.items() for n in near)


@REGISTRY.add(f"WITH g(tag, neighbor) AS (VALUES {_values(grammar.GO_AST)}) SELECT tag, list_sort(list(neighbor)) AS neighbors FROM g GROUP BY tag")
def code_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may stand beside each element of Go code."""
    return grammar.neighbors_of(grammar.edges(spark, grammar.GO_AST))


@REGISTRY.add(f"""WITH a(tag, neighbor) AS (VALUES {_values(grammar.GO_AST)}), e(tag, neighbor) AS (VALUES {_values(grammar.GO_EMIT)})
SELECT tag, neighbor, EXISTS (SELECT 1 FROM e WHERE e.tag = a.tag AND e.neighbor = a.neighbor) AS emitted FROM a""")
def emission_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of the grammar of input the tighter one of output has too."""
    read, write = grammar.edges(spark, grammar.GO_AST), grammar.edges(spark, grammar.GO_EMIT)
    kept = grammar.can_neighbor(read, write).withColumn("emitted", F.lit(True))
    return read.join(F.broadcast(kept), ["tag", "neighbor"], "left").fillna(False, ["emitted"])  # a few hundred pairs


@REGISTRY.add(f"WITH g(tag, neighbor) AS (VALUES {_values(grammar.GO_EMIT)}) SELECT tag FROM g UNION SELECT neighbor FROM g")
def grammar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag of the grammar of output."""
    return grammar.tags(grammar.edges(spark, grammar.GO_EMIT))


_W = ", ".join(f"('{k}', {v})" for k, v in grammar.GO_WEIGHTS.items())


@REGISTRY.add(f"""WITH w(tag, w) AS (VALUES {_W}), d AS (SELECT doc_id, n_chars AS t, greatest(2, n_chars * 15 // 100) AS text FROM documents WHERE n_chars IS NOT NULL),
s AS (SELECT *, CASE WHEN text - text * 7 // 10 < 1 THEN text - 1 ELSE text * 7 // 10 END AS words, greatest(1, t - text) AS rest FROM d),
c AS (SELECT doc_id, t, text, tag, greatest(1, rest * w // 60) AS n FROM s, w), u AS (SELECT doc_id, sum(n) AS used FROM c GROUP BY doc_id)
SELECT c.doc_id, tag, (n + CASE WHEN tag = 'ident:var-name' THEN greatest(0, t - text - used) ELSE 0 END)::BIGINT AS n FROM c JOIN u USING (doc_id)
UNION ALL SELECT doc_id, 'word', words FROM s UNION ALL SELECT doc_id, 'punct', text - words FROM s""")
def code_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each element of Go code for the length of each document, seven tenths of the text's for words."""
    rows = load(spark, sf_dir, "documents").where("n_chars is not null")
    return rows.select("doc_id", F.explode(grammar.go_counts(F.col("n_chars"), F.lit(7), F.lit(10))).alias("tag", "n"))


_SHARES = ", ".join(f"('{k}', {v})" for k, v in grammar.TEXT_SHARES.items())


@REGISTRY.add(f"""WITH w(tag, p) AS (VALUES {_SHARES}), d AS (SELECT doc_id, greatest(8, n_chars) AS t FROM documents WHERE n_chars IS NOT NULL), c AS (SELECT doc_id, t, tag, greatest(1, t * p // 100) AS n FROM d, w)
SELECT doc_id, tag, n::BIGINT AS n FROM c UNION ALL SELECT doc_id, 'space', greatest(1, max(t) - sum(n))::BIGINT FROM c GROUP BY doc_id""")
def text_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each kind for the length of each document."""
    rows = load(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", grammar.text_counts(F.col("n_chars")).alias("m"))
    return rows.select("doc_id", F.explode("m").alias("tag", "n"))


@REGISTRY.add("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS a, l_quantity::BIGINT AS b FROM lineitem),
s AS (SELECT *, a * 7 - 3 * b AS sn, b * 7 AS sd FROM r)
SELECT l_orderkey, l_linenumber, sn // gcd(sn, sd) AS diff_num, sd // gcd(sn, sd) AS diff_denom, a * 3 // gcd(a * 3, b * 7) AS prod_num, b * 7 // gcd(a * 3, b * 7) AS prod_denom,
  a * 7 // gcd(a * 7, b * 3) AS quot_num, b * 3 // gcd(a * 7, b * 3) AS quot_denom, -(a // gcd(a, b)) AS neg_num, abs(sn) // gcd(sn, sd) AS abs_num, round(a::DOUBLE / b, 9) AS dec, sn = 0 AS is_zero, sn > 0 AS is_positive, sn < 0 AS is_negative,
  a * 7 <= 3 * b AS less_eq, a * 7 = 3 * b AS is_equal, a * 7 > 3 * b AS is_greater, (CASE WHEN a * 7 < 3 * b THEN 3 ELSE a // gcd(a, b) END) AS max_num, (CASE WHEN a * 7 > 3 * b THEN 3 ELSE a // gcd(a, b) END) AS min_num,
  CASE WHEN a * 4 < b THEN 1 WHEN a * 4 > b * 3 THEN 3 ELSE a // gcd(a, b) END AS clamp_num, (a // gcd(a, b)) || '/' || (b // gcd(a, b)) AS txt FROM s""")
def ratio_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number over quantity against 3/7, and held between 1/4 and 3/4."""
    r = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(ratio.new(F.col("l_linenumber"), F.col("l_quantity")))).alias("r"))
    big = lambda n, d: F.struct(F.lit(n).cast("bigint").alias("num"), F.lit(d).cast("bigint").alias("denom"))
    x, y = F.col("r"), big(3, 7)
    s = r.select("*", F.explode(F.array(F.struct(ratio.sub(x, y).alias("diff"), ratio.mul(x, y).alias("prod"), ratio.div(x, y).alias("quot")))).alias("s"))
    d = F.col("s.diff")
    return s.select(
        "l_orderkey", "l_linenumber", d["num"].alias("diff_num"), d["denom"].alias("diff_denom"), F.col("s.prod.num").alias("prod_num"), F.col("s.prod.denom").alias("prod_denom"),
        F.col("s.quot.num").alias("quot_num"), F.col("s.quot.denom").alias("quot_denom"), ratio.neg(x)["num"].alias("neg_num"), ratio.absolute(d)["num"].alias("abs_num"), F.round(ratio.to_double(x), 9).alias("dec"),
        ratio.is_zero(d).alias("is_zero"), ratio.is_positive(d).alias("is_positive"), ratio.is_negative(d).alias("is_negative"), ratio.less_eq(x, y).alias("less_eq"), ratio.equal(x, y).alias("is_equal"), ratio.greater(x, y).alias("is_greater"),
        ratio.largest(x, y)["num"].alias("max_num"), ratio.smallest(x, y)["num"].alias("min_num"), ratio.clamp(x, big(1, 4), big(3, 4))["num"].alias("clamp_num"), ratio.text(x).alias("txt"),
    )


@REGISTRY.add("""SELECT event_id, (t & 1) = 1 AS bonding, (t & 2) = 2 AS "constraint", (t & 4) = 4 AS energy, t | 2 AS "set", t & 6 AS cleared, CASE WHEN i <= 2 THEN xor(t, 1 << i) ELSE t END AS flipped, t | (o << 3) AS hexagram
FROM (SELECT event_id, (user_id % 8)::INT AS t, (event_id % 5)::INT AS i, (event_id % 8)::INT AS o FROM events)""")
def trigram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of states of three, set, cleared and turned."""
    e = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).cast("int").alias("t"), (F.col("event_id") % 5).cast("int").alias("i"), (F.col("event_id") % 8).cast("int").alias("o"))
    t = F.col("t")
    return e.select("event_id", bits.bit(t, 0).alias("bonding"), bits.bit(t, 1).alias("constraint"), bits.bit(t, 2).alias("energy"), bits.with_bit(t, 1, True).alias("set"), bits.with_bit(t, 0, False).alias("cleared"),
                    bits.flip(t, F.col("i")).alias("flipped"), bits.hexagram(t, F.col("o")).alias("hexagram"))


@REGISTRY.add("""WITH k AS (SELECT event_id, upper(to_hex(user_id % 65536)) AS h FROM events), p AS (SELECT event_id, lpad(h, 4, '0') || CASE WHEN event_id % 3 = 0 THEN 'FF' ELSE '' END AS k FROM k), r AS (SELECT *, regexp_replace(k, '(?:FF)+$', '') AS c FROM p WHERE length(k) % 2 = 0)
SELECT event_id, k, CASE WHEN c <> '' THEN substr(c, 1, length(c) - 2) || lpad(upper(to_hex(('0x' || right(c, 2))::BIGINT + 1)), 2, '0') END AS upper FROM r""")
def prefix_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least key over all keys with a prefix of two or three bytes."""
    h = F.lpad(F.hex(F.col("user_id") % 65536), 4, "0")
    k = load(spark, sf_dir, "events").select("event_id", F.concat(h, F.when(F.col("event_id") % 3 == 0, "FF").otherwise("")).alias("k"))
    return k.select("event_id", "k", codec.prefix_end(F.col("k")).alias("upper"))


@REGISTRY.add("""SELECT event_id, user_id - 500 AS num, CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 5 END AS denom, user_id % 100 AS occupied, user_id AS total, [event_id % 2, event_id % 3, event_id % 5, event_id % 7]::BIGINT[] AS phases FROM events""")
def value_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, health and phases through their bytes; a denominator of 0 is read as 1."""
    e = load(spark, sf_dir, "events")
    num, denom = F.col("user_id") - 500, F.col("event_id") % 5
    raw = e.select("event_id", codec.pair_value(num, denom).alias("p"), codec.health_value(F.col("user_id") % 100, F.col("user_id"), num, denom).alias("h"), codec.counts_value(*[F.col("event_id") % k for k in (2, 3, 5, 7)]).alias("c"))
    back = raw.select("event_id", codec.read_pair(F.col("p")).alias("p"), codec.read_health(F.col("h")).alias("h"), codec.read_counts(F.col("c"), 4).alias("phases"))
    return back.select("event_id", "p.num", "h.denom", "h.occupied", "h.total", "phases")


@REGISTRY.add("""SELECT p_partkey, p_name AS value, strlen(p_name)::INT AS n_bytes, (p_partkey % 2 = 0) AS is_ref, 4 * ((strlen(p_name) + 2) // 3)::INT AS n_groups FROM part""")
def element_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with the groups of their values, every other one as a reference."""
    e = F.when(F.col("p_partkey") % 2 == 0, tok.element(F.lit("word"), F.col("p_name"), True)).otherwise(tok.element(F.lit("word"), F.col("p_name")))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(e)).alias("e"))
    return rows.select("p_partkey", "e.value", "e.n_bytes", "e.is_ref", F.size("e.groups").alias("n_groups"))


_TAGS = ", ".join(f"('{t}', {i})" for i, t in enumerate(tok.CHANNELS))


@REGISTRY.add(f"""WITH t(tag, i) AS (VALUES {_TAGS}) SELECT event_id, coalesce(i, -1)::INT AS channel FROM (SELECT event_id, CASE WHEN event_id % 10 < 8 THEN ['w1', 'w2', 'w3', 'w4', 'w5', 'punct', 'space', 'origin'][event_id % 10 + 1] ELSE event_type END AS tag FROM events) LEFT JOIN t USING (tag)""")
def channel_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel of tags, some of which have none."""
    tag = F.when(F.col("event_id") % 10 < 8, F.get(F.array(*map(F.lit, tok.CHANNELS)), (F.col("event_id") % 10).cast("int"))).otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_id", tok.channel_index(tag).alias("channel"))


@REGISTRY.add("""SELECT event_id, tag = 'view' AND value > 40 AS by_value, layer = 'lexical' AND tag = 'view' AS by_layer, tag = 'view' AND list_contains(near, 'click') AND len(list_filter(near, lambda x: x NOT IN ('click', 'purchase'))) = 0 AS by_context, layer <> 'lexical' AS dissolves
FROM (SELECT event_id, event_type AS tag, value, CASE WHEN user_id % 2 = 0 THEN 'lexical' ELSE 'syntactic' END AS layer, list_filter([CASE WHEN event_id % 3 > 0 THEN 'click' END, CASE WHEN event_id % 4 = 0 THEN 'purchase' END, CASE WHEN event_id % 7 = 0 THEN 'error' END], lambda x: x IS NOT NULL) AS near FROM events)""")
def constraint_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which elements meet a constraint by value, by layer and by their neighbours."""
    layer = F.when(F.col("user_id") % 2 == 0, "lexical").otherwise("syntactic")
    e = F.struct(F.col("event_type").alias("tag"), "value", layer.alias("layer"), (layer == "lexical").alias("sticky"))
    near = F.array(F.when(F.col("event_id") % 3 > 0, "click"), F.when(F.col("event_id") % 4 == 0, "purchase"), F.when(F.col("event_id") % 7 == 0, "error"))
    rows = load(spark, sf_dir, "events").select("event_id", e.alias("e"), near.alias("near"))
    view = constraints.of_tag("view")
    by_context = constraints.in_context(view, ["click"], {"view": ["click", "purchase"]})
    by_value = constraints.all_of(view, constraints.of_tag("view", lambda v: v > 40))
    x, n = F.col("e"), F.col("near")
    return rows.select("event_id", by_value(x, n).alias("by_value"), constraints.aligned("lexical", view)(x, n).alias("by_layer"), by_context(x, n).alias("by_context"), constraints.dissolves(x).alias("dissolves"))


@REGISTRY.add(f"WITH {_GRAPH} SELECT 'author' AS \"by\", pubkey AS member, id FROM node WHERE pubkey IS NOT NULL UNION ALL SELECT 'kind', kind::VARCHAR, id FROM node WHERE kind IS NOT NULL")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.members(_graph(spark, sf_dir))


@REGISTRY.add(f"WITH {_GRAPH} SELECT r.type, r.key, r.id, r.pos FROM ref r JOIN known USING (type, key)")
def event_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who refers to each event and author that is there."""
    return gr.referrers(_graph(spark, sf_dir))


@REGISTRY.add("""SELECT kind, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (ok IS NULL) AS failed, count(*) AS total FROM (SELECT kind, CASE WHEN relay IS NOT NULL THEN delivery_id % 5 > 0 END AS ok FROM nostr_event) GROUP BY kind""")
def publish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of relays by kind: each delivery stands for one, every fifth is a refusal, and one without a relay had no answer."""
    answer = F.when(F.col("relay").isNotNull(), F.col("delivery_id") % 5 > 0)
    return rep.outcome_counts(load(spark, sf_dir, "nostr_event").select("kind", answer.alias("accepted")), "kind")


@REGISTRY.add("SELECT event_type AS path, sum(value)::DOUBLE AS raw, count(*) AS accreted FROM events GROUP BY event_type")
def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running scores, written in two parts and read as sums; each kind of user event stands for a file."""
    store = mt.MetricStore(spark, Scratch(spark, "metrics").root)
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.lit(1).cast("bigint").alias("accreted"), F.col("value").alias("raw"), "event_id")
    for half in (0, 1):
        store.add_scores(rows.where(F.col("event_id") % 2 == half).drop("event_id"))
    return store.scores()


@REGISTRY.add(f"WITH {_TABLES} SELECT gen, occupied + CASE WHEN gen % 2 = 0 THEN 1 ELSE 0 END AS occupied, total FROM health")
def metric_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table of which every other row was written twice; the later one holds."""
    store = mt.MetricStore(spark, Scratch(spark, "metrics").root)
    rows = _metrics(spark, sf_dir)["health"]
    store.record("health", rows)
    store.record("health", rows.where("gen % 2 = 0").withColumn("occupied", F.col("occupied") + 1))
    return store.read("health").select("gen", "occupied", "total")


@REGISTRY.add(f"WITH {_TABLES} SELECT gen, occupied, total FROM health ORDER BY gen DESC LIMIT 1")
def latest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.latest(_metrics(spark, sf_dir)["health"]).select("gen", "occupied", "total")


@REGISTRY.add("SELECT user_id AS seq, event_id AS gen, value FROM events ORDER BY user_id DESC, event_id DESC LIMIT 25")
def reading_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 25 readings by number and generation; user events stand for them."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("gen"), "value")
    return mt.oracle_history(rows, 25)


_BULK = """WITH RECURSIVE r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey % 100 AS t, (o_orderkey % 7 = 0)::BIGINT AS v FROM orders),
scan(i, w, t, v, full_t, full_v) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT r.i, CASE WHEN s.t + r.t >= 5000 THEN s.w + 1 ELSE s.w END, CASE WHEN s.t + r.t >= 5000 THEN 0 ELSE s.t + r.t END, CASE WHEN s.t + r.t >= 5000 THEN 0 ELSE s.v + r.v END,
    CASE WHEN s.t + r.t >= 5000 THEN s.t + r.t END, CASE WHEN s.t + r.t >= 5000 THEN s.v + r.v END
  FROM scan s JOIN r ON r.i = s.i + 1),
win AS (SELECT w - 1 AS "window", full_t AS tokens, full_v AS vertices FROM scan WHERE full_t IS NOT NULL)"""


@REGISTRY.add(_BULK + ' SELECT "window", tokens, vertices FROM win')
def bulk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at least 5,000 tokens over records of many; orders stand for them."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("t"), (F.col("o_orderkey") % 7 == 0).cast("bigint").alias("v"))
    return mt.bulk_windows(rows, "o_orderkey", "t", "v", 5_000)


@REGISTRY.add("""WITH r AS (SELECT event_type = 'error' AS v, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS "window" FROM events),
w AS (SELECT "window", count(*) AS tokens, count(*) FILTER (v) AS vertices FROM r GROUP BY 1 HAVING count(*) >= 1000), last AS (SELECT * FROM w ORDER BY "window" DESC LIMIT 10)
SELECT (SELECT count(*) FROM w) AS window_count, (SELECT count(*) FROM w) >= 3 AND (SELECT max((vertices * 5 > tokens)::INT) FROM (SELECT * FROM w ORDER BY "window" DESC LIMIT 3)) = 0 AS converged,
  (SELECT list([("window"), tokens, vertices] ORDER BY "window") FROM last) AS recent""")
def window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of convergence after all windows, with the last ten."""
    windows = mt.rate_windows(load(spark, sf_dir, "events"), "event_id", F.col("event_type") == "error", 1000, (1, 5))
    one = mt.window_report(windows.select("window", "tokens", "vertices"), (1, 5))
    return one.select("window_count", "converged", F.transform("recent", lambda x: F.array(x["window"], x["tokens"], x["vertices"])).alias("recent"))


_ID = r"""'[0,' || to_json(coalesce(pubkey, ''))::VARCHAR || ',' || created_at || ',' || kind || ',' || coalesce(to_json(tags)::VARCHAR, '[]') || ',' || to_json(coalesce(content, ''))::VARCHAR || ']'"""
_ESCAPED = f"replace(replace(replace(replace(replace({_ID}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029')"


@REGISTRY.add(f"""SELECT delivery_id, sha256({_ESCAPED}) AS computed, sha256({_ID}) AS computed_plain, coalesce({_N.format("id")} = sha256({_ESCAPED}), false) AS is_valid FROM nostr_event""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery's id beside the hash of its content, both ways of escaping."""
    rows = load(spark, sf_dir, "nostr_event")
    return rows.select("delivery_id", ev.compute_id().alias("computed"), ev.compute_id(escape_html=False).alias("computed_plain"), ev.valid_id().alias("is_valid"))


@REGISTRY.add("SELECT delivery_id FROM nostr_event WHERE false")
def signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries whose id and signature hold: none, as the signatures of the table are filler."""
    return feed.verified(load(spark, sf_dir, "nostr_event")).select("delivery_id")


@REGISTRY.add(r"""WITH e AS (SELECT id, pubkey, kind, created_at, coalesce(content, '') AS c, tags FROM nostr_event WHERE length(id) >= 16),
x AS (
  SELECT 'event' AS tag, substr(id, 1, 16) AS value FROM e UNION ALL SELECT 'pubkey', pubkey FROM e UNION ALL SELECT 'kind', kind::VARCHAR FROM e UNION ALL SELECT 'timestamp', created_at::VARCHAR FROM e
  UNION ALL SELECT 'word', w FROM (SELECT unnest(regexp_split_to_array(trim(c, ' '), '[ \t\n\x0B\f\r]+')) AS w FROM e) WHERE strlen(w) > 2
  UNION ALL SELECT 'literal', '"' || array_to_string(list_transform(string_split(c, ''), lambda x: CASE x WHEN '\' THEN '\\' WHEN '"' THEN '\"' WHEN chr(7) THEN '\a' WHEN chr(8) THEN '\b' WHEN chr(12) THEN '\f' WHEN chr(10) THEN '\n' WHEN chr(13) THEN '\r' WHEN chr(9) THEN '\t' WHEN chr(11) THEN '\v' WHEN ' ' THEN ' '
    ELSE CASE WHEN regexp_matches(x, '[\p{C}\p{Z}]') THEN CASE WHEN unicode(x) < 128 THEN printf('\x%02x', unicode(x)) WHEN unicode(x) < 65536 THEN printf('\u%04x', unicode(x)) ELSE printf('\U%08x', unicode(x)) END ELSE x END END), '') || '"' FROM e WHERE strlen(c) > 10 AND strlen(c) < 200
  UNION ALL SELECT CASE t[1] WHEN 'e' THEN 'e-tag' WHEN 'p' THEN 'p-tag' WHEN 't' THEN 'hashtag' ELSE 'tag' END, CASE WHEN t[1] IN ('e', 'p', 't') THEN t[2] ELSE concat_ws(':', t[1], t[2]) END FROM (SELECT unnest(tags) AS t FROM e) WHERE len(t) >= 2)
SELECT tag, value, count(*) AS n FROM x GROUP BY ALL""")
def event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag and value occurs among the elements of the events."""
    each = load(spark, sf_dir, "nostr_event").where("length(id) >= 16").select(F.inline(ev.elements()))
    return each.groupBy("tag", "value").agg(F.count("*").alias("n"))


@REGISTRY.add(f"""WITH {_TABLES}, h AS (SELECT * FROM health ORDER BY gen DESC LIMIT 10), s AS (SELECT *, lag(occupied) OVER (ORDER BY gen) AS po, lag(total) OVER (ORDER BY gen) AS pt FROM h),
c AS (SELECT count(*) AS p, count(*) FILTER (occupied * pt > po * total) AS r, count(*) FILTER (occupied * pt < po * total) AS f FROM s),
g AS (SELECT * FROM fitness ORDER BY gen DESC LIMIT 10), gs AS (SELECT *, lag(num) OVER (ORDER BY gen) AS pn, lag(denom) OVER (ORDER BY gen) AS pd FROM g),
gc AS (SELECT count(*) AS p, count(*) FILTER (num * pd > pn * denom) AS r, count(*) FILTER (num * pd < pn * denom) AS f FROM gs),
t AS (SELECT CASE WHEN p < 2 THEN 'flat' WHEN f > (p - 1) // 2 THEN 'falling' WHEN r > (p - 1) // 2 THEN 'rising' WHEN p >= 3 AND r = 0 AND f = 0 THEN 'stagnant' ELSE 'flat' END AS t FROM c),
gt AS (SELECT CASE WHEN p < 2 THEN 'flat' WHEN f > (p - 1) // 2 THEN 'falling' WHEN r > (p - 1) // 2 THEN 'rising' WHEN p >= 3 AND r = 0 AND f = 0 THEN 'stagnant' ELSE 'flat' END AS t FROM gc),
l AS (SELECT op, arg_max("count", gen) AS n FROM hex_ops GROUP BY op), x AS (SELECT sum(n) FILTER (op IN (3, 6))::BIGINT AS num, sum(n)::BIGINT AS denom FROM l),
ends AS (SELECT arg_min(occupied, gen) AS o1, arg_min(total, gen) AS t1, arg_max(occupied, gen) AS o2, arg_max(total, gen) AS t2 FROM h),
a AS (SELECT count(*) FILTER (user_id % 4 = 0) AS attack, count(*) FILTER (user_id % 4 = 1) AS decay, count(*) FILTER (user_id % 4 = 2) AS sustain, count(*) AS n FROM e WHERE gen = (SELECT max(gen) FROM e))
SELECT t.t AS occupancy_trend, gt.t AS fitness_trend, x.num AS explore_num, x.denom AS explore_denom, t.t = 'falling' AND (x.num * 5 > x.denom * 4 OR o2 * 2 * t1 < o1 * t2) AS over_extended, t.t = 'falling' AND o2 * 2 * t1 < o1 * t2 AS collapsed,
  round(sustain::DOUBLE / n, 6) AS sustain, round((attack + decay)::DOUBLE / n, 6) AS early FROM t, gt, x, ends, a""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the last generations."""
    m = _metrics(spark, sf_dir)
    out = mt.digest(m["health"], m["fitness"], m["type_sig"], m["bonds"], m["missing"], m["hex_ops"], m["adsr"], 10)
    return out.select("occupancy_trend", "fitness_trend", F.col("explore.num").alias("explore_num"), F.col("explore.denom").alias("explore_denom"), "over_extended", "collapsed", F.round("sustain", 6).alias("sustain"), F.round("early", 6).alias("early"))


@REGISTRY.add(f"""WITH {_TABLES}, top AS (SELECT tag, "count", gen FROM type_sig WHERE "count" > 0 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY "count" DESC, gen DESC) = 1),
b AS (SELECT t.tag, coalesce(b.n, 0) AS num, t."count" AS denom FROM top t LEFT JOIN (SELECT tag, gen, count(*) AS n FROM bonds GROUP BY tag, gen) b ON b.tag = t.tag AND b.gen = t.gen),
s AS (SELECT tag, gen, "count" - lag("count") OVER (PARTITION BY tag ORDER BY gen) AS d FROM missing), m AS (SELECT tag, coalesce(arg_max(d, gen), 0) AS delta FROM s GROUP BY tag)
SELECT tag, num, denom, delta FROM b FULL JOIN m USING (tag)""")
def digest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest's entry of each tag: its bond rate and the change of its missing ones."""
    m = _metrics(spark, sf_dir)
    out = mt.digest(m["health"], m["fitness"], m["type_sig"], m["bonds"], m["missing"], m["hex_ops"], m["adsr"], 10)
    return out.select(F.explode("types").alias("tag", "d")).select("tag", "d.rate.num", "d.rate.denom", "d.delta")


@REGISTRY.add("SELECT doc_id, NOT contains(encode(substr(text, 1, 512)), '\\x00'::BLOB) AS is_text, CASE WHEN source IN ('txt', 'md', 'text', '') THEN 'plain' WHEN source = 'pdf' THEN 'pdf' WHEN source = 'html' THEN 'pandoc' END AS extractor FROM documents WHERE text IS NOT NULL".replace("NOT contains(encode(substr(text, 1, 512)), '\\x00'::BLOB)", "NOT regexp_matches(left(hex(encode(text)), 1024), '^(?:..)*?00')"))
def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text looks like text, and which extractor its source's name would ask for."""
    rows = load(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", files.is_text(F.encode("text", "UTF-8")).alias("is_text"), files.extractor(F.col("source")).alias("extractor"))


_GO = 'package p{n}\n\nimport "fmt"\n\n// Pair is one.\ntype Pair struct {{\n\tfirst, second int\n}}\n\nfunc (p *Pair) Sum(k int) (total int) {{\n\tif k > 0 {{\n\t\treturn p.first\n\t}}\n\tfmt.Println(k)\n\treturn p.second\n}}\n\nvar limit = {n}\n'


@REGISTRY.add("""WITH n AS (SELECT count(*) AS n FROM part), t(tag, k) AS (VALUES ('package', 1), ('import', 1), ('struct', 1), ('method', 1), ('return', 2), ('if', 1), ('expr', 1), ('ident:type-name', 1), ('ident:method-name', 1), ('ident:receiver', 1), ('ident:param', 1), ('ident:result', 1), ('ident:field-name', 2), ('ident:var-name', 1))
SELECT tag, k * n AS n FROM t, n""")
def go_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a Go file made for each part, counted by tag."""
    ship(spark)
    before, after = _GO.replace("{{", "{").replace("}}", "}").split("{n}", 1)
    between, end = after.split("{n}")
    n = F.col("p_partkey").cast("string")
    docs = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(before), n, F.lit(between), n, F.lit(end)).alias("text"))
    each = source_code.source_elements(docs, F.concat(n, F.lit(".go")), F.col("text"), "go")
    wanted = ["package", "import", "struct", "method", "return", "if", "expr", "ident:type-name", "ident:method-name", "ident:receiver", "ident:param", "ident:result", "ident:field-name", "ident:var-name"]
    return each.where(F.col("tag").isin(wanted)).groupBy("tag").agg(F.count("*").alias("n"))


@REGISTRY.add("""SELECT p_partkey, '{"name":"app-inst' || p_partkey || '","about":"app lattice organism, generation ' || p_size || ', spore ' || substr(md5(p_name), 1, 16) || '"}' AS profile,
  printf('app inst%d gen%d: %d nodes, %d occupied (%.0f%%), fitness=%.3f, %d peers', p_partkey, p_size::BIGINT, 64::BIGINT, p_size::BIGINT, p_size::DOUBLE / 64 * 100, p_retailprice::DOUBLE / 7, p_partkey % 9) AS status,
  [['t', 'app'], ['t', 'lattice'], ['t', 'gen' || p_size]] AS tags FROM part""")
def instance_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile and the state of an instance, one made for each part."""
    rows = load(spark, sf_dir, "part")
    profile = ev.metadata_note("app", F.col("p_partkey"), F.col("p_size"), F.md5("p_name"))
    status = ev.status_note("app", F.col("p_partkey"), F.col("p_size"), F.lit(64), F.col("p_size"), F.col("p_size") / F.lit(64.0), F.col("p_retailprice").cast("double") / 7, F.col("p_partkey") % 9)
    return rows.select("p_partkey", profile["content"].alias("profile"), status["content"].alias("status"), status["tags"].alias("tags"))
