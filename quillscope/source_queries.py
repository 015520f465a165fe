"""Queries over files: tables are written as files first and then read as a corpus, as samples or as a stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feed_queries import _N
from .functions.keys import norm_key
from .operators import detect as det
from .registry import Registry
from .session import Scratch, load
from .sources import feed, files
from .streaming import live
from .text_queries import _PROBE, _SCORED, TOKENS, _trained, train_model

REGISTRY = Registry()


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The names of parts as text files, one folder a brand."""
    path = Scratch(spark, "files").path("parts")
    load(spark, sf_dir, "part").select("p_brand", "p_name").repartition("p_brand").write.partitionBy("p_brand").text(path)
    return path


@REGISTRY.add("""SELECT replace('p_brand=' || p_brand, '#', '%23') AS model, sum(strlen(p_name) + 1)::BIGINT AS n_bytes FROM part GROUP BY p_brand""")
def tier_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each folder of text files."""
    tiers = files.tiers(spark, _folder(spark, sf_dir))
    return tiers.groupBy("model").agg(F.sum("length").cast("bigint").alias("n_bytes"))


@REGISTRY.add("SELECT 'txt' AS ext, 'plain' AS extractor, count(*) AS n_lines, sum(strlen(p_name))::BIGINT AS n_bytes FROM part")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes that the extractor of plain text gives of all files of a corpus, with the files that are walked over left out."""
    corpus = files.train_corpus(spark, _folder(spark, sf_dir), least=1)
    texts = files.extract(corpus).join(corpus.select("path", "ext"), "path")
    each = texts.select("ext", files.extractor(F.col("ext")).alias("extractor"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return each.groupBy("ext", "extractor").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"))


@REGISTRY.add("""WITH d AS (SELECT DISTINCT replace('p_brand=' || p_brand, '#', '%23') AS folder FROM part) SELECT folder FROM (SELECT folder, row_number() OVER (ORDER BY folder) AS i FROM d) WHERE i <= 7""")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of the first seven files in the order of a walk (each folder has one)."""
    return files.text_corpus(spark, _folder(spark, sf_dir), most=7, least=1).select(F.get(F.split("rel", "/"), F.lit(0)).alias("folder"))


@REGISTRY.add("""SELECT model, coalesce(domain, '') AS domain, count(*) AS n, sum(strlen(generation))::BIGINT AS n_bytes FROM raid_csv WHERE attack = 'none' AND model <> 'human' AND strlen(generation) >= 100 GROUP BY ALL""")
def csv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean machine samples from a CSV file with line breaks and quotes in its fields."""
    path = Scratch(spark, "files").path("samples")
    load(spark, sf_dir, "raid_csv").select("model", "attack", "domain", "generation").write.csv(path, header=True, quote='"', escape='"', quoteAll=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = files.samples_csv(spark, path)
    return rows.groupBy("model", F.coalesce("domain", F.lit("")).alias("domain")).agg(F.count("*").alias("n"), F.sum(F.octet_length("generation")).alias("n_bytes"))


@REGISTRY.add(f"SELECT DISTINCT {_N.format('id')} AS id FROM nostr_event WHERE id IS NOT NULL AND created_at > 0")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a stream of JSON lines, each once within the watermark, written by a query that runs until it has caught up. What is dated at the epoch or before is late from the start."""
    scratch = Scratch(spark, "stream")
    rows = load(spark, sf_dir, "nostr_event").where("id is not null")
    rows.select("id", "pubkey", F.coalesce("created_at", F.lit(0)).alias("created_at"), "kind", "tags", "content", "sig").write.json(scratch.path("in"))
    events = live.once(live.with_time(feed.json_stream(spark, scratch.path("in"), per_trigger=1_000_000, valid_only=False)))
    run = events.select("id").writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("marks")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("id string").parquet(scratch.path("out"))


@REGISTRY.add(f"SELECT delivery_id FROM nostr_event WHERE kind IN (1, 30023) AND created_at >= 1700000000 ORDER BY created_at DESC, {_N.format('id')}, delivery_id LIMIT 50")
def newest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription with a limit."""
    rows = load(spark, sf_dir, "nostr_event").withColumn("id", F.concat_ws(" ", norm_key(F.col("id")), F.lpad(F.col("delivery_id").cast("string"), 20, "0")))
    return feed.subscribe(rows, 50, kinds=[1, 30023], since=1700000000).select("delivery_id")


def _of_notes(sql: str) -> str:
    """Steps over the tokens of documents as steps over those of notes, under other names."""
    return re.sub(r"\b(hexed|piece|each|sized|tok)\b", r"n_\1", sql).replace("FROM documents", "FROM notes")


@REGISTRY.add(f"""WITH notes AS (SELECT delivery_id AS doc_id, content AS text FROM nostr_event WHERE kind = 1 AND strlen(content) >= 50 AND NOT contains(content, 'https://our.example')),
{_trained("model IS NULL")}, {_of_notes(TOKENS)}, {_of_notes(_PROBE.replace("WINDOW", "500"))}, {_SCORED}
SELECT {_N.format("id")} AS id, count(*) AS n FROM scored s JOIN nostr_event e ON e.delivery_id = s.doc_id WHERE combined >= 0 AND least(1.0::DOUBLE, 3 * abs(combined)) >= 0.5 GROUP BY 1""")
def watched_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of a stream that would be answered, with their deliveries: routing by kind, filters, verdicts and triggers in one live query."""
    model = det.Model.from_rows(train_model(spark, sf_dir))
    scratch = Scratch(spark, "stream")
    load(spark, sf_dir, "nostr_event").select("id", "pubkey", "created_at", "kind", "tags", "content", "sig").write.json(scratch.path("in"))
    found = live.watch(feed.json_stream(spark, scratch.path("in"), per_trigger=4, valid_only=False), model, own_sign="https://our.example")
    run = found.select("id").writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("marks")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("id string").parquet(scratch.path("out")).groupBy(norm_key(F.col("id")).alias("id")).agg(F.count("*").alias("n"))


@REGISTRY.add(r"""WITH RECURSIVE u AS (SELECT t[2] AS raw FROM (SELECT unnest(tags) AS t FROM nostr_event WHERE kind = 10002) WHERE t[1] = 'r' AND (t[3] IS NULL OR t[3] <> 'read')),
n AS (SELECT regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '/+$', '') AS url FROM u) SELECT DISTINCT url FROM n WHERE regexp_matches(url, '^wss?://') AND NOT regexp_matches(lower(url), 'localhost|127\.0\.0\.1')""")
def streamed_relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of relays that a stream of relay lists names, each once."""
    scratch = Scratch(spark, "stream")
    load(spark, sf_dir, "nostr_event").select("id", "pubkey", "created_at", "kind", "tags", "content", "sig").write.json(scratch.path("in"))
    urls = live.relay_urls(feed.json_stream(spark, scratch.path("in"), per_trigger=4, valid_only=False))
    run = urls.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("marks")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("url string").parquet(scratch.path("out"))
