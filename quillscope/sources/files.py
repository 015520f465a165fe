"""Folders of files as tables: corpora of text, tiers of models, samples in CSV; and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..session import ship

# Extensions by extractor, and the columns of the verdict log.
PLAIN = ["txt", "md", "text", ""]
PANDOC = ["html", "htm", "docx", "epub", "rtf", "odt", "rst", "latex", "tex", "org"]
CRAWL_COLUMNS = ["timestamp", "event_id", "pubkey", "human", "confidence", "deep_walk", "long_miss", "troll_score", "label", "troll_label"]


def _hidden(spark: SparkSession, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """(folders, files with their sizes) below a folder whose names start with a dot or an underscore, which Spark's listing leaves out.

    Each depth is listed by one pattern where the files are; only what it matches comes here.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders, found, level = [], [], folder.rstrip("/")
    while True:
        for status in fs.globStatus(fs_path(level + "/{.,_}*")) or []:
            if status.isDirectory():
                folders.append(status.getPath().toString())
            else:
                found.append((status.getPath().toString(), status.getLen()))
        level += "/*"
        if not fs.globStatus(fs_path(level + "/*")):
            return folders, found


def _read_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        content = []
        for path in frame["path"]:
            local = re.match(r"file:/+", path)
            fs, name = (pa_fs.LocalFileSystem(), "/" + path[local.end() :]) if local else pa_fs.FileSystem.from_uri(path)
            with fs.open_input_stream(name) as f:
                content.append(f.read())
        yield frame.assign(content=content)


def binary_files(spark: SparkSession, folder: str, hidden: bool = True) -> DataFrame:
    """(path, rel, length, content, ext): every file below a folder; content is read only if it is used.

    Names that start with a dot or an underscore are listed too unless ``hidden`` is false (then a plain listing by Spark is all).
    """
    folders, single = _hidden(spark, folder) if hidden else ([], [])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([folder, *folders]).select("path", "length", "content")
    if single:
        ship(spark)
        names = spark.createDataFrame(single, "path string, length bigint")
        files = files.unionByName(names.mapInPandas(_read_bytes, "path string, length bigint, content binary"))
    root = folder.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.col("path"), "^.*?" + _literal(root) + "/", "")
    ext = F.lower(F.regexp_extract(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 1), r"\.([^.]*)$", 1))
    return files.select("path", rel.alias("rel"), "length", "content", ext.alias("ext"))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def walk_order() -> Column:
    """Orders files as a walk does: by the names along the path, not by the path as text."""
    return F.split(F.col("rel"), "/")


def train_corpus(spark: SparkSession, folder: str, least: int = 100) -> DataFrame:
    """Files of at least ``least`` bytes that no name along the path starting with a dot hides."""
    files = binary_files(spark, folder).where(F.col("length") >= least)
    return files.where(~F.exists(F.split("rel", "/"), lambda x: F.startswith(x, F.lit("."))))


def text_corpus(spark: SparkSession, folder: str, most: int = 0, least: int = 200) -> DataFrame:
    """Files named .txt of at least ``least`` bytes; the first ``most`` in walk order (0: all)."""
    files = binary_files(spark, folder).where((F.col("length") >= least) & (F.col("ext") == "txt"))
    return files.orderBy(walk_order()).limit(most) if most > 0 else files


def tiers(spark: SparkSession, folder: str, least: int = 10) -> DataFrame:
    """Text files one folder down, with the folder's name as ``model``; empty tiers have no rows."""
    files = binary_files(spark, folder).where((F.col("length") >= least) & (F.col("ext") == "txt") & (F.size(F.split("rel", "/")) >= 2))
    return files.withColumn("model", F.get(F.split("rel", "/"), F.lit(0)))


def samples_csv(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Clean machine samples of a CSV with a header: (model, domain, generation). A missing column is an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    lacking = {"model", "attack", "domain", "generation"} - set(rows.columns)
    if lacking:
        raise ValueError(f"{path} lacks the columns {sorted(lacking)}")
    return clean_samples(rows, least)


def clean_samples(rows: DataFrame, least: int = 100) -> DataFrame:
    keep = (F.col("attack") == "none") & (F.col("model") != "human") & (F.octet_length("generation") >= least)
    return rows.where(keep).select("model", "domain", "generation")


def is_text(content: Column) -> Column:
    """No zero byte among the first 512; an empty file is text."""
    return ~F.coalesce(F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?00"), F.lit(False))


def extractor(ext: Column) -> Column:
    """Which extractor a file name's extension asks for; null for none."""
    return F.when(ext.isin(*PLAIN), "plain").when(ext == "pdf", "pdf").when(ext.isin(*PANDOC), "pandoc")


def html_text(html: Column) -> Column:
    """The text of an HTML page: without scripts, styles, comments and tags; entities read; white space joined."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|h[1-6]|li|tr)\s*>|<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n ?(?:\n ?)*", "\n"))


def extract(files: DataFrame, external=None) -> DataFrame:
    """(path, rel, text): plain files decoded, HTML by expressions, others by ``external`` (a column function of content and extension), else left out.

    Bytes that are no UTF-8 become replacement characters.
    """
    text = F.call_function("make_valid_utf8", F.col("content").cast("string"))
    kind = extractor(F.col("ext"))
    found = F.when(kind == "plain", text).when(F.col("ext").isin("html", "htm"), html_text(text))
    if external is not None:
        found = found.when(kind.isNotNull(), external(F.col("content"), F.col("ext")))
    return files.where(kind.isNotNull()).select("path", "rel", found.alias("text")).where("text is not null")


def crawl_rows(verdicts: DataFrame) -> DataFrame:
    """The ten columns of the verdict log, numbers with four decimals."""
    four = lambda c: fixed(F.col(f"verdict.{c}"), 4)
    return verdicts.select(
        F.col("created_at").alias("timestamp"), F.col("id").alias("event_id"), "pubkey", "verdict.human", four("confidence").alias("confidence"), four("deep_walk").alias("deep_walk"),
        four("long_miss_rate").alias("long_miss"), four("troll_score").alias("troll_score"), "verdict.label", "verdict.troll_label",
    )


def write_crawl_csv(verdicts: DataFrame, path: str) -> None:
    """Append to a folder of CSV files, each with a header."""
    crawl_rows(verdicts).write.mode("append").csv(path, header=True)
