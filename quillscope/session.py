"""Session factory, shared scratch space and table loading."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch at most (but for a single larger row), so that batches of long texts fit a worker's memory.
ARROW_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for each application, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quillscope-zip-"), "quillscope.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors that the cluster names in ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the executors")
    made = tempfile.mkdtemp(prefix="quillscope-")
    spark.conf.set("spark.checkpoint.dir", Path(made).as_uri())
    return Path(made).as_uri()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    target, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the shared folder as text."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there whole or not at all."""
    part, fs = _file_system(spark, path.rpartition("/")[0] + "/." + path.rpartition("/")[2])
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _file_system(spark, path)
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder, if it can be."""
    try:
        target, fs = _file_system(spark, path)
        fs.delete(target, True)
    except Exception:  # the session may be gone already
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage; they go when the program ends.

    A written table survives the loss of any executor, and is compressed and columnar, so later
    reads take only the columns they need.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.root)

    def drop(self) -> None:
        """Free the space now; nothing may read these tables any more."""
        remove(self.spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))
