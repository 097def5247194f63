"""Helpers that the corpus operators share: scratch tables, names and safe column access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hand to a Python worker.
ARROW_ROWS = 2_000
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``, or one of our own where unset (tests on one machine)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a worker's memory doesn't grow with the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fresh(name: str, *taken) -> str:
    """A column name that none of the given frames owns (names differ in more than case)."""
    owned = {c.lower() for frame in taken for c in frame.columns}
    while name.lower() in owned:
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive a lost executor.

    ``keep`` writes a DataFrame and reads it back, ``drop`` removes a table that no
    later plan reads. What is not dropped stays until the folder is cleared, because
    the lazily returned result may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:02d}-{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = getattr(frame, "_scratch_path", None)
            if path:
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store the path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def ascii_lower(column):
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
