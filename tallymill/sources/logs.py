"""Readers and writers of logs and result tables, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import BATCH_LOG, COMMAND_LOG, EVENTS, QUERY_REQUESTS


def read(spark: SparkSession, path: str, schema: StructType, after: int | None = None) -> DataFrame:
    """A log with an explicit schema; columns an older file lacks are null. ``after``: only later positions (pushed down)."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if after is None else rows.filter(F.col("log_position") > after)


def read_commands(spark, path, after=None):
    return read(spark, path, COMMAND_LOG, after)


def read_batches(spark, path, after=None):
    return read(spark, path, BATCH_LOG, after)


def read_events(spark, path, after=None):
    return read(spark, path, EVENTS, after)


def read_requests(spark, path):
    return read(spark, path, QUERY_REQUESTS)


def read_first_of(spark: SparkSession, paths: list[str], schema: StructType, after: int | None = None, start: int = 0) -> tuple[DataFrame, int]:
    """The first source that can be read, beginning at ``start`` and wrapping around; and which it was."""
    last: Exception | None = None
    for step in range(len(paths)):
        at = (start + step) % len(paths)
        try:
            frame = read(spark, paths[at], schema, after)
            frame.limit(1).count()  # readable, not only listed
            return frame, at
        except Exception as e:  # noqa: BLE001 - any unreadable source means the next one
            last = e
    raise OSError(f"no source of {len(paths)} can be read") from last


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A log as a stream of files, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def known_templates(messages: DataFrame, templates: tuple[str, ...] = ("COMMAND", "BATCH"), column: str = "template") -> DataFrame:
    """Drop messages of kinds this version doesn't know."""
    return messages.filter(F.col(column).isin(*templates))


def write_results(results: DataFrame, path: str) -> None:
    """Results keep absent fields as nulls."""
    results.write.mode("append").parquet(path)


def batch_replies(batch_results: DataFrame) -> DataFrame:
    """One row per batch with its legs' results in request order."""
    leg = F.struct("leg_idx", "status", "has_balance", "result_balance")
    return batch_results.groupBy("log_position", "batch_id_hi", "batch_id_lo", "duplicate").agg(F.sort_array(F.collect_list(leg)).alias("legs"))  # a batch is bounded
