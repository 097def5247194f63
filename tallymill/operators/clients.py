"""What clients of the ledger do: number commands, group legs, match results, decide about retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import read_retry, write_retry


def number_commands(submitted: DataFrame, order: str) -> DataFrame:
    """Give each client's commands sequences from 0 in order of submission."""
    seq = F.row_number().over(Window.partitionBy("client_id").orderBy(order)) - 1
    return submitted.withColumn("client_seq", seq.cast("bigint"))


def collect_batches(legs: DataFrame, keys: list[str], max_batch_size: int = 1024) -> DataFrame:
    """Batches from rows of legs (``leg_idx`` orders them); longer ones raise when evaluated."""
    leg = F.struct("leg_idx", "from_id", "to_id", "amount", "asset_id", "linked")
    grouped = legs.groupBy(*keys).agg(F.sort_array(F.collect_list(leg)).alias("l"))
    checked = F.when(F.size("l") > max_batch_size, F.raise_error(F.lit(f"a batch has more than {max_batch_size} legs"))).otherwise(F.col("l"))
    return grouped.withColumn("legs", F.transform(checked, lambda x: F.struct(*[x[c].alias(c) for c in ("from_id", "to_id", "amount", "asset_id", "linked")]))).drop("l")


def correlate(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Match results to pending commands by id: matched, pending (no result) or late (nothing pends)."""
    ids = ["command_id_hi", "command_id_lo"]
    both = pending.withColumn("_p", F.lit(True)).join(results.withColumn("_r", F.lit(True)), ids, "full")
    return both.withColumn("outcome", F.when(F.col("_p") & F.col("_r"), "matched").when(F.col("_p"), "pending").otherwise("late")).drop("_p", "_r")


def decide_writes(pending: DataFrame) -> DataFrame:
    return pending.withColumn("action", write_retry())


def decide_reads(pending: DataFrame) -> DataFrame:
    return pending.withColumn("action", read_retry())


def tallies(actions: DataFrame) -> DataFrame:
    """Client counters from rows of (action, completed, leader_changed)."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    return actions.agg(F.count("*").alias("submitted"), n(F.col("completed")).alias("completed"), n(F.col("action") == "EXPIRE").alias("expired"), n(F.col("leader_changed")).alias("leader_changes"))
