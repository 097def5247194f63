"""The event journal: one row per fact, keyed by (log_position, event_index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import event_key, is_stale
from ..schemas import EVENTS
from ..sources.scratch import Scratch
from .fold import LEG


def _wide(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS])


def build(marked: DataFrame, dealt: DataFrame, results: DataFrame, legs: DataFrame, done: DataFrame) -> DataFrame:
    """All events of a replay. Duplicates emit nothing; each rejected command or leg emits one COMMAND_REJECTED.

    A command's events count from 0; a batch's count through all its legs in order. A
    successful move to oneself changes nothing and emits nothing.
    """
    times = marked.select("log_position", "timestamp")
    single = done.filter(f"op != '{LEG}'").select("log_position", F.posexplode("events").alias("event_index", "e")).select("log_position", "event_index", "e.*").join(times, "log_position")
    rejected = results.filter("not duplicate and status != 'SUCCESS'").select("log_position", F.col("status").alias("reason"))
    named = rejected.join(marked.select("log_position", "timestamp", "asset_id", F.col("account_a").alias("account_id"), "amount", "command_type"), "log_position")
    refused = named.withColumns({"event_index": F.lit(0), "kind": F.lit("COMMAND_REJECTED")})

    batch_times = dealt.filter("not duplicate").select("log_position", "timestamp", "legs")
    moved = done.filter(f"op = '{LEG}' and status = 'SUCCESS'").select("log_position", "leg_idx", F.posexplode("events").alias("k", "e")).select("log_position", "leg_idx", "k", "e.*")
    failed = legs.filter("not duplicate and status != 'SUCCESS'").select("log_position", "leg_idx", F.col("status").alias("reason")).join(batch_times.select("log_position", "legs"), "log_position")
    leg = F.get("legs", F.col("leg_idx"))
    failed = failed.select("log_position", "leg_idx", F.lit(0).alias("k"), "reason", F.lit("COMMAND_REJECTED").alias("kind"), F.coalesce(leg["asset_id"], F.lit(0).cast("bigint")).alias("asset_id"), leg["from_id"].alias("account_id"), leg["amount"].alias("amount"), F.lit("TRANSFER").alias("command_type"))
    both = moved.unionByName(failed, allowMissingColumns=True)
    w = Window.partitionBy("log_position").orderBy("leg_idx", "k")  # one batch, bounded by its size limit
    batched = both.withColumn("event_index", F.row_number().over(w) - 1).join(batch_times.select("log_position", "timestamp"), "log_position")
    return _wide(single).unionByName(_wide(refused)).unionByName(_wide(batched))


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("kind") == kind)


def dispatch(events: DataFrame, listeners: dict[str, object]) -> None:
    """Hand each kind's events to its listener (a callable on a DataFrame); kinds without one are skipped."""
    for kind, listener in listeners.items():
        listener(of_kind(events, kind))


def tallies(events: DataFrame) -> DataFrame:
    """Event counts as a verifier keeps them: total, balance changes, transfers, allowances, holds, rejections."""
    n = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("bigint")), F.lit(0)).cast("bigint")
    return events.agg(
        F.count("*").alias("total"), n("BALANCE_CHANGED").alias("balance_changed"), n("TRANSFER").alias("transfers"), n("ALLOWANCE_CHANGED").alias("allowance_changed"),
        n("RESERVED", "CAPTURED", "RELEASED").alias("holds"), n("COMMAND_REJECTED").alias("rejected"),
    )


def nets(events: DataFrame) -> DataFrame:
    """(log_position, net): the sum of the deltas of each log entry that moves funds between accounts."""
    causes = ("TRANSFER_DEBIT", "TRANSFER_CREDIT", "DELEGATED_DEBIT", "DELEGATED_CREDIT")
    paired = events.filter(F.col("cause").isin(*causes))
    captured = events.filter("kind = 'CAPTURED'").select("log_position").distinct()
    return paired.join(captured, "log_position", "left_anti").groupBy("log_position").agg(F.sum("delta").alias("net"))


def conservation(events: DataFrame) -> DataFrame:
    """Log entries whose transfer deltas don't cancel; empty on a sound journal."""
    return nets(events).filter("net != 0")


def drop_stale(journal: DataFrame, arrival: str = "arrival", stream: str | None = None) -> DataFrame:
    """Keep events above the highest key seen before them in order of arrival, per stream of events.

    Unlike dropping equal rows this also drops late keys. Several streams spread over tasks. One stream
    is cut into ranges of arrival: each range starts from the highest key of those before it (one row a
    range), and its own rows follow in a window of that range.
    """
    if stream:
        w = Window.partitionBy(stream).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
        marked = journal.withColumn("_mark", F.max(event_key()).over(w))
        return marked.filter(~is_stale(event_key(), F.col("_mark"))).drop("_mark")
    parts = int(journal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = Scratch(journal.sparkSession).keep(journal.repartitionByRange(parts, arrival).sortWithinPartitions(arrival).withColumn("_at", F.monotonically_increasing_id()))
    cut = run.withColumn("_range", F.shiftright("_at", 33))
    tops = cut.groupBy("_range").agg(F.max(event_key()).alias("_top"))
    before = tops.select("_range", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))  # one row a range
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    marked = cut.withColumn("_own", F.max(event_key()).over(inside)).join(F.broadcast(before), "_range")
    return marked.filter(~is_stale(event_key(), F.greatest("_own", "_base"))).select(*journal.columns)
