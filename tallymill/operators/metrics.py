"""Counters, gauges, latency percentiles and health, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import State, counts

#: Counter of each status; a status without one isn't counted there (see ``status_counts`` for all).
_COUNTED = {"INSUFFICIENT_BALANCE": "insufficient_balance", "INSUFFICIENT_ALLOWANCE": "insufficient_allowance", "INVALID_ACCOUNT": "invalid_account", "OVERFLOW": "overflow", "INVALID_AMOUNT": "invalid_amount", "INVALID_CHAIN": "invalid_amount"}


def status_counts(results: DataFrame) -> DataFrame:
    """Fresh results per status."""
    return results.filter("not duplicate").groupBy("status").agg(F.count("*").alias("n"))


def counters(results: DataFrame, batch_results: DataFrame | None = None, batches: DataFrame | None = None) -> DataFrame:
    """One row: commands (a batch is one), duplicates, rejections by reason, evictions. Every leg's status counts."""
    of = lambda status: F.coalesce(F.sum((~F.col("duplicate") & F.col("status").isin(*status)).cast("bigint")), F.lit(0))
    names = sorted(set(_COUNTED.values()))
    by_name = [of([s for s, n in _COUNTED.items() if n == name]).cast("bigint").alias(name) for name in names]
    rows = results.select("duplicate", "status", "evicted", F.lit(1).alias("one"))
    if batch_results is not None:
        rows = rows.unionByName(batch_results.select("duplicate", "status", F.lit(False).alias("evicted"), F.lit(0).alias("one")))
    if batches is not None:
        rows = rows.unionByName(batches.select("duplicate", F.lit(None).cast("string").alias("status"), "evicted", F.lit(1).alias("one")))
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    one = F.col("one") == 1
    return rows.agg(n(one).alias("commands"), n(one & F.col("duplicate")).alias("duplicates"), n(F.col("evicted")).alias("dedup_evicted"), *by_name)


def gauges(state: State) -> DataFrame:
    """One row: accounts, owners with allowances, clients with remembered commands."""
    return counts(state).select(F.col("accounts").alias("balance_count"), F.col("owners").alias("owner_count"), F.col("command_clients").alias("client_count"))


def latency(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """p50, p99, p99.9 and maximum; approximate (bounded memory) unless ``exact``."""
    f = F.percentile if exact else F.percentile_approx
    return df.agg(*[f(column, F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))], F.max(column).alias("max"))


def prometheus(metrics: DataFrame, prefix: str = "ledger_", kind: str = "counter") -> DataFrame:
    """Text lines of a one-row metrics table: ``# TYPE name kind`` and ``name value`` of each column."""
    names = [sanitised(prefix + c) for c in metrics.columns]
    lines = F.array(*[line for c, n in zip(metrics.columns, names) for line in (F.lit(f"# TYPE {n} {kind}"), F.concat(F.lit(n + " "), F.col(c).cast("string")))])
    return metrics.select(F.explode(lines).alias("line"))


def sanitised(label: str) -> str:
    return re.sub("[^a-zA-Z0-9_:]", "_", label)


def health(spark, query=None, applied_position: int = 0, endpoint: str = "", failovers: int = 0, integrity_failures: int = 0) -> DataFrame:
    """One row: whether the follower is healthy, its state, and how far it got."""
    progress = query.lastProgress if query is not None else None
    failed = query is not None and query.exception() is not None
    state = "DEGRADED" if failed else "FOLLOWING" if progress or query is None else "CONNECTING"
    row = (state == "FOLLOWING", state, applied_position, endpoint, failovers, integrity_failures)
    return spark.createDataFrame([row], "healthy boolean, state string, applied_position bigint, endpoint string, failovers bigint, integrity_failures bigint")
