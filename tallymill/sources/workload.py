"""Deterministic synthetic workloads from hash arithmetic: any scale, no driver-side loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMMAND_TYPES
from .fixtures import _log


def draw(seed: int, salt: int, below: int, row: str = "id") -> Column:
    """A number in [0, below) for each row."""
    return F.pmod(F.xxhash64(F.col(row), F.lit(seed), F.lit(salt)), F.lit(below)).cast("bigint")


def random_commands(spark: SparkSession, n: int, seed: int, clients: int = 4, accounts: int = 8, assets: int = 3, most: int = 1000) -> DataFrame:
    """All types uniform; each client numbers its commands by taking turns."""
    kinds = F.array(*[F.lit(k) for k in COMMAND_TYPES])
    rows = spark.range(n).select(
        (F.col("id") + 1).alias("log_position"), (F.col("id") % clients + 1).alias("client_id"), F.expr(f"id div {clients}").alias("client_seq"),
        F.get(kinds, draw(seed, 1, len(COMMAND_TYPES)).cast("int")).alias("command_type"), *[(draw(seed, k, accounts) + 1).alias(c) for k, c in ((2, "account_a"), (3, "account_b"), (4, "account_c"))],
        (draw(seed, 5, most) + 1).alias("amount"), draw(seed, 6, assets).alias("asset_id"))
    return _log(rows)


def hot_accounts(spark: SparkSession, n: int, seed: int = 0xC0FFEE, hot: int = 8, cold: int = 1000, hot_percent: int = 90) -> DataFrame:
    """Unit transfers of which most touch few accounts."""
    account = lambda salt: F.when(draw(seed, salt, 100) < hot_percent, draw(seed, salt + 10, hot) + 1).otherwise(draw(seed, salt + 20, cold) + hot + 1)
    null = F.lit(None).cast("bigint")
    return _log(spark.range(n).select((F.col("id") + 1).alias("log_position"), F.lit(1).cast("bigint").alias("client_id"), F.col("id").alias("client_seq"), F.lit("TRANSFER").alias("command_type"), account(1).alias("account_a"), account(2).alias("account_b"), null.alias("account_c"), F.lit(1).cast("bigint").alias("amount"), F.lit(0).cast("bigint").alias("asset_id")))


def unit_transfers(spark: SparkSession, n: int, source: int = 100, target: int = 200) -> DataFrame:
    """One credit of ``n`` and ``n`` transfers of 1."""
    first = F.col("id") == 0
    null = F.lit(None).cast("bigint")
    return _log(spark.range(n + 1).select((F.col("id") + 1).alias("log_position"), F.lit(1).cast("bigint").alias("client_id"), F.col("id").alias("client_seq"), F.when(first, "CREDIT").otherwise("TRANSFER").alias("command_type"), F.lit(source).cast("bigint").alias("account_a"), F.when(~first, F.lit(target).cast("bigint")).alias("account_b"), null.alias("account_c"), F.when(first, F.lit(n).cast("bigint")).otherwise(F.lit(1).cast("bigint")).alias("amount"), F.lit(0).cast("bigint").alias("asset_id")))


def risk_traffic(spark: SparkSession, accounts: int = 120, balance: int = 1_000_000, background: int = 400, seed: int = 42, spikes: int = 4, burst: int = 30, hubs: int = 3, spokes: int = 30, spoke_amount: int = 100) -> DataFrame:
    """Funded accounts, background transfers, bursts from a few accounts, and hubs that many accounts pay into."""
    i, null = F.col("id"), F.lit(None).cast("bigint")

    def part(n, position, kind, a, b, amount):
        return spark.range(n).select((i + position).cast("bigint").alias("log_position"), F.lit(1).cast("bigint").alias("client_id"), (i + position).cast("bigint").alias("client_seq"), F.lit(kind).alias("command_type"), a.cast("bigint").alias("account_a"), b.cast("bigint").alias("account_b"), null.alias("account_c"), amount.cast("bigint").alias("amount"), F.lit(0).cast("bigint").alias("asset_id"))

    at = 1
    out = part(accounts, at, "CREDIT", i + 1, null, F.lit(balance))
    at += accounts
    out = out.unionByName(part(background, at, "TRANSFER", draw(seed, 1, accounts) + 1, draw(seed, 2, accounts) + 1, draw(seed, 3, 50) + 1))
    at += background
    out = out.unionByName(part(spikes * burst, at, "TRANSFER", i % spikes + 1, draw(seed, 4, accounts) + 1, draw(seed, 5, 50) + 1))
    at += spikes * burst
    return _log(out.unionByName(part(hubs * spokes, at, "TRANSFER", i % spokes + 1 + spikes, F.expr(f"id div {spokes}") + accounts - hubs + 1, F.lit(spoke_amount))))
