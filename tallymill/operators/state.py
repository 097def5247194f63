"""State tables, derived from the event journal; lookups and ordered scans over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ALLOWANCES, BALANCES, BATCH_DEDUP, COMMAND_DEDUP


@dataclass
class State:
    """The ledger after some log position."""

    balances: DataFrame
    allowances: DataFrame
    command_dedup: DataFrame
    batch_dedup: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(*(spark.createDataFrame([], s) for s in (BALANCES, ALLOWANCES, COMMAND_DEDUP, BATCH_DEDUP)))

    @property
    def supply(self) -> DataFrame:
        return asset_supply(self.balances)

    def views(self, prefix: str = "ledger_") -> None:
        """Register the tables as temporary views for plain SQL."""
        for name in ("balances", "allowances", "supply"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def asset_supply(balances: DataFrame) -> DataFrame:
    """Available plus reserved per asset, in decimals, so that it can't wrap."""
    big = F.col("available").cast("decimal(38,0)") + F.col("reserved").cast("decimal(38,0)")
    return balances.groupBy("asset_id").agg(F.sum(big).cast("decimal(38,0)").alias("total_supply"))


def supply_from_events(events: DataFrame) -> DataFrame:
    """Supply as the sum of credits and debits in the journal."""
    own = events.filter(F.col("cause").isin("CREDIT", "DEBIT"))
    return own.groupBy("asset_id").agg(F.sum(F.col("delta").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total_supply"))


def aggregate_supply(supply: DataFrame) -> DataFrame:
    return supply.agg(F.coalesce(F.sum("total_supply"), F.lit(0)).cast("decimal(38,0)").alias("total_supply"))


def balances_at(events: DataFrame, position: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Balances after a log position (default: the last): the latest event of each account, or what it started with."""
    own = events if position is None else events.filter(F.col("log_position") <= position)
    own = own.filter("account_id is not null and kind != 'COMMAND_REJECTED'")
    rows = own.select("asset_id", "account_id", F.coalesce("new_balance", "new_available").alias("available"), F.col("new_reserved").alias("reserved"), "log_position", "event_index")
    if initial is not None:
        rows = rows.unionByName(initial.select("asset_id", "account_id", "available", "reserved", F.lit(-1).cast("bigint").alias("log_position"), F.lit(-1).alias("event_index")))
    at = F.struct("log_position", "event_index")
    return rows.groupBy("asset_id", "account_id").agg(F.max_by("available", at).alias("available"), F.coalesce(F.max_by("reserved", F.when(F.col("reserved").isNotNull(), at)), F.lit(0).cast("bigint")).alias("reserved"))


def allowances_at(events: DataFrame, position: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Allowances after a log position; explicit zeros stay."""
    own = events if position is None else events.filter(F.col("log_position") <= position)
    rows = own.filter("kind = 'ALLOWANCE_CHANGED'").select("asset_id", "owner_id", "delegate_id", F.col("new_allowance").alias("allowance"), "log_position", "event_index")
    if initial is not None:
        rows = rows.unionByName(initial.select("asset_id", "owner_id", "delegate_id", "allowance", F.lit(-1).cast("bigint").alias("log_position"), F.lit(-1).alias("event_index")))
    return rows.groupBy("asset_id", "owner_id", "delegate_id").agg(F.max_by("allowance", F.struct("log_position", "event_index")).alias("allowance"))


def ordered(table: DataFrame) -> DataFrame:
    """A state table in ascending order of its keys."""
    keys = [c for c in ("asset_id", "client_id", "client_seq", "account_id", "owner_id", "delegate_id") if c in table.columns]
    return table.orderBy(*keys)


def get_balances(keys: DataFrame, balances: DataFrame) -> DataFrame:
    """``keys`` (asset_id, account_id) with available (null: missing), reserved (0) and exists."""
    found = keys.join(balances, ["asset_id", "account_id"], "left")
    return found.withColumn("exists", F.col("available").isNotNull()).withColumn("reserved", F.coalesce("reserved", F.lit(0).cast("bigint")))


def get_allowances(keys: DataFrame, allowances: DataFrame) -> DataFrame:
    """``keys`` (asset_id, owner_id, delegate_id) with the allowance, 0 if there is none."""
    return keys.join(allowances, ["asset_id", "owner_id", "delegate_id"], "left").withColumn("allowance", F.coalesce("allowance", F.lit(0).cast("bigint")))


def counts(state: State) -> DataFrame:
    """Numbers of accounts, assets, owners with allowances, and clients with remembered sequences."""
    a = state.balances.agg(F.count("*").alias("accounts"), F.countDistinct("asset_id").alias("assets"))
    b = state.allowances.agg(F.countDistinct("asset_id", "owner_id").alias("owners"))
    c = state.command_dedup.agg(F.countDistinct("client_id").alias("command_clients"))
    d = state.batch_dedup.agg(F.countDistinct("client_id").alias("batch_clients"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each
