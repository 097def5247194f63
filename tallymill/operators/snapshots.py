"""Snapshots: sorted sections in Parquet and a manifest written last, checked on load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ALLOWANCES, BALANCES, BATCH_DEDUP, COMMAND_DEDUP, SCHEMA_VERSION, SUPPLY, schema
from .state import State, asset_supply

SECTIONS = {"asset_supply": SUPPLY, "balances": BALANCES, "allowances": ALLOWANCES, "command_dedup": COMMAND_DEDUP, "batch_dedup": BATCH_DEDUP}
MANIFEST = schema("log_position bigint, schema_version int, balance_rows bigint, allowance_rows bigint, command_dedup_rows bigint, batch_dedup_rows bigint, asset_count bigint, total_supply decimal(38,0), checksum decimal(38,0), complete boolean")
_KEYS = {"asset_supply": ["asset_id"], "balances": ["asset_id", "account_id"], "allowances": ["asset_id", "owner_id", "delegate_id"], "command_dedup": ["client_id", "client_seq"], "batch_dedup": ["client_id", "client_seq"]}


class SnapshotError(Exception):
    """A snapshot is incomplete or doesn't add up."""


def sections(state: State) -> dict[str, DataFrame]:
    """The sections in order, each sorted by its keys."""
    own = {"asset_supply": state.supply, "balances": state.balances, "allowances": state.allowances, "command_dedup": state.command_dedup, "batch_dedup": state.batch_dedup}
    return {n: own[n].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SECTIONS[n]]).orderBy(*_KEYS[n]) for n in SECTIONS}


def checksum(balances: DataFrame) -> DataFrame:
    total = F.sum(F.col("available").cast("decimal(38,0)") + F.col("reserved").cast("decimal(38,0)"))
    return balances.agg(F.coalesce(total, F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def manifest(state: State, log_position: int) -> DataFrame:
    """The one row that describes a snapshot."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    supply = state.supply.agg(F.count("*").alias("asset_count"), F.coalesce(F.sum("total_supply"), F.lit(0)).cast("decimal(38,0)").alias("total_supply"))
    row = n(state.balances, "balance_rows").crossJoin(n(state.allowances, "allowance_rows")).crossJoin(n(state.command_dedup, "command_dedup_rows")).crossJoin(n(state.batch_dedup, "batch_dedup_rows"))
    row = row.crossJoin(supply).crossJoin(checksum(state.balances)).withColumns({"log_position": F.lit(log_position), "schema_version": F.lit(SCHEMA_VERSION), "complete": F.lit(True)})
    return row.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST])


def write(state: State, path: str, log_position: int) -> None:
    """Write all sections, then the manifest; without it a snapshot counts as incomplete."""
    for name, df in sections(state).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest(state, log_position).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str):
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException:
        rows = []
    if not rows or not rows[0]["complete"]:
        raise SnapshotError(f"{path} has no complete manifest")
    return rows[0]


def load(spark: SparkSession, path: str, check: bool = True) -> tuple[State, int]:
    """State and log position; missing optional values get their defaults, and sums are compared."""
    head = read_manifest(spark, path)
    own = {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SECTIONS.items()}
    zero = F.lit(0).cast("bigint")
    balances = own["balances"].withColumns({"asset_id": F.coalesce("asset_id", zero), "reserved": F.coalesce("reserved", zero)})
    allowances = own["allowances"].withColumn("asset_id", F.coalesce("asset_id", zero))
    state = State(balances, allowances, own["command_dedup"], own["batch_dedup"])
    if check:
        for problem in problems(state, own["asset_supply"], head):
            raise SnapshotError(f"{path}: {problem}")
    return state, head["log_position"]


def problems(state: State, supply: DataFrame, head) -> list[str]:
    """Why a snapshot can't be trusted: its aggregate, its checksum, its row counts, or an asset's supply."""
    out = []
    total = checksum(state.balances).first()["checksum"]
    if total != head["total_supply"]:
        out.append(f"balances add up to {total}, the manifest says {head['total_supply']}")
    if total != head["checksum"]:
        out.append(f"balances add up to {total}, the checksum is {head['checksum']}")
    for name, df in (("balance_rows", state.balances), ("allowance_rows", state.allowances), ("command_dedup_rows", state.command_dedup), ("batch_dedup_rows", state.batch_dedup)):
        if (n := df.count()) != head[name]:
            out.append(f"{name}: {n}, not {head[name]}")
    wrong = asset_supply(state.balances).withColumnRenamed("total_supply", "own").join(supply, "asset_id", "full").filter(~F.col("own").eqNullSafe(F.col("total_supply")) & (F.coalesce("own", F.lit(0)) != F.coalesce("total_supply", F.lit(0)))).limit(1).collect()
    if wrong:
        out.append(f"asset {wrong[0]['asset_id']}: balances add up to {wrong[0]['own']}, its supply is {wrong[0]['total_supply']}")
    return out


def advance(manifests: DataFrame, applied: int) -> DataFrame:
    """The newest complete snapshot beyond the applied position, if any."""
    return manifests.filter((F.col("log_position") > applied) & F.col("complete")).orderBy(F.desc("log_position")).limit(1)


@dataclass
class Loaded:
    state: State | None
    position: int
    tried: list[tuple[str, str]]


def load_newest(spark: SparkSession, paths: list[str], applied: int = -1) -> Loaded:
    """Newest first, one snapshot per path: LOADED, SKIPPED (not newer), CORRUPT (doesn't add up) or FAILED (unreadable)."""
    found, tried = [], []
    for path in paths:  # one small manifest each
        try:
            found.append((read_manifest(spark, path)["log_position"], path))
        except SnapshotError:
            tried.append((path, "FAILED"))
    for position, path in sorted(found, reverse=True):
        if position <= applied:
            tried.append((path, "SKIPPED"))
            continue
        try:
            state, position = load(spark, path)
            return Loaded(state, position, [*tried, (path, "LOADED")])
        except SnapshotError:
            tried.append((path, "CORRUPT"))
    return Loaded(None, applied, tried)


def fingerprint(state: State) -> DataFrame:
    """One row: a hash of all state that doesn't depend on row order or partitioning."""
    parts = None
    for name, df in sections(state).items():
        row = F.sha2(F.concat_ws("\x1f", F.lit(name), *[F.coalesce(F.to_json(F.col(c)) if t.startswith("array") else F.col(c).cast("string"), F.lit("\x00")) for c, t in df.dtypes]), 256)
        own = df.select(*[F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)").alias(f"h{k}") for k in range(5)])
        parts = own if parts is None else parts.unionAll(own)
    total = F.concat_ws("-", *[F.coalesce(F.sum(f"h{k}"), F.lit(0)).cast("string") for k in range(5)])
    return parts.agg(F.sha2(total, 256).alias("fingerprint"))
