"""Schemas, fixed codes and configuration of the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Stable codes of the log and journal formats.
COMMAND_TYPES = {
    "CREDIT": 0, "DEBIT": 1, "TRANSFER": 2, "APPROVE": 3, "INCREASE_ALLOWANCE": 4,
    "DECREASE_ALLOWANCE": 5, "DELEGATED_TRANSFER": 6, "RESERVE": 7, "CAPTURE": 8, "RELEASE": 9,
}
STATUS_CODES = {
    "SUCCESS": 0, "INSUFFICIENT_BALANCE": 1, "INSUFFICIENT_ALLOWANCE": 2, "INVALID_ACCOUNT": 3, "DUPLICATE": 4,
    "OVERFLOW": 5, "INVALID_AMOUNT": 6, "INSUFFICIENT_RESERVED": 7, "INVALID_CHAIN": 8,
}
EVENT_CAUSES = {"CREDIT": 0, "DEBIT": 1, "TRANSFER_DEBIT": 2, "TRANSFER_CREDIT": 3, "DELEGATED_DEBIT": 4, "DELEGATED_CREDIT": 5}
EVENT_KINDS = ("BALANCE_CHANGED", "RESERVED", "CAPTURED", "RELEASED", "TRANSFER", "ALLOWANCE_CHANGED", "COMMAND_REJECTED")
QUERY_TYPES = {"BALANCE": 0, "BATCH_BALANCE": 1, "ALLOWANCE": 2, "TOTAL_SUPPLY": 3}
QUERY_STATUS = {"SUCCESS": 0, "NOT_FOUND": 1, "UNSUPPORTED": 2, "TRUNCATED": 3}
MAX_BATCH_ACCOUNTS = 512
SCHEMA_VERSION = 5


_PLAIN = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "decimal(38,0)": T.DecimalType(38, 0)}


def _type(name: str) -> T.DataType:
    if name.startswith("array<struct<"):
        fields = (f.split(":") for f in name[13:-2].split(","))
        return T.ArrayType(T.StructType([T.StructField(n, _PLAIN[t]) for n, t in fields]))
    return T.ArrayType(_PLAIN[name[6:-1]]) if name.startswith("array<") else _PLAIN[name]


def schema(text: str) -> T.StructType:
    """A StructType from ``name type, name type``; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (c.split(" ", 1) for c in text.split(", "))])


COMMAND_LOG = schema(
    "log_position bigint, timestamp bigint, client_id bigint, client_seq bigint, command_id_hi bigint, command_id_lo bigint, "
    "command_type string, account_a bigint, account_b bigint, account_c bigint, amount bigint, correlation_id bigint, asset_id bigint"
)
LEGS = "array<struct<from_id:bigint,to_id:bigint,amount:bigint,asset_id:bigint,linked:boolean>>"
BATCH_LOG = schema(f"log_position bigint, timestamp bigint, client_id bigint, client_seq bigint, batch_id_hi bigint, batch_id_lo bigint, legs {LEGS}")
BALANCES = schema("asset_id bigint, account_id bigint, available bigint, reserved bigint")
ALLOWANCES = schema("asset_id bigint, owner_id bigint, delegate_id bigint, allowance bigint")
SUPPLY = schema("asset_id bigint, total_supply decimal(38,0)")
COMMAND_DEDUP = schema(
    "client_id bigint, client_seq bigint, command_id_hi bigint, command_id_lo bigint, status string, "
    "result_balance bigint, result_allowance bigint, result_reserved bigint, slot bigint"
)
BATCH_DEDUP = schema("client_id bigint, client_seq bigint, batch_id_hi bigint, batch_id_lo bigint, legs array<struct<leg_idx:int,status:string,result_balance:bigint>>, slot bigint")
EVENT_FIELDS = (
    "kind string, asset_id bigint, account_id bigint, new_balance bigint, delta bigint, cause string, new_available bigint, new_reserved bigint, "
    "from_account bigint, to_account bigint, amount bigint, owner_id bigint, delegate_id bigint, new_allowance bigint, command_type string, reason string"
)
EVENTS = schema(f"log_position bigint, event_index int, timestamp bigint, {EVENT_FIELDS}")
QUERY_REQUESTS = schema("request_id bigint, query_type string, asset_id bigint, account_id bigint, owner_id bigint, delegate_id bigint, account_ids array<bigint>")


def power_of_two(value: int, name: str) -> int:
    if value <= 0 or value & (value - 1):
        raise ValueError(f"{name} must be a positive power of two, not {value}")
    return value


@dataclass(frozen=True)
class Config:
    """Settings that change results, and how the fold is partitioned (which doesn't)."""

    dedup_window: int = 1024
    batch_dedup_window: int = 1024
    max_batch_size: int = 1024
    partition_by: str = "component"  # or "asset"
    fast_path: bool = False

    def __post_init__(self):
        for name in ("dedup_window", "batch_dedup_window", "max_batch_size"):
            power_of_two(getattr(self, name), name)
        if self.partition_by not in ("component", "asset"):
            raise ValueError("partition_by must be 'component' or 'asset'")

    @classmethod
    def load(cls, properties: dict[str, str] | None = None, prefix: str = "ledger.", environ: dict[str, str] | None = None) -> Config:
        """From properties (``ledger.dedupWindow``), then the environment (``LEDGER_DEDUP_WINDOW``), then defaults."""
        import os

        names, out = {"dedup_window": "dedupWindow", "batch_dedup_window": "batchDedupWindow", "max_batch_size": "maxBatchSize"}, {}
        environ = os.environ if environ is None else environ
        for field, key in names.items():
            value = (properties or {}).get(prefix + key, environ.get("LEDGER_" + field.upper()))
            if value is not None:
                out[field] = int(value)
        return cls(**out)
