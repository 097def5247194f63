"""Scalar functions of the ledger, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1


def add_overflows(a, b) -> Column:
    """Whether two longs add up to more than a long holds."""
    return F.try_add(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b).isNull()


def is_negative(amount="amount") -> Column:
    return F.col(amount) < 0


def default_asset(asset="asset_id") -> Column:
    return F.coalesce(F.col(asset), F.lit(0).cast("long"))


def slot_index(seq, window: int) -> Column:
    return F.col(seq).bitwiseAND(F.lit(window - 1).cast("long"))


def uint16(value) -> Column:
    return F.col(value).bitwiseAND(F.lit(65535))


def code_of(column, codes: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(column))


def name_of(column, codes: dict[str, int]) -> Column:
    pairs = [F.lit(x) for k, v in codes.items() for x in (v, k)]
    return F.element_at(F.create_map(*pairs), F.col(column))


def sanitise_label(label) -> Column:
    """A metric label with everything but letters, digits, ``_`` and ``:`` replaced."""
    return F.regexp_replace(F.col(label), "[^a-zA-Z0-9_:]", "_")


def event_key(position="log_position", index="event_index") -> Column:
    return F.struct(F.col(position), F.col(index))


def is_stale(key: Column, high_water_mark: Column) -> Column:
    """Whether an event was seen: its (position, index) is at or below the mark."""
    return F.coalesce(key <= high_water_mark, F.lit(False))


def hop_risk(hop="hop") -> Column:
    return F.when(F.col(hop) == 1, "CRITICAL").when(F.col(hop) == 2, "HIGH").when(F.col(hop) == 3, "MEDIUM").otherwise("LOW")


def fits(limit: int, element: int, header: int = 4, budget: int = 65_536) -> int:
    """How many fixed-size elements fit into a response of ``budget`` bytes after ``limit``."""
    return max(0, (budget - limit - header) // element)


def write_retry(now="now", deadline="deadline", retries="retries", force="force_resend", in_use="in_use", max_retries="max_retries") -> Column:
    """WAIT, RETRY or EXPIRE of a submitted command; due exactly at its deadline."""
    c = F.col
    due = c(force) | (c(now) - c(deadline) >= 0)
    return F.when(~c(in_use) | ~due, "WAIT").when((c(max_retries) > 0) & (c(retries) >= c(max_retries)), "EXPIRE").otherwise("RETRY")


def read_retry(now="now", deadline="deadline", submitted="submitted", retries="retries", ready="ready", timeout="message_timeout", max_retries="max_retries") -> Column:
    """The same for a query, which also expires once its whole budget is spent."""
    c = F.col
    spent = (c(now) - c(submitted) > c(timeout)) | ((c(max_retries) > 0) & (c(retries) >= c(max_retries)))
    return F.when(~c(ready) | (c(now) - c(deadline) < 0), "WAIT").when(spent, "EXPIRE").otherwise("RETRY")
