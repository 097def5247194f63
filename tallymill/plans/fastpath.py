"""Prefix sums instead of a fold, for the parts of a log in which every operation succeeds.

Assume that all operations of a component succeed and add up their effects per account,
in log order. If every check holds against the sums before its row, then by induction
each operation does succeed, and the sums are its results. Components where a check fails,
and those with allowances (an approval overwrites, which a sum can't), go to the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fold import EVENT_STRUCT, MAX

SUMMABLE = ("LOAD_BALANCE", "CREDIT", "DEBIT", "TRANSFER", "LEG", "RESERVE", "RELEASE", "CAPTURE")
_BIG = "decimal(38,0)"


def _touches(ops: DataFrame) -> DataFrame:
    """One row per (operation, account): the changes it makes and what it needs."""
    op, amt, self_move = F.col("op"), F.col("amount").cast(_BIG), F.col("a") == F.col("b")
    zero = F.lit(0).cast(_BIG)
    pair = op.isin("TRANSFER", "LEG", "CAPTURE")

    def touch(role: int, account: Column, available: Column, held: Column, creates: Column, needs: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), account.alias("account_id"), available.alias("d_available"), held.alias("d_held"), creates.alias("creates"), needs.alias("needs"))

    first = touch(
        1, F.col("a"),
        F.when(op.isin("LOAD_BALANCE", "CREDIT", "RELEASE"), amt).when(op.isin("DEBIT", "RESERVE") | (op.isin("TRANSFER", "LEG") & ~self_move), -amt).when((op == "CAPTURE") & self_move, amt).otherwise(zero),
        F.when(op == "LOAD_BALANCE", F.coalesce("b", F.lit(0)).cast(_BIG)).when(op == "RESERVE", amt).when(op.isin("RELEASE", "CAPTURE"), -amt).otherwise(zero),
        op.isin("LOAD_BALANCE", "CREDIT"),
        F.when(op.isin("DEBIT", "RESERVE", "TRANSFER", "LEG"), "available").when(op.isin("RELEASE", "CAPTURE"), "held").otherwise("nothing"),
    )
    second = touch(2, F.col("b"), amt, zero, F.lit(True), F.lit("nothing"))
    both = F.when(pair & ~self_move, F.array(first, second)).otherwise(F.array(first))
    return ops.select("component", "log_position", "leg_idx", "op", "asset_id", "a", "b", "amount", F.explode(both).alias("t")).select("*", "t.*").drop("t")


def evaluate(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of the components that need no fold, their components)."""
    fitting = ops.groupBy("component").agg(F.min(F.col("op").isin(*SUMMABLE) & (F.col("amount") >= 0)).alias("fits")).filter("fits").select("component")
    touches = _touches(ops.join(fitting, "component", "left_semi"))
    w = Window.partitionBy("asset_id", "account_id").orderBy("log_position", "leg_idx", "role")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    before = touches.withColumns({
        "available": F.coalesce(F.sum("d_available").over(past), F.lit(0).cast(_BIG)), "held": F.coalesce(F.sum("d_held").over(past), F.lit(0).cast(_BIG)),
        "exists": F.coalesce(F.max("creates").over(past), F.lit(False)),
    })
    amt = F.col("amount").cast(_BIG)
    has = F.when(F.col("needs") == "available", F.col("exists") & (F.col("available") >= amt)).when(F.col("needs") == "held", F.col("exists") & (F.col("held") >= amt)).otherwise(True)
    after = before.withColumns({"new_available": F.col("available") + F.col("d_available"), "new_held": F.col("held") + F.col("d_held")})
    after = after.withColumn("ok", has & (F.col("new_available") <= MAX) & (F.col("new_held") <= MAX))
    good = after.groupBy("component").agg(F.min("ok").alias("ok")).filter("ok").select("component")
    one = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c))).cast("bigint")
    rows = after.join(good, "component", "left_semi").filter("op != 'LOAD_BALANCE'").groupBy("log_position", "leg_idx", "op", "asset_id", "a", "b", "amount").agg(
        one(1, "new_available").alias("av"), one(1, "new_held").alias("held"), one(2, "new_available").alias("other"))
    return rows.select(
        "log_position", "leg_idx", "op", F.lit("SUCCESS").alias("status"), F.col("av").alias("result_balance"), F.lit(None).cast("bigint").alias("result_allowance"),
        F.when(F.col("op").isin("RESERVE", "RELEASE", "CAPTURE"), F.col("held")).alias("result_reserved"), _events().alias("events"),
    ), good


def _events() -> Column:
    op = F.col("op")

    def event(kind, **fields) -> Column:
        names = [f.split(":")[0] for f in EVENT_STRUCT[7:-1].split(",")]
        values = {"kind": F.lit(kind), "asset_id": F.col("asset_id")} | fields
        return F.struct(*[values.get(n, F.lit(None)).alias(n) for n in names]).cast(EVENT_STRUCT)

    def changed(account, new, delta, cause) -> Column:
        return event("BALANCE_CHANGED", account_id=F.col(account), new_balance=F.col(new), delta=delta, cause=F.lit(cause))

    def hold(kind) -> Column:
        return event(kind, account_id=F.col("a"), new_available=F.col("av"), new_reserved=F.col("held"))

    moved = event("TRANSFER", from_account=F.col("a"), to_account=F.col("b"), amount=F.col("amount"))
    none = F.array().cast(f"array<{EVENT_STRUCT}>")
    same = F.col("a") == F.col("b")
    return (
        F.when(op == "CREDIT", F.array(changed("a", "av", F.col("amount"), "CREDIT")))
        .when(op == "DEBIT", F.array(changed("a", "av", -F.col("amount"), "DEBIT")))
        .when(op.isin("TRANSFER", "LEG"), F.when(same, none).otherwise(F.array(changed("a", "av", -F.col("amount"), "TRANSFER_DEBIT"), changed("b", "other", F.col("amount"), "TRANSFER_CREDIT"), moved)))
        .when(op == "RESERVE", F.array(hold("RESERVED")))
        .when(op == "RELEASE", F.array(hold("RELEASED")))
        .when(same, F.array(hold("CAPTURED")))
        .otherwise(F.array(hold("CAPTURED"), changed("b", "other", F.col("amount"), "TRANSFER_CREDIT"), moved))
    )
