"""Accounts that a log only ever pays into, whose order of operations decides nothing.

An account that is never debited, held or spent from can't make an operation fail but by
overflow, and it can't do that where its start and all amounts meant for it stay below the largest
long. Operations are then not connected by paying into it: it is left out of the conflict keys, the
fold emits what it receives without a balance, and prefix sums over the successful payments give
the balances afterwards. Accounts whose sum passes the largest long stay in the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fold import MAX
from ..sources.scratch import Scratch

_BIG = "decimal(38,0)"


def _roles(ops: DataFrame) -> DataFrame:
    """(asset_id, account_id, spends, amount, start) of the one or two balances an operation touches."""
    op, a, b, c, amount, zero = *(F.col(x) for x in ("op", "a", "b", "c", "amount")), F.lit(0).cast(_BIG)
    pair, delegated = op.isin("TRANSFER", "LEG", "CAPTURE"), op == "DELEGATED_TRANSFER"
    receives = op.isin("CREDIT", "LOAD_BALANCE")
    start = F.when(op == "LOAD_BALANCE", amount.cast(_BIG)).otherwise(zero)

    def role(account, spends, paid, start=zero):
        return F.struct(account.alias("account_id"), spends.alias("spends"), paid.cast(_BIG).alias("amount"), start.alias("start"))

    one = role(F.when(delegated, b).otherwise(a), ~receives, F.when(op == "CREDIT", F.greatest(amount, F.lit(0))).otherwise(0), start)
    two = role(F.when(delegated, c).otherwise(b), F.lit(False), F.greatest(amount, F.lit(0)))
    other = (pair & (a != b)) | (delegated & (b != c))
    rows = ops.filter("op != 'LOAD_ALLOWANCE'").select("asset_id", F.explode(F.when(other, F.array(one, two)).otherwise(F.array(one))).alias("r"))
    return rows.select("asset_id", "r.*")


def find(ops: DataFrame) -> DataFrame:
    """(asset_id, account_id, start): accounts that are only paid into, and what they hold at the start."""
    seen = _roles(ops).groupBy("asset_id", "account_id").agg(F.max("spends").alias("spends"), F.sum("amount").alias("paid"), F.sum("start").alias("start"))
    return seen.filter(~F.col("spends") & (F.col("paid") > 0) & (F.col("paid") + F.col("start") <= F.lit(MAX).cast(_BIG))).select("asset_id", "account_id", F.col("start").cast("bigint").alias("start"))


def mark(ops: DataFrame, sinks: DataFrame) -> DataFrame:
    """``ops`` with ``sink``: whether the account that an operation pays into is one of ``sinks``."""
    target = F.when(F.col("op") == "CREDIT", F.col("a")).when(F.col("op").isin("TRANSFER", "LEG", "CAPTURE"), F.col("b")).when(F.col("op") == "DELEGATED_TRANSFER", F.col("c"))
    named = sinks.select("asset_id", F.col("account_id").alias("_target"), F.lit(True).alias("_sink"))
    return ops.withColumn("_target", target).join(named, ["asset_id", "_target"], "left").withColumn("sink", F.coalesce("_sink", F.lit(False))).drop("_target", "_sink")


def fill(done: DataFrame, sinks: DataFrame, scratch: Scratch) -> DataFrame:
    """``done`` with the balances of what sinks received, in log order.

    The prefix sums are taken in two steps, over ranges of positions and inside them, so that an account
    that a third of the log pays into is spread over tasks.
    """
    missing = lambda e: (e["kind"] == "BALANCE_CHANGED") & e["new_balance"].isNull()
    rows = done.withColumn("hole", F.get(F.filter("events", missing), 0))
    parts = 8 * int(done.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = rows.filter("hole is not null").agg(F.min("log_position"), F.max("log_position")).first()
    if low is None:
        return done
    width = max(1, (high - low) // parts + 1)
    adds = rows.filter("hole is not null").withColumns({"asset_id": F.col("hole.asset_id"), "account_id": F.col("hole.account_id"), "bucket": F.expr(f"(log_position - {low}) div {width}")})
    sums = adds.groupBy("asset_id", "account_id", "bucket").agg(F.sum("hole.delta").alias("n"))
    ahead = Window.partitionBy("asset_id", "account_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows an account
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(sinks, ["asset_id", "account_id"]).withColumn("base", F.col("base") + F.col("start"))
    inside = Window.partitionBy("asset_id", "account_id", "bucket").orderBy("log_position", "leg_idx").rowsBetween(Window.unboundedPreceding, 0)
    summed = adds.withColumn("inside", F.sum("hole.delta").over(inside)).join(scratch.keep(bases.select("asset_id", "account_id", "bucket", "base")), ["asset_id", "account_id", "bucket"])
    new = F.col("base") + F.col("inside")
    events = F.transform("events", lambda e: F.when(missing(e), e.withField("new_balance", new)).otherwise(e))
    filled = summed.select(*[c for c in done.columns if c not in ("events", "result_balance")], F.when(F.col("op") == "CREDIT", new).otherwise(F.col("result_balance")).alias("result_balance"), events.alias("events"))
    return rows.filter("hole is null").drop("hole").unionByName(filled)
