"""Read queries: balance, batch balances, allowance and total supply, answered by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import default_asset
from ..schemas import MAX_BATCH_ACCOUNTS, QUERY_REQUESTS
from .state import State

_ZERO = 0
RESPONSES = (
    "request_id bigint, query_type string, status string, applied_position bigint, asset_id bigint, account_id bigint, balance bigint, `exists` boolean, owner_id bigint, "
    "delegate_id bigint, allowance bigint, total_supply bigint, balances array<struct<account_id:bigint,balance:bigint,exists:boolean>>"
)


def _response(df: DataFrame, status: Column, **fields: Column) -> DataFrame:
    own = {"request_id": F.col("request_id"), "query_type": F.col("query_type"), "status": status, "asset_id": F.col("asset_id")} | fields
    names = [(c.split()[0].strip("`"), c.split()[1]) for c in RESPONSES.split(", ")[:-1]] + [("balances", "array<struct<account_id:bigint,balance:bigint,exists:boolean>>")]
    return df.select(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with an id; missing optional fields are null and a null asset is asset 0."""
    rows = requests.select(*[(F.col(f.name) if f.name in requests.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in QUERY_REQUESTS])
    return rows.filter("request_id is not null").withColumn("asset_id", default_asset())


def answer(requests: DataFrame, state: State, applied_position: DataFrame, limit: int = MAX_BATCH_ACCOUNTS) -> DataFrame:
    """One response per request, stamped with the position the state has applied."""
    own = valid_requests(requests)
    of = lambda kind: own.filter(F.col("query_type") == kind)
    zero, ok = F.lit(0).cast("bigint"), F.lit("SUCCESS")
    held = state.balances.select("asset_id", "account_id", "available")

    single = of("BALANCE").drop("account_ids").join(held, ["asset_id", "account_id"], "left")
    found = F.col("available").isNotNull()
    responses = _response(single, F.when(found, ok).otherwise("NOT_FOUND"), account_id=F.col("account_id"), balance=F.coalesce("available", zero), exists=found)

    many = of("BATCH_BALANCE")
    items = many.select("request_id", "asset_id", F.posexplode(F.slice(F.coalesce("account_ids", F.array().cast("array<bigint>")), 1, limit)).alias("pos", "account_id")).join(held, ["asset_id", "account_id"], "left")
    listed = items.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "account_id", F.coalesce("available", zero).alias("balance"), found.alias("exists")))).alias("items"))  # at most `limit` each
    joined = many.join(listed, "request_id", "left")
    rows = F.transform(F.coalesce("items", F.array().cast("array<struct<pos:int,account_id:bigint,balance:bigint,exists:boolean>>")), lambda x: F.struct(x["account_id"], x["balance"], x["exists"]))
    over = F.coalesce(F.size("account_ids"), F.lit(0)) > limit
    responses = responses.unionByName(_response(joined, F.when(over, "TRUNCATED").otherwise(ok), balances=rows))

    granted = of("ALLOWANCE").join(state.allowances, ["asset_id", "owner_id", "delegate_id"], "left")
    responses = responses.unionByName(_response(granted, ok, owner_id=F.col("owner_id"), delegate_id=F.col("delegate_id"), allowance=F.coalesce("allowance", zero)))

    supply = of("TOTAL_SUPPLY").join(state.supply, "asset_id", "left")
    responses = responses.unionByName(_response(supply, ok, total_supply=F.coalesce("total_supply", F.lit(0))))

    unknown = own.filter(F.col("query_type").isNull() | ~F.col("query_type").isin("BALANCE", "BATCH_BALANCE", "ALLOWANCE", "TOTAL_SUPPLY"))
    responses = responses.unionByName(_response(unknown, F.lit("UNSUPPORTED")))
    return responses.drop("applied_position").crossJoin(F.broadcast(applied_position.select("applied_position")))  # one row


def balance(state: State, account_id: int, asset_id: int = 0) -> DataFrame:
    """account_id, balance (0 if missing), exists."""
    one = state.balances.filter((F.col("asset_id") == asset_id) & (F.col("account_id") == account_id))
    return one.agg(F.lit(account_id).cast("bigint").alias("account_id"), F.coalesce(F.max("available"), F.lit(0)).alias("balance"), (F.count("*") > 0).alias("exists"))


def allowance(state: State, owner_id: int, delegate_id: int, asset_id: int = 0) -> DataFrame:
    one = state.allowances.filter((F.col("asset_id") == asset_id) & (F.col("owner_id") == owner_id) & (F.col("delegate_id") == delegate_id))
    return one.agg(F.coalesce(F.max("allowance"), F.lit(0).cast("bigint")).alias("allowance"))


def total_supply(state: State, asset_id: int = 0) -> DataFrame:
    return state.supply.filter(F.col("asset_id") == asset_id).agg(F.coalesce(F.max("total_supply"), F.lit(0)).cast("decimal(38,0)").alias("total_supply"))


def batch_balances(state: State, account_ids: list[int], asset_id: int = 0, limit: int = MAX_BATCH_ACCOUNTS) -> DataFrame:
    """One row per requested id in order (repeats included), the first ``limit`` of them."""
    spark = state.balances.sparkSession
    wanted = spark.createDataFrame([(i, a) for i, a in enumerate(account_ids[:limit])], "pos int, account_id bigint")
    held = state.balances.filter(F.col("asset_id") == asset_id).select("account_id", "available")
    return wanted.join(held, "account_id", "left").select("pos", "account_id", F.coalesce("available", F.lit(0).cast("bigint")).alias("balance"), F.col("available").isNotNull().alias("exists")).orderBy("pos")
