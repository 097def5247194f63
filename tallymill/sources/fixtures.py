"""Command logs, batches, allowance edges and requests derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MAX_BATCH_ACCOUNTS

BATCH_OFFSET, SUPPLIER_OFFSET = 1_000_001, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def _log(df: DataFrame) -> DataFrame:
    return df.select(
        "log_position", F.col("log_position").alias("timestamp"), "client_id", "client_seq", F.col("log_position").alias("command_id_hi"), F.lit(0).cast("bigint").alias("command_id_lo"),
        "command_type", "account_a", "account_b", "account_c", "amount", F.lit(None).cast("bigint").alias("correlation_id"), "asset_id",
    )


def single_account_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits, debits and holds of each event's user on three assets; some amounts are negative."""
    e, user = table(spark, sf_dir, "events"), F.col("user_id")
    kind = F.when(F.col("event_type") == "signup", "CREDIT").when(F.col("event_type") == "purchase", "DEBIT").when(F.col("event_type") == "click", "RESERVE").when(F.col("event_type") == "view", "RELEASE").otherwise("CAPTURE")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return _log(e.select(
        (F.col("event_id") + 1).alias("log_position"), user.alias("client_id"), seq.cast("bigint").alias("client_seq"), kind.alias("command_type"), (F.col("event_id") % 3).alias("asset_id"),
        user.alias("account_a"), F.when(F.col("event_type") == "error", user).alias("account_b"), F.lit(None).cast("bigint").alias("account_c"),
        (_cents("value") * F.when(F.col("event_id") % 97 == 0, -1).otherwise(1)).alias("amount"),
    ))


def retry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with immediate, late and very late retries under the original sequences."""
    own, e = single_account_log(spark, sf_dir), F.col("log_position") - 1
    copies = F.filter(F.array(
        2 * F.col("log_position") - 1, F.when(e % 10 == 9, 2 * F.col("log_position")), F.when(e % 25 == 0, 2 * (F.col("log_position") + 500)), F.when(e % 50 == 3, 2 * (F.col("log_position") + 5000)),
    ), lambda p: p.isNotNull())
    return own.withColumn("log_position", F.explode(copies))


def multi_account_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten commands among groups of five users on one asset."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    g, even = F.floor(u / 5).cast("bigint"), F.col("event_id") % 2 == 0
    kind = (
        F.when(F.col("event_type") == "signup", "CREDIT")
        .when(F.col("event_type") == "purchase", F.when(even, "TRANSFER").otherwise("DEBIT"))
        .when(F.col("event_type") == "click", F.when(even, "RESERVE").otherwise("APPROVE"))
        .when(F.col("event_type") == "view", F.when(even, "CAPTURE").otherwise("RELEASE"))
        .otherwise(F.when(i % 3 == 0, "DELEGATED_TRANSFER").when(i % 3 == 1, "INCREASE_ALLOWANCE").otherwise("DECREASE_ALLOWANCE"))
    )
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    other = F.when(i % 41 == 0, u).otherwise(g * 5 + (u + 1 + i % 4) % 5)
    return _log(e.select(
        (i + 1).alias("log_position"), u.alias("client_id"), seq.cast("bigint").alias("client_seq"), kind.alias("command_type"), F.lit(0).cast("bigint").alias("asset_id"),
        u.alias("account_a"), other.alias("account_b"), (g * 5 + (u + 2) % 5).alias("account_c"), _cents("value").alias("amount"),
    ))


def funding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One credit of each customer's balance; negative ones are rejected."""
    c, null = table(spark, sf_dir, "customer"), F.lit(None).cast("bigint")
    key = F.col("c_custkey").cast("bigint")
    return _log(c.select((key + 1).alias("log_position"), key.alias("client_id"), F.lit(0).cast("bigint").alias("client_seq"), F.lit("CREDIT").alias("command_type"), F.lit(0).cast("bigint").alias("asset_id"), key.alias("account_a"), null.alias("account_b"), null.alias("account_c"), _cents("c_acctbal").alias("amount")))


def order_batches(spark: SparkSession, sf_dir: str, linked: str = "chain") -> DataFrame:
    """One batch per order, its line items as payments to suppliers; ``linked``: "chain", "threes" (chains of three legs), "none" or "open" (last leg linked too)."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = items.join(orders.select("o_orderkey", "o_custkey"), items["l_orderkey"] == orders["o_orderkey"])
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    leg = F.struct(*order)
    grouped = joined.groupBy("l_orderkey", "o_custkey").agg(F.sort_array(F.collect_list(leg)).alias("items"))  # the lines of one order
    n = F.size("items")
    mark = {"chain": lambda i: i < n - 1, "threes": lambda i: (i % 3 != 2) & (i < n - 1), "none": lambda i: F.lit(False), "open": lambda i: F.lit(True)}[linked]
    legs = F.transform("items", lambda x, i: F.struct(
        F.col("o_custkey").cast("bigint").alias("from_id"), (x["l_suppkey"] + SUPPLIER_OFFSET).cast("bigint").alias("to_id"), F.round(x["l_quantity"] * 100).cast("bigint").alias("amount"),
        F.lit(0).cast("bigint").alias("asset_id"), mark(i).alias("linked")))
    position = (F.col("l_orderkey") + BATCH_OFFSET).cast("bigint")
    return grouped.select(position.alias("log_position"), position.alias("timestamp"), F.col("o_custkey").cast("bigint").alias("client_id"), F.lit(-1).cast("bigint").alias("client_seq"), position.alias("batch_id_hi"), F.lit(0).cast("bigint").alias("batch_id_lo"), legs.alias("legs"))


def batch_retry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders numbered by customer, at every fourth position; every fifth is sent again right after itself, every seventh 40 positions later."""
    own = order_batches(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("client_id").orderBy("log_position")) - 1
    key = F.col("log_position") - BATCH_OFFSET
    copies = F.filter(F.array(4 * F.col("log_position"), F.when(key % 5 == 0, 4 * F.col("log_position") + 1), F.when(key % 7 == 0, 4 * F.col("log_position") + 162)), lambda p: p.isNotNull())
    return own.withColumn("client_seq", seq.cast("bigint")).withColumn("log_position", F.explode(copies))


def edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight commands a customer at the edges of the rules: overflow, null type, null asset, the same account on two assets."""
    c, null = table(spark, sf_dir, "customer"), F.lit(None).cast("bigint")
    key, top = F.col("c_custkey").cast("bigint"), (1 << 63) - 1
    rows = [("CREDIT", None, top - 10), ("CREDIT", 0, 11), (None, 0, 1), ("CREDIT", None, 10), ("DEBIT", 1, 1), ("CREDIT", 1, 7), ("DEBIT", None, 5), ("RESERVE", 1, 8)]
    steps = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(k).cast("string").alias("kind"), F.lit(a).cast("bigint").alias("asset"), F.lit(m).cast("bigint").alias("amount")) for i, (k, a, m) in enumerate(rows)])
    s = c.select(key.alias("key"), F.explode(steps).alias("s"))
    key = F.col("key")
    return _log(s.select((key * 8 + F.col("s.i") + 1).alias("log_position"), key.alias("client_id"), F.lit(-1).cast("bigint").alias("client_seq"), F.col("s.kind").alias("command_type"), F.col("s.asset").alias("asset_id"), key.alias("account_a"), null.alias("account_b"), null.alias("account_c"), F.col("s.amount").alias("amount")))


def allowance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowances from purchases to the user of the next event; the last approval of a triple counts."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    # event ids are dense, so the next event is found by its id instead of a window over all rows
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("delegate_id"))
    own = e.filter("event_type = 'purchase'").join(after, "event_id")
    rows = own.select((F.col("event_id") % 3).alias("asset_id"), F.col("user_id").alias("owner_id"), "delegate_id", _cents("value").alias("allowance"), "event_id")
    return rows.groupBy("asset_id", "owner_id", "delegate_id").agg(F.max_by("allowance", "event_id").alias("allowance"))


def query_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every type over customers, nations and allowance edges; some are absent or unknown."""
    customers, null = table(spark, sf_dir, "customer"), F.lit(None).cast("bigint")
    key, none = F.col("c_custkey").cast("bigint"), F.lit(None).cast("array<bigint>")
    zero = F.lit(0).cast("bigint")

    def ask(df, request, kind, asset=zero, account=null, owner=null, delegate=null, ids=none):
        return df.select(request.cast("bigint").alias("request_id"), F.lit(kind).alias("query_type"), asset.alias("asset_id"), account.cast("bigint").alias("account_id"), owner.alias("owner_id"), delegate.alias("delegate_id"), ids.alias("account_ids"))

    out = ask(customers, key, "BALANCE", account=key)
    i = F.col("id")
    out = out.unionByName(ask(spark.range(3), -1 - i, "BALANCE", account=-1000 - i))
    nations = customers.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(key)).alias("ids"))  # a truncated list is the feature
    out = out.unionByName(ask(nations, F.lit(10_000_000) + F.col("c_nationkey"), "BATCH_BALANCE", ids=F.col("ids")))
    out = out.unionByName(ask(spark.range(1), F.lit(20_000_000), "BATCH_BALANCE", ids=F.sequence(F.lit(0).cast("bigint"), F.lit(599).cast("bigint"))))
    edges = allowance_edges(spark, sf_dir).filter("asset_id = 0")
    pair = 30_000_000 + F.col("owner_id") * 1_000_000 + F.col("delegate_id")
    out = out.unionByName(ask(edges, pair, "ALLOWANCE", owner=F.col("owner_id"), delegate=F.col("delegate_id")))
    out = out.unionByName(ask(spark.range(2), F.lit(-100) - i, "ALLOWANCE", owner=-5 - i, delegate=i))
    out = out.unionByName(ask(spark.range(4), F.lit(-200) - i, "TOTAL_SUPPLY", asset=i))
    unknown = ask(customers, -1000 - key, "HISTORY", account=key).withColumn("query_type", F.when(F.col("account_id") % 2 == 0, "HISTORY"))
    return out.unionByName(unknown)


assert MAX_BATCH_ACCOUNTS == 512
