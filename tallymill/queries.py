"""The registered queries of the ledger over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import read_retry, write_retry
from .operators import events as journal
from .operators import graph, metrics, prepass, reads, snapshots
from .operators import state as states
from .operators.replay import Replay, replay
from .operators.state import State
from .schemas import Config
from .sources import fixtures as fx

#: The window of the retry log, as its offsets are made for.
RETRY = Config(dedup_window=16)


def _single(spark, d) -> Replay:
    return replay(fx.retry_log(spark, d), config=RETRY)


def _multi(spark, d) -> Replay:
    return replay(fx.multi_account_log(spark, d))


def _orders(spark, d, linked="chain", config=None) -> Replay:
    return replay(fx.funding_log(spark, d), fx.order_batches(spark, d, linked), config=config)


def _edge_state(spark, d) -> State:
    """Balances of the single-account log with the allowance graph on top."""
    out = replay(fx.single_account_log(spark, d)).state
    return State(out.balances, fx.allowance_edges(spark, d), out.command_dedup, out.batch_dedup)


def command_log_validate(spark, d):
    return prepass.validate(fx.single_account_log(spark, d)).select("log_position", "asset_id", "command_type", "amount", F.coalesce("fault", F.lit("OK")).alias("verdict"))


def _marked(spark, d):
    return prepass.mark_duplicates(fx.retry_log(spark, d), 16)


def dedup_flags(spark, d):
    return _marked(spark, d).select("log_position", "client_id", "client_seq", "duplicate", "evicted", F.col("origin.log_position").alias("origin_position"))


def dedup_evictions(spark, d):
    return _marked(spark, d).groupBy("client_id").agg(F.sum(F.col("duplicate").cast("bigint")).alias("duplicates"), F.sum(F.col("evicted").cast("bigint")).alias("evictions"))


def dedup_final_slots(spark, d):
    return prepass.final_slots(fx.retry_log(spark, d), 16)


def dedup_client_counts(spark, d):
    return prepass.final_slots(fx.retry_log(spark, d), 16).agg(F.countDistinct("client_id").alias("clients"), F.count("*").alias("slots"))


_RESULT = ("log_position", "duplicate", "evicted", "status", "result_balance", "result_allowance", "result_reserved")


def single_account_results(spark, d):
    return _single(spark, d).results.select(*_RESULT)


def dedup_replayed_results(spark, d):
    return _single(spark, d).results.filter("duplicate").select(*_RESULT)


def single_account_balances(spark, d):
    return _single(spark, d).state.balances


def single_account_supply(spark, d):
    return _single(spark, d).state.supply.select("asset_id", F.col("total_supply").cast("bigint").alias("total_supply"))


def status_counts(spark, d):
    return metrics.status_counts(_single(spark, d).results)


def core_counters(spark, d):
    return metrics.counters(_single(spark, d).results)


def size_gauges(spark, d):
    return metrics.gauges(_multi(spark, d).state)


def _typed(spark, d, *kinds):
    log = fx.multi_account_log(spark, d).filter(F.col("command_type").isin(*kinds)).select("log_position", "command_type")
    return _multi(spark, d).results.join(log, "log_position").select("log_position", "command_type", "status", "result_balance", "result_allowance", "result_reserved")


def transfer_results(spark, d):
    return _typed(spark, d, "TRANSFER", "CAPTURE", "CREDIT", "DEBIT", "RESERVE", "RELEASE")


def transfer_balances(spark, d):
    return _multi(spark, d).state.balances


def allowance_results(spark, d):
    return _typed(spark, d, "APPROVE", "INCREASE_ALLOWANCE", "DECREASE_ALLOWANCE")


def delegated_transfer_results(spark, d):
    return _typed(spark, d, "DELEGATED_TRANSFER")


def allowance_final(spark, d):
    return _multi(spark, d).state.allowances


def batch_chains(spark, d):
    legs = prepass.explode_legs(fx.order_batches(spark, d), "log_position")
    return legs.select("log_position", "leg_idx", "chain_id", "chain_last", "from_id", "to_id", "amount")


def batch_structural_rejects(spark, d):
    """Batches over eight legs are too long here; the rest are well formed."""
    return fx.order_batches(spark, d).select("log_position", F.size("legs").alias("legs"), F.coalesce(prepass.batch_fault(8), F.lit("OK")).alias("verdict"))


def batch_oversized_results(spark, d):
    """Leg results of the batches that are too long for a limit of eight: as many as the limit, not as the legs."""
    out = replay(None, fx.order_batches(spark, d).filter(F.size("legs") > 8), config=Config(max_batch_size=8))
    return out.batch_results.groupBy("status").agg(F.count("*").alias("n"))


def batch_leg_results(spark, d):
    return _orders(spark, d).batch_results.select("log_position", "leg_idx", "status", "has_balance", "result_balance")


def batch_independent_legs(spark, d):
    return _orders(spark, d, "none").batch_results.select("log_position", "leg_idx", "status", "has_balance", "result_balance")


def batch_multi_chains(spark, d):
    """Batches whose legs form chains of three."""
    legs = prepass.explode_legs(fx.order_batches(spark, d, "threes"), "log_position")
    return legs.select("log_position", "leg_idx", "chain_id", "chain_last", "from_id", "to_id", "amount")


def batch_multi_chain_results(spark, d):
    return _orders(spark, d, "threes").batch_results.select("log_position", "leg_idx", "status", "has_balance", "result_balance")


def batch_dedup_flags(spark, d):
    log = fx.batch_retry_log(spark, d)
    return prepass.mark_duplicates(log, 16).select("log_position", "client_id", "client_seq", "duplicate", "evicted", F.col("origin.log_position").alias("origin_position"))


def batch_replayed_legs(spark, d):
    """Legs of repeated batches, which repeat the results of their origins."""
    out = replay(fx.funding_log(spark, d), fx.batch_retry_log(spark, d), config=Config(batch_dedup_window=16))
    return out.batch_results.filter("duplicate").select("log_position", "leg_idx", "status", "has_balance", "result_balance")


def batch_events(spark, d):
    """Events of all batches: their index counts through all legs of a batch without a gap."""
    own = _orders(spark, d).events.filter(F.col("log_position") >= fx.BATCH_OFFSET)
    return own.select("log_position", "event_index", "kind", "account_id", "new_balance", "delta", "cause", "from_account", "to_account", "amount", "reason")


def edge_results(spark, d):
    """Overflow, a null type, a null asset, and one account on two assets."""
    return replay(fx.edge_log(spark, d)).results.select("log_position", "status", "result_balance", "result_reserved")


def edge_balances(spark, d):
    return replay(fx.edge_log(spark, d)).state.balances


def batch_open_chain(spark, d):
    return _orders(spark, d, "open").batch_results.groupBy("status").agg(F.count("*").alias("n"))


def batch_supplier_balances(spark, d):
    return _orders(spark, d).state.balances.filter(F.col("account_id") >= fx.SUPPLIER_OFFSET).select("account_id", "available")


def events_exploded(spark, d):
    return _single(spark, d).events.select("log_position", "event_index", "kind", "asset_id", "account_id", "new_balance", "delta", "cause", "new_available", "new_reserved", "command_type", "reason")


def event_counts(spark, d):
    return _multi(spark, d).events.groupBy("kind").agg(F.count("*").alias("n"))


def event_tallies(spark, d):
    return journal.tallies(_single(spark, d).events)


def event_conservation(spark, d):
    """How many log entries move funds, by the sum of their deltas: all by 0."""
    return journal.nets(_multi(spark, d).events).groupBy("net").agg(F.count("*").alias("entries"))


def hwm_dedup(spark, d):
    """A journal whose first fifth is delivered twice, and whose every 50th event arrives late."""
    e = fx.table(spark, d, "events")
    n = e.agg(F.max("event_id")).first()[0] or 0
    key = F.col("event_id")
    once = e.select((key + F.when(key % 50 == 0, 7).otherwise(0) * 1.0).alias("arrival"), F.expr("event_id div 4").alias("log_position"), (key % 4).cast("int").alias("event_index"))
    again = e.filter(key * 5 < n).select((key + 0.5 + n * 0.3).alias("arrival"), F.expr("event_id div 4").alias("log_position"), (key % 4).cast("int").alias("event_index"))
    ordered = once.unionByName(again).withColumn("arrival", F.struct("arrival", "log_position", "event_index"))
    return journal.drop_stale(ordered).select("log_position", "event_index")


def _answers(spark, d):
    customers = replay(fx.funding_log(spark, d))
    state = State(customers.state.balances, fx.allowance_edges(spark, d), customers.state.command_dedup, customers.state.batch_dedup)
    return reads.answer(fx.query_requests(spark, d), state, customers.applied_position)


def balance_lookup(spark, d):
    return _answers(spark, d).filter("query_type = 'BALANCE'").select("request_id", "status", "applied_position", "account_id", "balance", "exists")


def batch_balance_lookup(spark, d):
    own = _answers(spark, d).filter("query_type = 'BATCH_BALANCE'")
    return own.select("request_id", "status", F.posexplode("balances").alias("pos", "b")).select("request_id", "status", "pos", "b.account_id", "b.balance", "b.exists")


def allowance_lookup(spark, d):
    return _answers(spark, d).filter("query_type = 'ALLOWANCE'").select("request_id", "status", "owner_id", "delegate_id", "allowance")


def total_supply_lookup(spark, d):
    return _answers(spark, d).filter("query_type = 'TOTAL_SUPPLY'").select("request_id", "status", "asset_id", "total_supply")


def unsupported_query(spark, d):
    """Requests of an unknown type, or without one."""
    return _answers(spark, d).filter("status = 'UNSUPPORTED'").select("request_id", "query_type", "status", "applied_position")


def state_at_position(spark, d):
    """Balances half way through the single-account log."""
    half = fx.table(spark, d, "events").agg(F.expr("(max(event_id) + 1) div 2")).first()[0]
    return states.balances_at(replay(fx.single_account_log(spark, d)).events, half)


def snapshot_sections(spark, d):
    rows = None
    for name, df in snapshots.sections(_multi(spark, d).state).items():
        own = df.agg(F.lit(name).alias("section"), F.count("*").alias("n"))
        rows = own if rows is None else rows.unionAll(own)
    return rows


def snapshot_checksum(spark, d):
    return snapshots.checksum(_single(spark, d).state.balances).select(F.col("checksum").cast("bigint").alias("checksum"))


def snapshot_resume_equal(spark, d):
    """Whether a replay in one go and one resumed half way end in the same state."""
    log = fx.retry_log(spark, d)
    half = log.agg(F.expr("max(log_position) div 2")).first()[0]
    whole = replay(log, config=RETRY)
    first = replay(log.filter(F.col("log_position") <= half), config=RETRY)
    rest = replay(log.filter(F.col("log_position") > half), initial=first.state, config=RETRY)
    a, b = (snapshots.fingerprint(x.state) for x in (whole, rest))
    held = rest.state.balances.agg(F.count("*").alias("accounts"), F.sum(F.col("available") + F.col("reserved")).alias("held"))
    return a.select(F.col("fingerprint").alias("whole")).crossJoin(b).crossJoin(held).select((F.col("whole") == F.col("fingerprint")).alias("equal"), "accounts", "held")  # one row each


def advance_only_snapshot(spark, d):
    e = fx.table(spark, d, "events").filter("event_id % 1000 = 0")
    manifests = e.select((F.col("event_id") + 1).alias("log_position"), (F.col("event_id") % 3000 != 0).alias("complete"))
    return snapshots.advance(manifests, 2500).select("log_position")


def _grid(spark):
    n = spark.range(2 * 7 * 5 * 4)
    i = F.col("id")
    return n.select((i % 2 == 0).alias("flag"), (F.expr("id div 2") % 7 * 10).alias("now"), F.lit(30).alias("deadline"), (F.expr("id div 14") % 5).alias("retries"), (F.expr("id div 70") % 4).alias("max_retries"))


def retry_policy_write(spark, d):
    own = _grid(spark).withColumns({"force_resend": F.col("retries") == 3, "in_use": F.col("flag")})
    return own.select("flag", "now", "retries", "max_retries", write_retry().alias("action"))


def retry_policy_read(spark, d):
    own = _grid(spark).withColumns({"submitted": F.lit(5), "message_timeout": F.lit(45), "ready": F.col("flag")})
    return own.select("flag", "now", "retries", "max_retries", read_retry().alias("action"))


def latency_percentiles(spark, d):
    return metrics.latency(fx.table(spark, d, "events"), "value", exact=True)


def graph_out_edges(spark, d):
    return graph.edges(fx.allowance_edges(spark, d), "OUT")


def graph_in_edges(spark, d):
    return graph.edges(fx.allowance_edges(spark, d), "IN")


def graph_any_edges(spark, d):
    return graph.edges(fx.allowance_edges(spark, d), "ANY").groupBy("asset_id", "src").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("neighbours"), F.sum("amount").cast("bigint").alias("amount"))


def _graph(spark, d):
    return graph.GraphQuery(_edge_state(spark, d))


def graph_two_hop(spark, d):
    q = _graph(spark, d).hop("a", "b", edge="x").where(graph.leaf("x", "amount", "GTE", 5000)).hop("b", "c", edge="y").where(graph.leaf("y", "amount", "LT", 2000) & (F.col("a") != F.col("c")))
    return q.returns("asset_id", "a", "b", "c", "x_amount", "y_amount", ceiling=None).rows


def graph_optional_match(spark, d):
    q = _graph(spark, d).node("a").where(graph.leaf("a", "balance", "GT", 0)).hop("a", "b", edge="x", optional=True)
    return q.returns("asset_id", "a", "a_balance", "b", "x_amount", ceiling=None).rows


def graph_not_exists(spark, d):
    return _graph(spark, d).node("a").exists("a", "IN", negated=True).returns("asset_id", "a", "a_balance", ceiling=None).rows


def graph_exists_or_not(spark, d):
    """Accounts that someone granted an allowance, either poor or without holds, and not account 7."""
    poor = graph.leaf("a", "balance", "LTE", 20_000) | graph.leaf("a", "reserved", "EQ", 0)
    return _graph(spark, d).node("a").where(poor & graph.leaf("a", "id", "EQ", 7, negated=True) & graph.leaf("a", "balance", "NEQ", 1)).exists("a", "IN").returns("asset_id", "a", "a_balance", "a_reserved", ceiling=None).rows


def graph_bound_target(spark, d):
    """Mutual allowances: the second edge leads back to a variable that is bound."""
    q = _graph(spark, d).hop("a", "b", edge="x").hop("b", "a", edge="y").where(F.col("a") < F.col("b"))
    return q.returns("asset_id", "a", "b", "x_amount", "y_amount", ceiling=None).rows


def graph_aggregate_topk(spark, d):
    q = _graph(spark, d).hop("a", "b", edge="x")
    columns = [F.countDistinct("a").alias("owners"), F.sum("x_amount").cast("bigint").alias("total"), F.min("x_amount").alias("least"), F.max("x_amount").alias("most"), F.count("*").alias("edges")]
    return q.returns(*columns, group_by=["asset_id", "b"], order_by=[F.desc("total"), F.col("asset_id"), F.col("b")], skip=2, limit=10).rows


def graph_var_length(spark, d):
    q = graph.GraphQuery(State(_edge_state(spark, d).balances, fx.allowance_edges(spark, d), None, None))
    return q.hop("a", "z").path("a", "b", 2, 3).returns("asset_id", "a", "b", "b_hop", distinct=True, ceiling=None).rows


def risk_trace_allowance(spark, d):
    edges = fx.allowance_edges(spark, d)
    seeds = edges.select("asset_id", F.col("owner_id").alias("seed")).distinct()
    return graph.trace_allowance(edges, seeds, hops=4).select("asset_id", "seed", "node", "hop", "risk")


def risk_reachability(spark, d):
    """Whether each owner reaches another one, spread over all accounts."""
    edges = fx.allowance_edges(spark, d)
    n = edges.agg(F.max("owner_id") + 1).first()[0] or 1
    pairs = edges.select("asset_id", F.col("owner_id").alias("from_id"), ((F.col("owner_id") * 7 + 3) % n).alias("to_id")).distinct()
    return graph.reachable(edges, pairs, 3).select("asset_id", "from_id", "to_id", "reachable")


def risk_delegation_cycles(spark, d):
    return graph.delegation_cycles(fx.allowance_edges(spark, d), 4)


def risk_hotspots(spark, d):
    return graph.hotspots(fx.allowance_edges(spark, d), 10)


def risk_dormant_allowances(spark, d):
    return graph.dormant_allowances(_edge_state(spark, d))


def risk_concentration(spark, d):
    return graph.concentration(_edge_state(spark, d), 1).select("asset_id", "account_id", "available")


def _transfers(spark, d):
    return graph.transfer_edges(_multi(spark, d).events)


def transfer_velocity(spark, d):
    return graph.velocity(_transfers(spark, d), 1000)


def transfer_fanout(spark, d):
    return graph.fan_out(_transfers(spark, d))


def transfer_recent(spark, d):
    return graph.transfer_edges(_multi(spark, d).events, 50).select("log_position", "from_account", "to_account", "amount")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    skip = {"queries", "replay", "read_retry", "write_retry"}
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in skip}
