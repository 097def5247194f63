"""Replay of a log: pre-pass, fold by component, results, events and state."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import components, fastpath
from ..plans import sinks as paid_into
from ..schemas import BATCH_LOG, COMMAND_LOG, Config
from ..sources.scratch import Scratch
from . import events as journal
from . import fold as folding
from . import prepass
from .state import State, allowances_at, balances_at

_STORED = ("command_id_hi", "command_id_lo", "status", "result_balance", "result_allowance", "result_reserved")


class Replay:
    """What a log did: one result per command and per leg, the event journal, and the state after it.

    Only the fold's output is stored at once. Results, legs and events are written when they are first asked
    for; a state is a plan over whichever of them are there.
    """

    def __init__(self, spark: SparkSession, marked: DataFrame, dealt: DataFrame, done: DataFrame, start: State, config: Config, scratch: Scratch):
        self._spark, self._marked, self._dealt, self._done = spark, marked, dealt, done
        self._start, self._config, self._scratch = start, config, scratch

    def _plan(self, name: str, build) -> DataFrame:
        return self.__dict__[name] if name in self.__dict__ else build()

    def _result_rows(self) -> DataFrame:
        return self._plan("results", lambda: _command_results(self._marked, self._done))

    def _leg_rows(self) -> DataFrame:
        return self._plan("batch_results", lambda: _batch_results(self._dealt, self._done, self._config))

    def _event_rows(self) -> DataFrame:
        return self._plan("events", lambda: journal.build(self._marked, self._dealt, self._result_rows(), self._leg_rows(), self._done))

    @cached_property
    def results(self) -> DataFrame:
        return self._scratch.keep(self._result_rows())

    @cached_property
    def batch_results(self) -> DataFrame:
        return self._scratch.keep(self._leg_rows())

    @cached_property
    def events(self) -> DataFrame:
        return self._scratch.keep(self._event_rows())

    @cached_property
    def state(self) -> State:
        events, config, start = self._event_rows(), self._config, self._start
        return State(
            balances_at(events, initial=start.balances), allowances_at(events, initial=start.allowances),
            _dedup_state(self._marked, self._result_rows(), config, start.command_dedup), _batch_dedup_state(self._dealt, self._leg_rows(), config, start.batch_dedup),
        )

    @cached_property
    def applied_position(self) -> DataFrame:
        return self._marked.select("log_position").union(self._dealt.select("log_position")).agg(F.max("log_position").alias("applied_position"))


def with_schema(log: DataFrame, schema) -> DataFrame:
    """Cast to a log schema; optional columns an older log lacks are null."""
    return log.select(*[(F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def replay(commands: DataFrame | None = None, batches: DataFrame | None = None, initial: State | None = None, config: Config | None = None) -> Replay:
    """Apply a totally ordered log of commands and batches to a state (default: empty)."""
    spark = SparkSession.getActiveSession() if commands is None and batches is None else (commands if commands is not None else batches).sparkSession
    config, scratch = config or Config(), Scratch(spark)
    commands = with_schema(commands, COMMAND_LOG) if commands is not None else spark.createDataFrame([], COMMAND_LOG)
    batches = with_schema(batches, BATCH_LOG) if batches is not None else spark.createDataFrame([], BATCH_LOG)
    start = initial or State.empty(spark)

    ring = start.command_dedup
    marked = prepass.mark_duplicates(prepass.validate(commands), config.dedup_window, ring, _STORED)
    marked = scratch.keep(marked)
    batch_ring = start.batch_dedup
    dealt = scratch.keep(prepass.mark_duplicates(batches, config.batch_dedup_window, batch_ring, ("legs",)).withColumn("fault", prepass.batch_fault(config.max_batch_size)))

    ops = _operations(marked, dealt, start)
    return Replay(spark, marked, dealt, _evaluate(ops, config, scratch), start, config, scratch)


def _operations(marked: DataFrame, dealt: DataFrame, start: State) -> DataFrame:
    """The rows the fold sees: loads of the initial state, valid fresh commands, legs of valid fresh batches."""
    null, n = F.lit(None).cast("bigint"), F.lit(0)
    one = lambda df, op, a, b, c, amount, position="log_position": df.select(
        F.col(position).alias("log_position") if isinstance(position, str) else position.alias("log_position"), n.alias("leg_idx"), n.alias("chain_id"), F.lit(True).alias("chain_last"),
        op.alias("op"), "asset_id", a.alias("a"), b.alias("b"), c.alias("c"), amount.alias("amount"))
    before, c = F.lit(-1).cast("bigint"), F.col
    loads = one(start.balances, F.lit(folding.LOAD_BALANCE), c("account_id"), c("reserved"), null, c("available"), before)
    loads = loads.unionByName(one(start.allowances, F.lit(folding.LOAD_ALLOWANCE), c("owner_id"), c("delegate_id"), null, c("allowance"), before))
    fresh = marked.filter("not duplicate and fault is null")
    own = one(fresh, c("command_type"), c("account_a"), c("account_b"), c("account_c"), c("amount"))
    legs = prepass.explode_legs(dealt.filter("not duplicate and fault is null"), "log_position")
    moved = legs.select("log_position", "leg_idx", "chain_id", "chain_last", F.lit(folding.LEG).alias("op"), "asset_id", c("from_id").alias("a"), c("to_id").alias("b"), null.alias("c"), "amount")
    return loads.unionByName(own).unionByName(moved)


def _evaluate(ops: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    if config.fast_path:
        return _evaluate_fast(ops, config, scratch)
    sinks = scratch.keep(paid_into.find(ops))
    any_sinks = sinks.limit(1).count() > 0
    ops = paid_into.mark(ops, sinks) if any_sinks else ops.withColumn("sink", F.lit(False))
    # credits of sinks touch nothing else, so they need no fold
    done = _fold(components.with_component(ops.filter("op != 'CREDIT' or not sink"), config.partition_by, scratch))
    if not any_sinks:
        return scratch.keep(done)
    received = F.struct(*[(F.lit("BALANCE_CHANGED") if n == "kind" else F.lit("CREDIT") if n == "cause" else F.col("asset_id") if n == "asset_id" else F.col("a") if n == "account_id" else F.col("amount") if n == "delta" else F.lit(None)).alias(n) for n in folding.EVENT_NAMES])
    null = F.lit(None).cast("bigint")
    credits = ops.filter("op = 'CREDIT' and sink").select(
        "log_position", "leg_idx", "op", F.lit("SUCCESS").alias("status"), null.alias("result_balance"), null.alias("result_allowance"), null.alias("result_reserved"),
        F.array(received.cast(folding.EVENT_STRUCT)).alias("events"),
    )
    return scratch.keep(paid_into.fill(scratch.keep(done.unionByName(credits)), sinks, scratch))


def _evaluate_fast(ops: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    ops = scratch.keep(components.with_component(ops.withColumn("sink", F.lit(False)), config.partition_by, scratch))
    quick, settled = fastpath.evaluate(ops)
    return scratch.keep(_fold(ops.join(settled, "component", "left_anti")).unionByName(quick))


def _fold(ops: DataFrame) -> DataFrame:
    parts = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ops.repartition(parts, "component").sortWithinPartitions("log_position", "leg_idx")
    return dealt.select("log_position", "leg_idx", "chain_id", "chain_last", "op", "asset_id", "a", "b", "c", "amount", "sink").mapInArrow(folding.fold, folding.RESULTS)


def _command_results(marked: DataFrame, done: DataFrame) -> DataFrame:
    """One row per command; a duplicate repeats the result of its origin."""
    own = done.filter(f"op != '{folding.LEG}'").select(F.col("log_position").alias("at"), "status", "result_balance", "result_allowance", "result_reserved")
    named = marked.withColumn("at", F.when(F.col("duplicate"), F.col("origin.log_position")).otherwise(F.col("log_position"))).join(own, "at", "left")
    faults = marked.filter("fault is not null").select(F.col("log_position").alias("at"), F.col("fault").alias("origin_fault"))
    named = named.join(faults, "at", "left")
    old = F.col("duplicate") & (F.col("at") == -1)
    pick = lambda name: F.when(old, F.col(f"origin.{name}")).otherwise(F.col(name)).alias(name)
    return named.select(
        "log_position", F.when(F.col("duplicate") & (F.col("at") == -1), F.col("origin.command_id_hi")).otherwise(F.col("command_id_hi")).alias("command_id_hi"),
        F.when(old, F.col("origin.command_id_lo")).otherwise(F.col("command_id_lo")).alias("command_id_lo"), "duplicate", "evicted",
        F.when(old, F.col("origin.status")).otherwise(F.coalesce("origin_fault", "status")).alias("status"), *[pick(c) for c in _STORED[3:]],
    )


def _batch_results(dealt: DataFrame, done: DataFrame, config: Config) -> DataFrame:
    """One row per leg in request order; a repeated batch repeats the legs of its origin under its own id."""
    legs = done.filter(f"op = '{folding.LEG}'").select(F.col("log_position").alias("at"), "leg_idx", "status", "result_balance")
    bad = dealt.filter("not duplicate and fault is not null").select(F.col("log_position").alias("at"), F.explode(F.sequence(F.lit(0), F.least(F.size("legs"), F.lit(config.max_batch_size)) - 1)).alias("leg_idx"), F.col("fault").alias("status"), F.lit(None).cast("bigint").alias("result_balance"))
    heads = dealt.select("log_position", "batch_id_hi", "batch_id_lo", "duplicate", F.when(F.col("duplicate"), F.col("origin.log_position")).otherwise(F.col("log_position")).alias("at"), "origin")
    found = heads.join(legs.unionByName(bad), "at").select("log_position", "leg_idx", "batch_id_hi", "batch_id_lo", "duplicate", "status", F.col("result_balance").isNotNull().alias("has_balance"), "result_balance")
    old = heads.filter("duplicate and at = -1").select("log_position", "batch_id_hi", "batch_id_lo", "duplicate", F.explode("origin.legs").alias("leg"))
    again = old.select("log_position", "leg.leg_idx", "batch_id_hi", "batch_id_lo", "duplicate", "leg.status", F.col("leg.result_balance").isNotNull().alias("has_balance"), "leg.result_balance")
    return found.unionByName(again)


def _dedup_state(marked: DataFrame, results: DataFrame, config: Config, ring: DataFrame | None) -> DataFrame:
    """The remembered commands: what each slot holds last, with the result it repeats."""
    own = marked.select("log_position", "client_id", "client_seq", "slot").join(results.select("log_position", *_STORED), "log_position")
    rows = own if ring is None else own.unionByName(ring.select("client_id", "client_seq", "slot", *_STORED, F.lit(-1).cast("bigint").alias("log_position")))
    last = rows.groupBy("client_id", "slot").agg(F.max_by(F.struct("client_seq", *_STORED), "log_position").alias("r"))
    return last.select("client_id", "r.*", "slot").filter("client_seq != -1").select("client_id", "client_seq", *_STORED, "slot")


def _batch_dedup_state(dealt: DataFrame, legs: DataFrame, config: Config, ring: DataFrame | None) -> DataFrame:
    listed = legs.groupBy("log_position").agg(F.sort_array(F.collect_list(F.struct("leg_idx", "status", "result_balance"))).alias("legs"))  # a batch is bounded
    empty = F.array().cast("array<struct<leg_idx:int,status:string,result_balance:bigint>>")
    own = dealt.select("log_position", "client_id", "client_seq", "slot", "batch_id_hi", "batch_id_lo").join(listed, "log_position", "left").withColumn("legs", F.coalesce("legs", empty))
    rows = own if ring is None else own.unionByName(ring.withColumn("log_position", F.lit(-1).cast("bigint")))
    last = rows.groupBy("client_id", "slot").agg(F.max_by(F.struct("client_seq", "batch_id_hi", "batch_id_lo", "legs"), "log_position").alias("r"))
    return last.select("client_id", "r.*", "slot").filter("client_seq != -1").select("client_id", "client_seq", "batch_id_hi", "batch_id_lo", "legs", "slot")
