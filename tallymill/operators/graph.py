"""Pattern queries and risk views over the delegation graph (specified in a design, not shipped, by the reference behaviour).

Accounts and assets are nodes; an allowance is an edge from owner to delegate within an
asset. Edges mean authority, not spendable funds: what a delegate may spend is not passed
on, so distance says how near an account is to that authority and nothing more.
A pattern is a chain of equi-joins on (asset, node); the optimizer orders and pushes down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hop_risk
from ..sources.scratch import Scratch
from .state import State

MAX_HOPS, MAX_ROWS = 8, 10_000
OPERATORS = {"EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b, "LT": lambda a, b: a < b, "LTE": lambda a, b: a <= b, "GT": lambda a, b: a > b, "GTE": lambda a, b: a >= b}


def accounts(state: State, asset_id: int | None = None) -> DataFrame:
    """Account nodes: asset_id, id, balance, reserved; all assets unless one is given."""
    own = state.balances if asset_id is None or asset_id < 0 else state.balances.filter(F.col("asset_id") == asset_id)
    return own.select("asset_id", F.col("account_id").alias("id"), F.col("available").alias("balance"), "reserved")


def assets(state: State) -> DataFrame:
    return state.supply.select(F.col("asset_id").alias("id"), "total_supply")


def edges(allowances: DataFrame, direction: str = "OUT", asset_id: int | None = None) -> DataFrame:
    """Edges as (asset_id, src, dst, amount) seen from ``src``: OUT as granted, IN reversed, ANY both."""
    own = allowances if asset_id is None or asset_id < 0 else allowances.filter(F.col("asset_id") == asset_id)
    out = own.select("asset_id", F.col("owner_id").alias("src"), F.col("delegate_id").alias("dst"), F.col("allowance").alias("amount"))
    back = own.select("asset_id", F.col("delegate_id").alias("src"), F.col("owner_id").alias("dst"), F.col("allowance").alias("amount"))
    return {"OUT": out, "IN": back, "ANY": out.unionByName(back)}[direction]


class GraphResult:
    """Rows and what the caller must know about them.

    ``status`` is SUCCESS, UNSUPPORTED, TRUNCATED (there are more than ``ceiling`` rows; asked only when it is read)
    or, after :meth:`fetch`, TIMEOUT.
    """

    def __init__(self, rows: DataFrame, status: str | None = "SUCCESS", warning: str | None = None, applied_position: int | None = None, ceiling: int | None = None):
        self.warning, self.applied_position = warning, applied_position
        self._all, self._status, self._ceiling = rows, status if ceiling is None else None, ceiling
        self.rows = rows if ceiling is None else rows.limit(ceiling)

    @property
    def status(self) -> str:
        if self._status is None:
            self._status = "TRUNCATED" if self._all.limit(self._ceiling + 1).count() > self._ceiling else "SUCCESS"
        return self._status

    @property
    def truncated(self) -> bool:
        return self.status == "TRUNCATED"

    @property
    def columns(self) -> list[tuple[str, str]]:
        """Names and types of the result's columns."""
        return self.rows.dtypes

    def fetch(self, seconds: float) -> list | None:
        """The rows (at most the ceiling), or null and status TIMEOUT if they take longer than that."""
        from threading import Timer

        spark = self.rows.sparkSession
        group, fired = f"graph-{id(self)}", []
        spark.sparkContext.setJobGroup(group, "graph query", interruptOnCancel=True)
        timer = Timer(seconds, lambda: (fired.append(True), spark.sparkContext.cancelJobGroup(group)))
        timer.start()
        try:
            return self.rows.limit(self._ceiling or MAX_ROWS).collect()
        except Exception:
            if not fired:
                raise
            self._status = "TIMEOUT"
            return None
        finally:
            timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def leaf(variable: str, prop: str, operator: str, value: int, negated: bool = False) -> Column:
    """A comparison of ``variable.prop`` (id, asset, balance, reserved, amount, total_supply) with a number; combine with &, | and ~."""
    if operator not in OPERATORS:
        raise ValueError(f"UNSUPPORTED operator {operator}")
    name = "asset_id" if prop == "asset" else variable if prop == "id" else f"{variable}_{prop}"
    test = OPERATORS[operator](F.col(name), F.lit(value))
    return ~test if negated else test


@dataclass
class GraphQuery:
    """A pattern over one state, built step by step: ``GraphQuery(state).node("a").hop("a", "b").where(...)``."""

    state: State
    asset_id: int | None = None
    bound: DataFrame | None = None
    warning: str | None = None
    steps: int = 0
    applied_position: int | None = None

    def _with(self, bound: DataFrame, warning: str | None = None) -> GraphQuery:
        return GraphQuery(self.state, self.asset_id, bound, warning or self.warning, self.steps + 1, self.applied_position)

    def _result(self, rows: DataFrame, status: str = "SUCCESS", warning: str | None = None, ceiling: int | None = None) -> GraphResult:
        return GraphResult(rows, status, warning or self.warning, self.applied_position, ceiling)

    def node(self, variable: str) -> GraphQuery:
        """Bind a variable to all accounts (a bound one is only filtered to accounts); its properties become columns."""
        own = accounts(self.state, self.asset_id).select("asset_id", F.col("id").alias(variable), F.col("balance").alias(f"{variable}_balance"), F.col("reserved").alias(f"{variable}_reserved"))
        if self.bound is None:
            return self._with(own)
        keys = ["asset_id", variable] if variable in self.bound.columns else ["asset_id"]
        if len(keys) == 1:
            raise ValueError("UNSUPPORTED: a second pattern must share a variable")
        return self._with(self.bound.join(own, keys))

    def hop(self, source: str, target: str, direction: str = "OUT", edge: str | None = None, optional: bool = False) -> GraphQuery:
        """One edge from a bound variable; a bound target filters instead of being bound again."""
        name = edge or f"e{self.steps}"
        own = edges(self.state.allowances, direction, self.asset_id).select("asset_id", F.col("src").alias(source), F.col("dst").alias(target), F.col("amount").alias(f"{name}_amount"))
        if self.bound is None:
            return self._with(own)
        keys = ["asset_id"] + [v for v in dict.fromkeys((source, target)) if v in self.bound.columns]
        if len(keys) == 1:
            raise ValueError("UNSUPPORTED: a pattern must share a variable with those before it")
        return self._with(self.bound.join(own, keys, "left" if optional else "inner"))

    def path(self, source: str, target: str, low: int = 1, high: int = 0, direction: str = "OUT") -> GraphQuery:
        """Accounts between ``low`` and ``high`` hops away (0: unbounded, clamped to the depth cap with a warning), each at its least distance."""
        warning = None
        if high == 0 or high > MAX_HOPS:
            high, warning = MAX_HOPS, f"depth clamped to {MAX_HOPS}"
        if self.bound is None or source not in self.bound.columns:
            raise ValueError("UNSUPPORTED: a path starts at a bound variable")
        seeds = self.bound.select("asset_id", F.col(source).alias("seed")).distinct()
        found = reach(edges(self.state.allowances, direction, self.asset_id), seeds, high).filter(F.col("hop") >= low)
        return self._with(self.bound.join(found.select("asset_id", F.col("seed").alias(source), F.col("node").alias(target), F.col("hop").alias(f"{target}_hop")), ["asset_id", source]), warning)

    def where(self, condition: Column) -> GraphQuery:
        return self._with(self.bound.filter(condition))

    def exists(self, variable: str, direction: str = "OUT", negated: bool = False) -> GraphQuery:
        own = edges(self.state.allowances, direction, self.asset_id).select("asset_id", F.col("src").alias(variable))
        return self._with(self.bound.join(own, ["asset_id", variable], "left_anti" if negated else "left_semi"))

    def returns(self, *columns: Column | str, distinct: bool = False, group_by: list[str] | None = None, order_by: list[Column] | None = None, skip: int = 0, limit: int | None = None, ceiling: int | None = MAX_ROWS) -> GraphResult:
        """Project or aggregate (grouped by ``group_by``), order by at most eight keys, and page.

        More than ``ceiling`` rows are cut and flagged (without an order, which rows stay is undefined); null returns all rows,
        without any limit in the plan.
        """
        if order_by and len(order_by) > 8:
            return self._result(self.bound.limit(0), "UNSUPPORTED", "at most 8 order keys")
        rows = self.bound.groupBy(*group_by).agg(*columns) if group_by is not None else self.bound.select(*columns)
        rows = rows.dropDuplicates() if distinct else rows
        rows = rows.orderBy(*order_by) if order_by else rows
        rows = rows.offset(skip) if skip else rows
        if limit is not None and (ceiling is None or limit <= ceiling):
            return self._result(rows.limit(limit))
        return self._result(rows, ceiling=ceiling)


def reach(graph: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(asset_id, seed, node, hop): all nodes within ``hops`` of each seed, at their least distance.

    Each step joins the frontier with the edges and drops what was seen; steps are
    written out, so plans stay small and a lost executor repeats one step at most. A
    seed counts as reached only by a cycle.
    """
    scratch = Scratch(graph.sparkSession)
    graph = scratch.keep(graph.select("asset_id", "src", "dst").distinct())
    found, frontier = None, seeds.select("asset_id", "seed", F.col("seed").alias("node"))
    for hop in range(1, min(hops, MAX_HOPS) + 1):
        step = frontier.join(graph.withColumnRenamed("src", "node"), ["asset_id", "node"]).select("asset_id", "seed", F.col("dst").alias("node")).distinct()
        if found is not None:
            step = step.join(found, ["asset_id", "seed", "node"], "left_anti")
        frontier = scratch.keep(step.withColumn("hop", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        found = frontier if found is None else found.unionByName(frontier)
        frontier = frontier.drop("hop")
    return found if found is not None else seeds.select("asset_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).limit(0)


def trace_allowance(allowances: DataFrame, seeds: DataFrame, direction: str = "OUT", hops: int = MAX_HOPS) -> DataFrame:
    """Accounts within reach of each seed (asset_id, seed), with distance and risk label."""
    found = reach(edges(allowances, direction), seeds, hops).filter("node != seed")
    return found.withColumn("risk", hop_risk())


def reachable(allowances: DataFrame, pairs: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """``pairs`` (asset_id, from_id, to_id) with whether a directed path of at most ``hops`` leads there.

    Walks half the way from each start and half from each end, and joins where they meet, so no start is
    expanded to everything within ``hops``.
    """
    hops, own = min(hops, MAX_HOPS), pairs.select("asset_id", "from_id", "to_id").distinct()
    ahead = _around(edges(allowances), own.select("asset_id", F.col("from_id").alias("seed")).distinct(), hops - hops // 2)
    back = _around(edges(allowances, "IN"), own.select("asset_id", F.col("to_id").alias("seed")).distinct(), hops // 2)
    meet = own.join(ahead.select("asset_id", F.col("seed").alias("from_id"), "node", F.col("hop").alias("out")), ["asset_id", "from_id"]).join(back.select("asset_id", F.col("seed").alias("to_id"), "node", F.col("hop").alias("in")), ["asset_id", "to_id", "node"])
    found = meet.filter("out + in > 0").select("asset_id", "from_id", "to_id", F.lit(True).alias("_met")).distinct()
    return pairs.join(found, ["asset_id", "from_id", "to_id"], "left").withColumn("reachable", F.coalesce("_met", F.lit(False))).drop("_met")


def _around(graph: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """:func:`reach` with each seed itself at distance 0; returns to it keep theirs."""
    self_ = seeds.select("asset_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    return self_.unionByName(reach(graph, seeds, hops).select("asset_id", "seed", "node", "hop")) if hops else self_


def _on_no_dead_end(graph: DataFrame, scratch: Scratch, rounds: int = 3) -> DataFrame:
    """Edges whose ends can both lie on a cycle: nodes without edges in or out are trimmed, ``rounds`` times at most."""
    graph, size = scratch.keep(graph.select("asset_id", "src", "dst").distinct()), None
    for _ in range(rounds):
        size = graph.count() if size is None else size
        into, outof = graph.select("asset_id", F.col("dst").alias("src")).distinct(), graph.select("asset_id", F.col("src").alias("dst")).distinct()
        graph = scratch.keep(graph.join(into, ["asset_id", "src"], "left_semi").join(outof, ["asset_id", "dst"], "left_semi"))
        left = graph.count()
        if left == size:
            break
        size = left
    return graph


def delegation_cycles(allowances: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """Accounts on a cycle of at most ``hops`` edges, with its least length.

    Nodes that can't lie on a cycle are trimmed first; a cycle is half a walk out and half a walk back that meet.
    """
    hops = min(hops, MAX_HOPS)
    graph = _on_no_dead_end(edges(allowances), Scratch(allowances.sparkSession))
    seeds = graph.select("asset_id", F.col("src").alias("seed")).distinct()
    ahead = reach(graph, seeds, hops - hops // 2)
    cycles = ahead.filter("node = seed").select("asset_id", "seed", "hop")
    if hops > 1:
        back = reach(graph.select("asset_id", F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, hops // 2).filter("node != seed")
        halves = ahead.filter("node != seed").join(back.select("asset_id", "seed", "node", F.col("hop").alias("rest")), ["asset_id", "seed", "node"])
        cycles = cycles.unionByName(halves.select("asset_id", "seed", (F.col("hop") + F.col("rest")).alias("hop")))
    return cycles.groupBy("asset_id", F.col("seed").alias("account_id")).agg(F.min("hop").alias("length"))


def hotspots(allowances: DataFrame, limit: int = 10) -> DataFrame:
    """The delegates with most distinct owners in each asset's graph, ties by id."""
    return allowances.groupBy("asset_id", "delegate_id").agg(F.countDistinct("owner_id").alias("fan_in")).orderBy(F.desc("fan_in"), "asset_id", "delegate_id").limit(limit)


def dormant_allowances(state: State) -> DataFrame:
    """Allowances whose owner has nothing available."""
    own = state.balances.select("asset_id", F.col("account_id").alias("owner_id"), "available")
    return state.allowances.join(own, ["asset_id", "owner_id"], "left").filter(F.coalesce("available", F.lit(0)) == 0).select("asset_id", "owner_id", "delegate_id", "allowance")


def concentration(state: State, percent: int) -> DataFrame:
    """Accounts that hold at least ``percent`` of their asset's supply."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    return state.balances.join(state.supply, "asset_id").filter((big("total_supply") > 0) & (big("available") * 100 >= big("total_supply") * percent)).select("asset_id", "account_id", "available", "total_supply")


def transfer_edges(events: DataFrame, last: int | None = None) -> DataFrame:
    """All transfers of the journal, in no order; or the last ``last``, newest first.

    Few are a top-k. For many, counts of position ranges find the position from which on there are so many, and a filter
    takes them; they are sorted by ranges, never in one task.
    """
    own = events.filter("kind = 'TRANSFER'").select("log_position", "event_index", "timestamp", "asset_id", "from_account", "to_account", "amount")
    newest = F.desc("log_position"), F.desc("event_index")
    if last is None:
        return own
    if last <= MAX_ROWS:
        return own.orderBy(*newest).limit(last)
    low, high = own.agg(F.min("log_position"), F.max("log_position")).first()
    wanted = last
    while low is not None and low < high:
        width = (high - low) // 1024 + 1
        counts = {r["k"]: r["n"] for r in own.filter(F.col("log_position").between(low, high)).groupBy(F.expr(f"(log_position - {low}) div {width}").alias("k")).agg(F.count("*").alias("n")).collect()}  # 1,024 rows at most
        for k in sorted(counts, reverse=True):
            if counts[k] >= wanted:
                break
            wanted -= counts[k]
        else:
            low = None  # fewer than `last` in all
            break
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
    if low is None:
        return own.orderBy(*newest)
    edge = own.filter(F.col("log_position") == low).orderBy(*newest).limit(wanted)  # of one log entry
    return own.filter(F.col("log_position") > low).unionByName(edge).orderBy(*newest)


def velocity(transfers: DataFrame, width: int) -> DataFrame:
    """Number and volume of each account's outgoing transfers in windows of ``width`` positions."""
    slot = F.expr(f"log_position div {width}")
    return transfers.groupBy("asset_id", "from_account", slot.alias("slot")).agg(F.count("*").alias("transfers"), F.sum("amount").cast("bigint").alias("volume"))


def fan_out(transfers: DataFrame) -> DataFrame:
    """Distinct recipients of each account."""
    return transfers.groupBy("asset_id", "from_account").agg(F.countDistinct("to_account").alias("recipients"), F.max("log_position").alias("last_position"))
