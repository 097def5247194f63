"""The ledger as a stream: a follower that applies new log files, and journal consumption.

The follower hands each micro-batch to the batch engine, so stream and batch can't differ. Commands and
batches share one space of positions: with both logs, only what lies at or below the lower of
their newest positions is applied, until the logs are complete. Positions only advance: what was
applied is skipped when it arrives again, which makes a micro-batch that is run again harmless, and a
row at or below the applied position that never was applied raises :class:`LateEntry`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import event_key
from ..operators import metrics, snapshots
from ..operators.replay import replay, with_schema
from ..operators.state import State
from ..schemas import BATCH_LOG, COMMAND_LOG, EVENTS, Config
from ..sources import logs

POINTER = "position bigint, path string"


class LateEntry(Exception):
    """A log entry arrived below the applied position and can't be applied in order any more."""


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, empty where nothing was stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


@dataclass
class Follower:
    """Applies a growing log of commands and batches to a state kept under ``home``.

    Every apply stores its rows; every ``snapshot_every``-th also stores a snapshot, so what an apply writes follows
    its rows, not the state. The state is the newest sound snapshot with the stored rows behind it replayed; a damaged
    snapshot is passed over, back to an empty state at worst.
    """

    spark: SparkSession
    home: str
    config: Config = Config()
    snapshot_every: int = 1
    passed_over: list[str] = field(default_factory=list)

    def _stored(self, name: str, schema) -> DataFrame:
        return with_schema(_table(self.spark, f"{self.home}/log/{name}", schema), schema)

    def position(self) -> int:
        """The applied position, -1 before anything was applied."""
        found = _table(self.spark, f"{self.home}/applied", POINTER).agg(F.max("position")).first()[0]
        return -1 if found is None else found

    def current(self) -> tuple[State, int]:
        """The newest state and its position; empty at position -1 before anything was applied."""
        position = self.position()
        state, at = State.empty(self.spark), -1
        kept = _table(self.spark, f"{self.home}/applied", POINTER).filter("path is not null").orderBy(F.desc("position"))
        for row in kept.toLocalIterator():  # newest first; the first sound one ends it
            try:
                state, at = snapshots.load(self.spark, row["path"])
                break
            except snapshots.SnapshotError:
                if row["path"] not in self.passed_over:
                    self.passed_over.append(row["path"])
        if at < position:
            between = lambda df: df.filter(F.col("log_position").between(at + 1, position))
            state = replay(between(self._stored("commands", COMMAND_LOG)), between(self._stored("batches", BATCH_LOG)), state, self.config).state
        return state, position

    def _unseen(self, df: DataFrame, name: str, schema, applied: int) -> None:
        late = df.filter(F.col("log_position") <= applied).select("log_position")
        if not late.limit(1).count():
            return
        missing = late.join(self._stored(name, schema).select("log_position"), "log_position", "left_anti").agg(F.min("log_position")).first()[0]
        if missing is not None:
            raise LateEntry(f"{name}: position {missing} arrived after {applied} was applied")

    def apply(self, commands: DataFrame | None, batches: DataFrame | None = None) -> int:
        """Apply what lies beyond the applied position; returns the new one. Outputs carry the position they end at."""
        applied = self.position()
        rows = {"commands": (commands, COMMAND_LOG), "batches": (batches, BATCH_LOG)}
        fresh = {}
        for name, (df, schema) in rows.items():
            df = with_schema(df, schema) if df is not None else self.spark.createDataFrame([], schema)
            self._unseen(df, name, schema, applied)
            fresh[name] = df.filter(F.col("log_position") > applied).dropDuplicates(["log_position"])
        position = fresh["commands"].select("log_position").union(fresh["batches"].select("log_position")).agg(F.max("log_position")).first()[0]
        if position is None:
            return applied
        state, _ = self.current()
        out = replay(fresh["commands"], fresh["batches"], state, self.config)
        for name, df in (("results", out.results), ("batch_results", out.batch_results), ("events", out.events), ("log/commands", fresh["commands"]), ("log/batches", fresh["batches"])):
            df.write.mode("overwrite").parquet(f"{self.home}/{name}/upto={position}")
        path, done = None, _table(self.spark, f"{self.home}/applied", POINTER).count() + 1
        if done % self.snapshot_every == 0:
            path = f"{self.home}/snapshots/{position:020d}"
            snapshots.write(out.state, path, position)
        self.spark.createDataFrame([(position, path)], POINTER).write.mode("append").parquet(f"{self.home}/applied")
        return position

    def catch_up(self, log_path: str | None, batch_path: str | None = None, complete: bool = False) -> int:
        """Apply what the logs hold beyond the applied position; with both, up to the lower of their newest positions unless ``complete``."""
        paths = {"commands": (log_path, COMMAND_LOG), "batches": (batch_path, BATCH_LOG)}
        given = {name: logs.read(self.spark, path, schema) for name, (path, schema) in paths.items() if path}
        tops = [df.agg(F.max("log_position")).first()[0] for df in given.values()]
        tops = [-1 if t is None else t for t in tops]
        upto = max(tops) if complete or len(tops) == 1 else min(tops)
        rows = {name: df.filter(F.col("log_position") <= upto) for name, df in given.items()}
        return self.apply(rows.get("commands"), rows.get("batches"))

    def start(self, log_path: str | None, checkpoint: str, batch_path: str | None = None, available_now: bool = True):
        """Follow a folder of command files, of batch files, or of both, in order of position."""
        if log_path and batch_path:
            one, two = (logs.stream(self.spark, p, s).select("log_position") for p, s in ((log_path, COMMAND_LOG), (batch_path, BATCH_LOG)))
            source, step = one.union(two), lambda df, _: self.catch_up(log_path, batch_path)
        else:
            source = logs.stream(self.spark, batch_path or log_path, BATCH_LOG if batch_path else COMMAND_LOG)
            step = (lambda df, _: self.apply(None, df)) if batch_path else (lambda df, _: self.apply(df))
        writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/events").drop("upto")

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/results").drop("upto")


@dataclass
class Replica:
    """A follower that moves through its endpoints: CONNECTING, FOLLOWING, or DEGRADED after a failure or silence.

    An endpoint is a pair of log paths (commands, batches), either may be missing. After an error, or when nothing
    new came for ``liveness`` seconds, the next endpoint is tried ``backoff`` seconds later; position and state carry over.
    """

    follower: Follower
    endpoints: list[tuple[str | None, str | None]]
    liveness: float = 10.0
    backoff: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    state: str = "CONNECTING"
    at: int = 0
    failovers: int = 0
    heard: float | None = None

    def _next(self) -> None:
        self.state, self.at, self.failovers, self.heard = "DEGRADED", (self.at + 1) % len(self.endpoints), self.failovers + 1, None
        self.sleep(self.backoff)

    def step(self, complete: bool = False) -> int:
        """Poll the endpoint once; returns the applied position."""
        before, now = self.follower.position(), self.clock()
        if self.heard is None:
            self.state, self.heard = "CONNECTING", now
        try:
            position = self.follower.catch_up(*self.endpoints[self.at], complete=complete)
        except LateEntry:
            raise
        except Exception:  # noqa: BLE001 - any unreadable source means the next one
            self._next()
            return before
        if position > before:
            self.state, self.heard = "FOLLOWING", self.clock()
        elif self.clock() - self.heard > self.liveness:
            self._next()
        else:
            self.state = "FOLLOWING"
        return position

    def health(self) -> DataFrame:
        row = metrics.health(self.follower.spark, None, self.follower.position(), str(self.endpoints[self.at]), self.failovers, len(self.follower.passed_over))
        return row.withColumns({"state": F.lit(self.state), "healthy": F.lit(self.state == "FOLLOWING")})


@dataclass
class JournalFollower:
    """Consumes journals of events into one table under ``home``; the highest (position, index) is kept with it.

    The mark belongs to the consumer, not to a source, so another copy of the journal, or the same one from its
    beginning, adds only what lies beyond it.
    """

    spark: SparkSession
    home: str

    def mark(self) -> tuple[int, int]:
        found = _table(self.spark, f"{self.home}/mark", "position bigint, index int").orderBy(F.desc("position"), F.desc("index")).first()
        return (found["position"], found["index"]) if found else (-(1 << 63), -1)

    def consume(self, journal: DataFrame) -> tuple[int, int]:
        """Take the events beyond the mark, each once; returns the new mark."""
        position, index = self.mark()
        fresh = journal.filter((F.col("log_position") > position) | ((F.col("log_position") == position) & (F.col("event_index") > index))).dropDuplicates(["log_position", "event_index"])
        top = fresh.agg(F.max(event_key())).first()[0]
        if top is None:
            return position, index
        fresh.write.mode("overwrite").parquet(f"{self.home}/events/after={position}.{index}")
        self.spark.createDataFrame([(top[0], top[1])], "position bigint, index int").write.mode("append").parquet(f"{self.home}/mark")
        return top[0], top[1]

    def start(self, path: str, checkpoint: str, available_now: bool = True):
        writer = logs.stream(self.spark, path, EVENTS).writeStream.foreachBatch(lambda df, _: self.consume(df)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/events").drop("after")


def drop_stale_stream(journal: DataFrame, stream: str = "stream_id"):
    """High-water-mark de-duplication of a streamed journal: state is the highest (position, index) of each stream.

    Rows of one micro-batch are taken in order of ``arrival``; what is at or below the mark is dropped.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = journal.columns

    def step(key, frames, state: GroupState):
        import pandas as pd

        frame = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        mark, keep = (state.get if state.exists else (-(1 << 63), -1)), []
        for at in zip(frame["log_position"], frame["event_index"]):
            keep.append(at > tuple(mark))
            mark = max(at, tuple(mark))
        state.update((int(mark[0]), int(mark[1])))
        yield frame[keep][names]

    return journal.groupBy(stream).applyInPandasWithState(step, journal.schema, "position bigint, index int", "append", GroupStateTimeout.NoTimeout)


def windowed_velocity(transfers: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Transfers and volume per account and time window; works on streams (late rows are dropped after ``late``) and tables."""
    own = transfers.withWatermark(time, late) if transfers.isStreaming else transfers
    return own.groupBy(F.window(time, width), "asset_id", "from_account").agg(F.count("*").alias("transfers"), F.sum("amount").alias("volume"))
