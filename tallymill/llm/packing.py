"""Mixture-controlled packing of token sequences.

Every source is a queue of documents. Deficit round-robin serves the queues in
rounds of one window each: in a round, queue ``s`` earns ``share(s) * window`` tokens
of credit, is served whole quanta from its credit, and carries the rest (its deficit)
into the next round. The rounds' pieces, concatenated, are cut every ``window`` tokens,
so each window holds the sources in the target proportions up to the carried deficits.

The shares are target proportions given by the caller, or the sources' own shares of the corpus,
the only ones that last until every token is packed. With other targets some queues run out before
others. In the round in which a queue's credit covers its rest it is served that rest; from the next
round on, the queues that are left share the window in proportion to their targets. So
the rounds fall into phases, at most as many as there are queues, and inside a phase the schedule has
a closed form: after ``t`` rounds of the phase, queue ``s`` with weight ``w(s)``, ``W`` the weights of all
queues left and ``d(s)`` its deficit from before has earned ``E = d(s) + floor(t * w(s) * window / W)``
tokens and been served ``quantum * floor(E / quantum)`` of them, or all it has once ``E`` reaches that.
A token's round, and its place in the whole stream, follow from its index in its
queue alone. Each document is placed on its own from the per-queue totals, so deficits
carry over partitions without any shuffle of tokens, and no task ever holds a queue.

The driver and every task hold one number for each source (and phase); group sources beforehand if there
are more than some thousands. What each partition of documents adds to the indexes is one row with an
entry for each of its sources; up to ``FEW`` entries in all are broadcast, after counting them,
and more are joined, which then shuffles the tokens once.

The last, partial window is split into sequences whose lengths are powers of two,
which need no padding. Quanta of 64 tokens cut a document into about one piece for each
quantum or window end, some 14 on the data at hand.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .subwords import BatchEncoder

WINDOW, QUANTUM, END, FEW = 2048, 64, 1, 4_000_000

TOKENS = "doc_id long, queue string, tokens binary, doc_tokens long, part int, before long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, queue string"


def tokenise(docs: DataFrame, json_name: str = "byte_bpe_50k.json", rank_name: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Ids of every document, its queue, and the tokens that precede it in (queue, partition)."""
    small_batches(docs.sparkSession)
    queue = F.coalesce(F.col("source").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), queue.alias("queue"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = BatchEncoder(json_name, rank_name), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, sizes = encoder.encode(batch["text"])
            ends = np.cumsum(sizes + 1)
            closed = np.full(len(ids) + len(sizes), END, dtype="<u2" if ids.max(initial=END) < 65536 else "<u4")
            kept = np.ones(len(closed), dtype=bool)
            kept[ends - 1] = False
            closed[kept] = ids
            raw, before = closed.tobytes(), []
            for count, q in zip((sizes + 1).tolist(), batch["queue"].to_pylist()):
                before.append(seen.get(q, 0))
                seen[q] = before[-1] + count
            bounds = (np.append(0, ends) * closed.itemsize).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["queue"], pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.array(sizes + 1), pa.array([part] * len(sizes), pa.int32()), pa.array(before, pa.int64())],
                names=["doc_id", "queue", "tokens", "doc_tokens", "part", "before"],
            )

    return base.mapInArrow(run, TOKENS)


class Schedule:
    """The closed form of the rounds, from the queues' token totals and target weights (default: the totals)."""

    def __init__(self, totals: dict[str, int], window: int = WINDOW, quantum: int = QUANTUM, targets: dict[str, int] | None = None):
        self.queues = sorted(q for q, n in totals.items() if n)
        self.slot = {q: i for i, q in enumerate(self.queues)}
        self.totals = [totals[q] for q in self.queues]
        self.sum, self.window, self.quantum = sum(self.totals), window, quantum
        self.weights = self.totals if targets is None else [targets[q] for q in self.queues]
        self.memo: dict[int, list[int]] = {}
        self.most = max(64, 500_000 // max(1, len(self.totals)))  # rounds remembered
        self._phases()

    def _phases(self) -> None:
        """First round, served tokens and deficits at the start of each phase, the weights left in it, and the rounds in all."""
        n = len(self.totals)
        served, owed, left, at = [0] * n, [0] * n, list(range(n)), 0
        self.first, self.served_at, self.owed_at, self.weight_at = [], [], [], []
        while left:
            whole = sum(self.weights[i] for i in left)
            self.first.append(at)
            self.served_at.append(served)
            self.owed_at.append(owed)
            self.weight_at.append(whole)
            # the phase ends with the first round in which some queue's credit covers its rest
            last = min(self._rounds_to(len(self.first) - 1, i, self.totals[i] - served[i]) for i in left)
            after, owing = list(served), list(owed)
            for i in left:
                earned = owed[i] + last * self.weights[i] * self.window // whole
                given = self.totals[i] - served[i] if earned >= self.totals[i] - served[i] else earned // self.quantum * self.quantum
                after[i], owing[i] = served[i] + given, earned - given
            served, owed, at = after, owing, at + last
            left = [i for i in left if served[i] < self.totals[i]]
        self.rounds = max(1, at)

    def _rounds_to(self, phase: int, slot: int, tokens: int) -> int:
        """Rounds of a phase until a queue has earned that many tokens, one at least."""
        owed = tokens - self.owed_at[phase][slot]
        return max(1, -(-owed * self.weight_at[phase] // (self.weights[slot] * self.window)))

    def served(self, slot: int, r: int) -> int:
        """Tokens of a queue served after round ``r``; exact integers."""
        if r < 0:
            return 0
        phase = bisect_right(self.first, r) - 1
        before = self.served_at[phase][slot]
        rest = self.totals[slot] - before
        if r >= self.rounds - 1 or not rest:
            return self.totals[slot]
        earned = self.owed_at[phase][slot] + (r - self.first[phase] + 1) * self.weights[slot] * self.window // self.weight_at[phase]
        return before + (rest if earned >= rest else earned // self.quantum * self.quantum)

    def round_of(self, slot: int, u: int) -> int:
        """The first round after which more than ``u`` tokens of the queue are served."""
        phase = bisect_right(self.served_at, u, key=lambda at: at[slot]) - 1
        before = self.served_at[phase][slot]
        rest = self.totals[slot] - before
        needed = min(rest, ((u - before) // self.quantum + 1) * self.quantum)
        return self.first[phase] + self._rounds_to(phase, slot, needed) - 1

    def starts(self, r: int) -> list[int]:
        """Where each queue's part of round ``r`` starts in the whole stream."""
        if r not in self.memo:
            at = [self.served(i, r - 1) for i in range(len(self.totals))]
            place, out = sum(at), []
            for i, before in enumerate(at):
                out.append(place - before)  # plus a token's index in its queue
                place += self.served(i, r) - before
            if len(self.memo) >= self.most:
                self.memo.clear()
            self.memo[r] = out
        return self.memo[r]

    def place(self, queue: str, first: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(offset in the document, length, position in the stream) of runs that cover a document."""
        slot, u, end = self.slot[queue], first, first + count
        while u < end:
            r = self.round_of(slot, u)
            stop = min(end, self.served(slot, r))
            yield u - first, stop - u, self.starts(r)[slot] + u
            u = stop

    def sequences(self) -> tuple[int, list[tuple[int, int]]]:
        """Full windows, and (start, length) of the tail's power-of-two sequences."""
        full, tail = divmod(self.sum, self.window)
        at, out = full * self.window, []
        for bit in range(self.window.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                out.append((at, 1 << bit))
                at += 1 << bit
        return full, out


def cut(position: int, length: int, window: int, full: int, tail: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Split a run of the stream at sequence ends: (length, sequence, offset, padded length)."""
    end = position + length
    while position < end:
        if position < full * window:
            sequence, offset = divmod(position, window)
            room, size = window - offset, window
        else:
            i = next(i for i, (at, n) in enumerate(tail) if position < at + n)
            sequence, offset = full + i, position - tail[i][0]
            room, size = tail[i][1] - offset, tail[i][1]
        take = min(room, end - position)
        yield take, sequence, offset, size
        position += take


def weights_of(targets: Mapping[str, float], totals: Mapping[str, int]) -> dict[str, int]:
    """Targets as whole numbers in their exact proportions; every source with tokens needs one above 0."""
    parts = {q: Fraction(targets.get(q, 0)).limit_denominator(1_000_000) for q, n in totals.items() if n}
    if any(p <= 0 for p in parts.values()):
        raise ValueError(f"no target share for {sorted(q for q, p in parts.items() if p <= 0)[:5]}")
    whole = math.lcm(*(p.denominator for p in parts.values())) if parts else 1
    return {q: int(p * whole) for q, p in parts.items()}


def pack(docs: DataFrame, window: int = WINDOW, quantum: int = QUANTUM, targets: Mapping[str, float] | None = None, vocabulary: tuple[str, str | None] = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    A document is its ids and the end id 1; a null or empty text is that id alone, a
    null source counts as the empty one. ``targets`` are the sources' proportions in every window as long
    as they last (default: their shares of the corpus). Returns one row per piece (see
    ``PIECES``); repeated rows are packed as often as they occur, and an empty table gives no
    rows. Other columns are ignored.
    """
    if window & (window - 1) or window % quantum:
        raise ValueError("window must be a power of two and a multiple of quantum")
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.keep(tokenise(docs, *vocabulary), "tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    from pyspark.sql import Window

    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(parts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "offsets")
    totals = {r["queue"]: r["n"] for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one row for each source
    weights = weights_of(targets, totals) if targets is not None else None
    bases = offsets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("queue", "base"))).alias("bases"))
    if offsets.count() <= FEW:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").select("doc_id", "queue", "tokens", "doc_tokens", (F.col("bases")[F.col("queue")] + F.col("before")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(totals, window, quantum, weights)
        full, tail = schedule.sequences()
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            put = [column.append for column in rows]
            for doc, queue, raw, count, first in zip(*(batch[c].to_pylist() for c in ("doc_id", "queue", "tokens", "doc_tokens", "first"))):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * count else "<u4").astype("<u4")
                for offset, length, position in schedule.place(queue, first, count):
                    for take, sequence, at, size in cut(position, length, window, full, tail):
                        piece = ids[offset : offset + take]
                        for add, value in zip(put, (doc, offset, take, zlib.crc32(piece.tobytes()), count, sequence, at, size, queue)):
                            add(value)
                        offset += take
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, [pa.int64()] * 8 + [pa.string()])], names=[c.split()[0] for c in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)
