"""Language-model scores of texts.

The model reads the subword ids of each word (A-Z lower-cased, a space before it) and one
end token. The causal self-attention model (:mod:`.attention`) embeds the ids and gives the probability of
the next id in steps: whether a word starts, the class of the id (ids that start a word have classes of
their own), and which id of the class it is. Counts given the previous token's class are
added to the logits of each step, so that attention learns what they don't say. A word of class ``c`` is
then either one that training texts hold, or spelled by its subwords, by absolute discounting

    P(word) = P(c | a word starts) * ((n - D) / N(c) + D * V(c) / N(c) * P(spelling and its end | c))

with ``n`` its count, ``N`` and ``V`` the counts of words and of different words of the class, and
``D = n1 / (n1 + 2 n2)`` from how many words occur once and twice. That is a distribution
over all words, seen or not; nothing is fitted for it but the counts of all training texts.

The attention weights are trained data-parallel: in each of ``ROUNDS`` rounds every task
trains on all windows of its share of the training texts (one in ``ROUNDS``, another one each
round, so that the rounds see every text once), and Spark averages the tasks' weights by the tokens they
saw, those of an id by how often they saw it. What is shuffled grows with the corpus, and the driver holds one set of weights. The weights
depend on how rows are dealt over tasks, as any such average does; equal files give equal scores.

The base score is a word unigram model. Counts of all words come from a pre-aggregated
shuffle; at most ``HEAVY`` frequent words of at most ``LONG`` bytes are looked up in a broadcast
table, which changes no result, and the other words of each document are joined with the counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from copy import copy
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from .common import Scratch, small_batches
from .subwords import UNSAFE, Encoder, ranks

IDS, END = 50_257, 50_256
HEAVY, LONG, FLUSH = 400_000, 64, 300_000
ROUNDS, GROUP, ROWS, BYTES = 2, 150_000, 20_000, 2 << 20
OWN_STARTS, OWN_INNER = 12, 8
BLOCKS = 8  # of the model's rows of weights, averaged one by one
TOGETHER = 8  # batches whose words are looked up at once
SLICES, HELD = 32, 4_000_000  # of a table of counts, summed one by one; codes counted at once

ENCODED = "doc_id long, held_out boolean, n_tokens long, sum double, known long, tail array<binary>, slots binary, counts binary, ids binary"
SPOKEN = "row long, doc_id long, held_out boolean, n_tokens long, sum double, known long, score double, tail array<binary>, said array<binary>"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, which of them each word is, how many words each text has) of a column of texts.

    A-Z are lower-cased; words are separated by ASCII white space.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))  # before a leading space
    sizes = np.diff(offsets)
    if len(empty):
        sizes = sizes - np.bincount(np.searchsorted(offsets - offsets[0], empty, side="right") - 1, minlength=len(sizes))
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), sizes


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the training texts, counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table([sums["word"], sums["n_sum"]], names=["word", "n"])

        for batch in batches:
            kept = pa.array([not held_out(d) for d in batch["doc_id"].to_pylist()], pa.bool_())
            distinct, at, sizes = split(batch["text"].filter(kept))
            if len(sizes):
                held.append(pa.table([distinct, pa.array(np.bincount(at, minlength=len(distinct)))], names=["word", "n"]))
                held.append(pa.table([pa.array([b" "], pa.binary()), pa.array([len(sizes)], pa.int64())], names=["word", "n"]))  # the end tokens; no word holds a space
            if sum(map(len, held)) > 2 * FLUSH:
                held = [summed()]
                if len(held[0]) > FLUSH:
                    yield from held.pop().to_batches()
            pa.default_memory_pool().release_unused()
        if held:
            yield from summed().to_batches()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_first(counted: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """(word, n, first): the id that each word starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            real = pc.not_equal(batch["word"], pa.scalar(b" ", pa.binary()))
            flat, starts = encoder.encode(batch["word"].filter(real))
            firsts = np.full(len(batch), END, dtype=np.int32)
            firsts[real.to_numpy(zero_copy_only=False)] = flat[starts[:-1]]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(firsts)], names=["word", "n", "first"])

    return counted.mapInArrow(run, "word binary, n long, first int")


def frequent(counted: DataFrame, most: int = HEAVY) -> dict[bytes, int]:
    """The most frequent short words, ``most`` at most: all whose count reaches the least sufficient power of two's eighth."""
    counted = counted.filter(F.octet_length("word") <= LONG)
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r["b"], r["k"]) for r in counted.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)  # 8 rows for each doubling
    total, least = 0, None
    for b, k in sizes:
        if total + k > most:
            break
        total, least = total + k, b
    return {} if least is None else {bytes(r["word"]): r["n"] for r in counted.filter(bucket >= least).collect()}


@lru_cache(1)
def opening(rank_name: str) -> np.ndarray:
    """Which ids start a word: those whose bytes start with a space, and the end token."""
    out = np.zeros(IDS, dtype=bool)
    out[[i for token, i in ranks(rank_name) if token[:1] == b" "]] = True
    out[END] = True
    return out


class WordEncoder:
    """Ids of distinct words, each with a space before it, so that every word starts at an opening id."""

    def __init__(self, vocabulary: tuple[str, str]):
        self.encoder, self.opens = Encoder(*vocabulary, specials=False), opening(vocabulary[1])

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word's ids start and the last ends)."""
        if not len(words):
            return self._joined([])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().decode("utf-8", "replace")
        texts, safe, word, at = text.split(" "), np.ones(len(words), dtype=bool), 0, 0
        for found in UNSAFE.finditer(text):
            word, at = word + text.count(" ", at, found.start()), found.start()
            safe[word] = False
        if safe.all():
            return self._joined(texts)
        # rarer characters are few: each word with one is segmented alone
        easy, bounds = self._joined([t for t, s in zip(texts, safe) if s])
        hard = [self.encoder.array(" " + t) for t, s in zip(texts, safe) if not s]
        sizes = np.empty(len(texts), dtype=np.int64)
        sizes[safe], sizes[~safe] = np.diff(bounds), [len(h) for h in hard]
        ends = np.cumsum(sizes)
        ids = np.empty(int(ends[-1]), dtype=np.uint32)
        of_easy = np.repeat(safe, sizes)
        ids[of_easy], ids[~of_easy] = easy, np.concatenate(hard)
        return ids, np.append(0, ends)

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        ids = self.encoder.fast.encode_to_numpy(" " + " ".join(texts), disallowed_special=())
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(texts):
            return ids, np.append(starts, len(ids))
        if len(texts) == 1:
            return ids, np.array([0, len(ids)])
        half = len(texts) // 2
        (a, x), (b, y) = self._joined(texts[:half]), self._joined(texts[half:])
        return np.concatenate([a, b]), np.concatenate([x[:-1], y + len(a)])


@lru_cache(1)
def word_encoder(vocabulary: tuple[str, str]) -> WordEncoder:
    """One for all tasks of a worker: to read the vocabulary takes some 0.3 s. ``train`` lets go of it."""
    return WordEncoder(vocabulary)


class Frequent:
    """Counts and subword ids of the words that are looked up, by their places in one list."""

    def __init__(self, counts: dict[bytes, int], vocabulary: tuple[str, str]):
        self.words = pa.array(list(counts), pa.binary())
        self.counts = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        self.ids, self.starts = WordEncoder(vocabulary).encode(self.words)


def cuts(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of each run of values between two bounds."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def looked_up(batches: Iterator[pa.RecordBatch], words: pa.Array) -> Iterator[tuple[pa.RecordBatch, tuple[pa.Array, np.ndarray, np.ndarray], np.ndarray]]:
    """Batches, their :func:`split` texts and the places of their distinct words in ``words`` (its length: not there).

    Arrow hashes all ``words`` anew in each search, so ``TOGETHER`` batches share one.
    """
    batches = iter(batches)
    while group := list(islice(batches, TOGETHER)):
        parts = [split(batch["text"]) for batch in group]
        places = pc.fill_null(pc.index_in(pa.concat_arrays([p[0] for p in parts]), value_set=words), len(words)).to_numpy().astype(np.int64)
        ends = np.cumsum([len(p[0]) for p in parts])
        yield from zip(group, parts, np.split(places, ends[:-1]))


def encode(docs: DataFrame, shared, vocabulary: tuple[str, str]) -> DataFrame:
    """Subword ids of every text, its base sum over frequent words, its rarer words and which of them each rarer occurrence is.

    Frequent words (a broadcast :class:`Frequent`) are looked up, with their ids; the distinct others of a batch are segmented once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, encoder = shared.value, word_encoder(vocabulary)
        many = len(heavy.counts)
        logs = np.append(np.log10(heavy.counts + 0.5), 0.0)
        counts = np.append(heavy.counts, -1).astype("<f4")
        for batch, (every, which, sizes), place in looked_up(batches, heavy.words):
            ids_of = batch["doc_id"].to_pylist()
            unseen = np.flatnonzero(place == many)  # the rarer words
            place[unseen] += np.arange(len(unseen))
            distinct = every.take(pa.array(unseen))
            at, row = place[which], np.repeat(np.arange(len(sizes)), sizes)
            missing, listed = np.flatnonzero(at >= many), np.minimum(at, many)
            other = at[missing] - many
            known, word_logs = np.bincount(row, minlength=len(sizes)) - np.bincount(row[missing], minlength=len(sizes)), counts[listed]
            total = np.bincount(row, weights=logs[listed], minlength=len(sizes))
            flat, starts = encoder.encode(distinct)
            ids = np.concatenate([heavy.ids, flat]).astype("<u2")
            first = np.concatenate([heavy.starts[:-1], starts[:-1] + len(heavy.ids)])
            lengths = np.concatenate([np.diff(heavy.starts), np.diff(starts)])[at]
            ends = np.cumsum(lengths)
            tokens = ids[np.repeat(first[at] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
            codes, which = np.unique(row[missing] * max(1, len(distinct)) + other, return_inverse=True)
            of_row = np.searchsorted(codes // max(1, len(distinct)), np.arange(len(sizes) + 1)).astype(np.int32)
            rare = distinct.take(pa.array(codes % max(1, len(distinct))))
            slots = (which - of_row[row[missing]]).astype("<i4")
            slot_end = np.append(0, np.cumsum(sizes - known))
            word_end = np.append(0, np.cumsum(sizes))
            token_end = np.append(0, ends)[word_end]
            closed = np.full(len(tokens) + len(sizes), END, dtype="<u2")  # each text's ids and the end token
            closed[np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), np.diff(token_end))] = tokens
            arrays = [
                batch["doc_id"], pa.array([held_out(d) for d in ids_of], pa.bool_()), pa.array(sizes + 1), pa.array(total), pa.array(known.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(of_row), rare), cuts(slots, slot_end), cuts(word_logs, word_end), cuts(closed, token_end + np.arange(len(sizes) + 1)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "sum", "known", "tail", "slots", "counts", "ids"])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, ENCODED)


class Classes:
    """Which class each id belongs to, and the log share it has of its class.

    The end token is class 0. The ids that start words are in classes below ``attention.STARTS``, all others
    above. On either side the most frequent ids have classes of their own, and the rest are
    clustered by what precedes them, so a class is about one language and one place in a word.
    """

    def __init__(self, before: np.ndarray, opens: np.ndarray, classes: int = A.CLASSES):
        """``before``: how often each bucket of ids precedes each id."""
        counts = before.sum(1)
        self.of = np.zeros(len(counts), dtype=np.int64)
        order = np.lexsort((np.arange(len(counts)), -counts))
        order = order[order != END]
        for side, first, own, end in ((order[opens[order]], 1, OWN_STARTS, A.STARTS), (order[~opens[order]], A.STARTS, OWN_INNER, classes)):
            self.of[side[:own]] = first + np.arange(min(own, len(side)))
            rest = side[own:]
            if len(rest):
                self.of[rest] = first + own + self._cluster(counts[rest], before[rest], end - first - own)
        smooth = counts + 0.1
        self.share = np.log(smooth / np.bincount(self.of, weights=smooth, minlength=classes)[self.of])

    @staticmethod
    def _cluster(counts: np.ndarray, before: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
        """Weighted k-means of the ids' contexts (square roots of frequencies); ids are in order of frequency."""
        points = np.sqrt((before + before.sum(0) / max(1, before.sum()) * 2) / (before.sum(1, keepdims=True) + 2)).astype(np.float32)
        centres = points[:: max(1, min(len(points), 8 * k) // k)][:k].copy()
        for _ in range(steps):
            best = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            for c in range(len(centres)):
                mine = best == c
                if counts[mine].sum():
                    centres[c] = np.average(points[mine], axis=0, weights=counts[mine])
        return best


class Shares:
    """Absolute discounting of word counts inside the classes of first ids."""

    def __init__(self, of: np.ndarray, by_first: list[tuple[int, int, int, int, int]], classes: int = A.CLASSES):
        """``by_first``: (first id, tokens, words, words seen once, words seen twice)."""
        tokens, kinds, once, twice = np.zeros(classes), np.zeros(classes), 0, 0
        for first, n, many, one, two in by_first:
            tokens[of[first]] += n
            kinds[of[first]] += many
            once, twice = once + one, twice + two
        self.discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        with np.errstate(divide="ignore"):
            self.norm = np.log(tokens)
        # a class without any word is spelled; the end token is its class's only member
        self.spelled = np.log(np.where(tokens > 0, self.discount * kinds / np.maximum(tokens, 1), 1.0))

    def logs(self, n: np.ndarray, of: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """Log probabilities of words of classes ``of`` given their classes."""
        with np.errstate(divide="ignore", invalid="ignore"):
            counted = np.where(n > 0, np.log(np.maximum(n - self.discount, 1e-9)) - self.norm[of], -np.inf)
        return np.logaddexp(counted, self.spelled[of] + spelling)


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows in a row, where each row's begin) of a column of their bytes."""
    bounds = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype="<u2")[bounds[0] // 2 : bounds[-1] // 2], (bounds[:-1] - bounds[0]) // 2


def contexts(frame: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each class (or bucket) precedes each id, over all training texts."""
    shared, k = frame.sparkSession.sparkContext.broadcast(of.astype(np.uint8)), A.CLASSES
    size = -(-IDS // SLICES) * k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = np.zeros(SLICES * size, dtype=np.int64), []

        def add() -> None:
            if held:
                np.add(table, np.bincount(np.concatenate(held), minlength=len(table)), out=table)
                held.clear()

        for batch in batches:
            if len(batch):
                ids, firsts = listed(batch["ids"])
                before = np.empty(len(ids), dtype=np.uint8)
                before[1:] = np.take(shared.value, ids[:-1])
                before[firsts] = shared.value[END]
                codes = ids.astype(np.int64)
                codes *= k
                codes += before
                held.append(codes)
            if sum(map(len, held)) >= HELD:
                add()
        add()
        for i in range(SLICES):  # every SLICES-th id: frequent ids are neighbours
            part = table.reshape(-1, SLICES, k)[:, i].ravel()
            seen = np.flatnonzero(part)
            if len(seen):
                arrays = [seen.astype("<i4"), part[seen].astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["slice", "k", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                sums.setdefault(r["slice"], np.zeros(size, dtype=np.int64))[np.frombuffer(r["k"], dtype="<i4")] += np.frombuffer(r["n"], dtype="<i8")
        for i, part in sums.items():
            seen = np.flatnonzero(part)
            arrays = [((seen // k * SLICES + i) * k + seen % k).astype("<i4"), part[seen].astype("<i8")]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["k", "n"])

    table = np.zeros(SLICES * size, dtype=np.int64)
    counted = frame.filter("not held_out").select("ids").mapInArrow(count, "slice int, k binary, n binary")
    for r in counted.repartition(SLICES, "slice").mapInArrow(total, "k binary, n binary").toArrow().to_pylist():  # SLICES rows
        table[np.frombuffer(r["k"], dtype="<i4")] = np.frombuffer(r["n"], dtype="<i8")
    shared.destroy()
    return table[: IDS * k].reshape(IDS, k)


def pair_tables(frame: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities of a class after another as :func:`attention.parts`, log shares of ids in their class after each class)."""
    n = contexts(frame, classes.of).astype(np.float64)
    pairs = np.zeros((A.CLASSES, A.CLASSES))
    np.add.at(pairs, classes.of, n)
    pairs = pairs.T  # before, after
    single = (pairs.sum(0) + 1) / (pairs.sum() + A.CLASSES)
    bigram = A.parts(np.log((pairs + 10 * single) / (pairs.sum(1, keepdims=True) + 10)))
    n += 5 * np.exp(classes.share)[:, None]
    n /= pairs.T[classes.of] + 5
    return bigram.astype(np.float32), np.log(n, out=n).astype(np.float32)


def picked(texts: Iterable[bytes], turn: int, rounds: int = ROUNDS) -> Iterator[list[np.ndarray]]:
    """The texts of one round (every ``rounds``-th, another one each round), in runs of about ``GROUP`` ids."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        if i % rounds == turn:
            held.append(np.frombuffer(raw, dtype="<u2"))
            size += len(held[-1])
            if size >= GROUP:
                yield held
                held, size = [], 0
    if held:
        yield held


def trained_rows(trainer: A.Trainer) -> Iterator[pa.RecordBatch]:
    """A task's weights as rows of ``WIDTH`` numbers, each with how many tokens it was trained on, in blocks; rows without any are left out."""
    values = A.flat(trainer.w)
    whole = np.concatenate([values, np.zeros(-len(values) % A.WIDTH, dtype=values.dtype)]).reshape(-1, A.WIDTH)
    rows = np.concatenate([whole, trainer.table, trainer.head.weights])
    met = np.concatenate([np.full(len(whole), float(trainer.seen)), trainer.met, trainer.head_met])
    size = -(-len(rows) // BLOCKS)
    for block in range(BLOCKS):
        k = np.flatnonzero(met[block * size : (block + 1) * size])
        arrays = [k.astype("<i4"), met[block * size + k], rows[block * size + k].astype("<f4")]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["block", "k", "n", "x"])


def averaged(trained: DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their averages over all tasks that trained them, by tokens)."""
    size = -(-rows // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                n, x = sums.setdefault(r["block"], (np.zeros(size), np.zeros((size, A.WIDTH))))
                k, many = np.frombuffer(r["k"], dtype="<i4"), np.frombuffer(r["n"], dtype="<f8")
                n[k] += many
                x[k] += many[:, None] * np.frombuffer(r["x"], dtype="<f4").reshape(-1, A.WIDTH)
        for block, (n, x) in sums.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in ((block * size + k).astype("<i4"), (x[k] / n[k, None]).astype("<f4"))], names=["k", "x"])

    for r in trained.repartition(BLOCKS, "block").mapInArrow(run, "k binary, x binary").toArrow().to_pylist():  # BLOCKS rows
        yield np.frombuffer(r["k"], dtype="<i4"), np.frombuffer(r["x"], dtype="<f4").reshape(-1, A.WIDTH)


def train(frame: DataFrame, of: np.ndarray, bigram: np.ndarray, head: A.Head, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(weights, rows of the ids) after data-parallel rounds over the training texts; those of ``head`` are set."""
    weights, table = A.start(), np.zeros((IDS, A.WIDTH), dtype=np.float32)
    for turn in range(rounds):
        shared = frame.sparkSession.sparkContext.broadcast((weights, bigram, of, table, head))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            first, bigram, of, table, head = shared.value
            word_encoder.cache_clear()
            trainer = A.Trainer(first, bigram, of=of, table=table, head=copy(head))
            for held in picked((raw for batch in batches for raw in batch["ids"].to_pylist()), turn, rounds):
                trainer.learn(*A.windows(np.concatenate(held), END, np.array([len(t) for t in held]), overlap=0))
            if trainer.seen:
                yield from trained_rows(trainer)

        values = A.flat(weights)
        whole = -(-len(values) // A.WIDTH)
        values = np.concatenate([values, np.zeros(whole * A.WIDTH - len(values), dtype=values.dtype)])
        rows = np.concatenate([values.reshape(-1, A.WIDTH), table, head.weights])
        for k, x in averaged(frame.filter("not held_out").select("ids").mapInArrow(run, "block int, k binary, n binary, x binary"), len(rows)):
            rows[k] = x
        weights, table, head.weights = A.unflat(rows[:whole].ravel()), rows[whole : whole + IDS], rows[whole + IDS :]
        shared.destroy()
    return weights, table


class Model:
    """The trained model; scores encoded texts word by word."""

    def __init__(self, of: np.ndarray, share: np.ndarray | None, bigram: np.ndarray, weights: dict[str, np.ndarray], shares: Shares, table: np.ndarray | None = None, head: A.Head | None = None):
        """``table``: the ids' own rows; ``head``: tells ids of a class apart. Without them ids are their classes, and ``share`` is an id's log share of its class after each class."""
        self.of, self.share, self.bigram, self.weights, self.shares, self.table, self.head = of, share, bigram, weights, shares, table, head

    def prepare(self) -> Model:
        self.tables = A.Tables(self.weights, self.bigram) if self.head is None else A.Tables(self.weights, self.bigram, self.of, self.table)
        return self

    def words(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words and end tokens of all texts, in order: class, log probability of that class
        where a word starts, that of the spelling and its end given the class; and where each text's begin.

        All texts share one batch of windows.
        """
        ids, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        of, ends = self.of[ids], np.cumsum(sizes)
        before = np.concatenate([[END], ids[:-1]])
        before[ends[:-1]] = END
        tokens = (of, self.of[END]) if self.head is None else (ids, END)
        logs, turns, state = self.tables.log_probabilities(*A.windows(*tokens, sizes))
        starts = np.flatnonzero(of < A.STARTS)
        opens = turns[starts]
        share = self.share[ids, self.of[before]] if self.head is None else self.head.log_probabilities(state, ids, self.of[before])
        logs += share
        first = logs[starts] - share[starts] - opens
        logs[starts] = share[starts]
        spelling = np.add.reduceat(logs, starts)
        last = np.searchsorted(starts, ends) - 1  # the end tokens, which nothing follows
        after = np.append(opens[1:], np.float32(0))
        after[last] = 0
        return of[starts], first, spelling + after, np.append(0, last + 1)


def _groups(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``GROUP`` ids."""
    at, size = 0, 0
    for i, raw in enumerate(raws):
        size += len(raw) // 2
        if size >= GROUP or i == len(raws) - 1:
            yield at, i + 1
            at, size = i + 1, 0


def speak(frame: DataFrame, shared, ends: int) -> DataFrame:
    """Each text's score over its frequent words and the end token, and what each rarer word's score needs beside its count; ``shared`` is a broadcast :class:`Model`."""
    names = [c.split()[0] for c in SPOKEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = shared.value.prepare(), np.array([ends], dtype="<f4")
        for batch in batches:
            raws, counted, slots = (batch[c].to_pylist() for c in ("ids", "counts", "slots"))
            tails = batch["tail"].offsets.to_numpy().astype(np.int64)
            tails -= tails[0]
            scores, said, sizes = [], [], []
            for a, b in _groups(raws):
                of, first, spelling, bounds = model.words([np.frombuffer(r, dtype="<u2") for r in raws[a:b]])
                n = np.concatenate([x for r in counted[a:b] for x in (np.frombuffer(r, dtype="<f4"), end)])
                row, frequent = np.repeat(np.arange(b - a), np.diff(bounds)), n >= 0
                logs = first + model.shares.logs(np.maximum(n, 0), of, spelling)
                scores.append(np.bincount(row[frequent], weights=logs[frequent], minlength=b - a))
                rare = np.flatnonzero(~frequent)
                slot = np.concatenate([np.frombuffer(r, dtype="<i4") for r in slots[a:b]]) + (tails[a:b] - tails[a])[row[rare]]
                order = rare[np.argsort(slot, kind="stable")]
                said.append(np.stack([x[order] for x in (of, first, spelling)], axis=1).astype("<f4"))
                sizes.append(np.bincount(slot, minlength=tails[b] - tails[a]))
            offsets = np.append(0, 12 * np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))).astype(np.int32)
            raw = np.concatenate([np.zeros((0, 3), "<f4"), *said]).tobytes()
            flat = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
            listed = pa.ListArray.from_arrays(pa.array(tails.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:6]), pa.array(np.concatenate([np.zeros(0), *scores])), batch["tail"], listed], names=names)

    return frame.select(*names[:6], "tail", "slots", "counts", "ids").mapInArrow(run, SPOKEN)


def rare_scores(counted: DataFrame, shares: Shares) -> DataFrame:
    """(row, tail_sum, tail_known, tail_score) of the rarer words of rows: ``counted`` holds (row, n, said)."""
    shared = counted.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = shared.value
        for batch in batches:
            raws = batch["said"].to_pylist()
            many = pc.binary_length(batch["said"]).to_numpy().astype(np.int64) // 12
            said, place = np.frombuffer(b"".join(raws), dtype="<f4").reshape(-1, 3).astype(np.float64), np.repeat(np.arange(len(raws)), many)
            n = batch["n"].to_numpy()
            logs = said[:, 1] + shares.logs(n[place], said[:, 0].astype(np.int64), said[:, 2])
            scores = np.bincount(place, weights=logs, minlength=len(raws))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(many * np.log10(n + 0.5)), pa.array(np.where(n > 0, many, 0)), pa.array(scores)], names=["row", "tail_sum", "tail_known", "tail_score"])

    return counted.mapInArrow(run, "row long, tail_sum double, tail_known long, tail_score double").groupBy("row").agg(*(F.sum(c).alias(c) for c in ("tail_sum", "tail_known", "tail_score")))


def score_documents(docs: DataFrame, vocabulary: tuple[str, str] = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone; a null doc_id hashes as the empty string;
    repeated rows count as often as they occur. An empty table gives no rows, and without
    training rows nothing is known. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    # many words or few texts: the bytes bound a batch, not the rows
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    scratch, share_out = Scratch(docs.sparkSession, "lm"), docs.sparkSession.sparkContext.broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = scratch.keep(with_first(count_words(own), vocabulary), "words")
    times = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0))
    by_first = [tuple(r) for r in counted.groupBy("first").agg(F.sum("n"), F.count("*"), times(1), times(2)).collect()]  # a row for each id at most
    tokens, distinct = sum(r[1] for r in by_first), sum(r[2] for r in by_first)
    ends = next((r[1] for r in by_first if r[0] == END), 0)
    heavy = frequent(counted)
    heavy.pop(b" ", None)
    lookup = share_out(Frequent(heavy, vocabulary))
    frame = scratch.keep(encode(own, lookup, vocabulary).withColumn("row", F.monotonically_increasing_id()), "encoded", codec="snappy")
    lookup.destroy()  # reused workers would keep it
    classes = Classes(contexts(frame, np.arange(IDS) % A.CLASSES), opening(vocabulary[1]))
    bigram, share = pair_tables(frame, classes)
    head, shares = A.Head(classes.of, classes.share, share), Shares(classes.of, by_first)
    del share  # the head holds it
    weights, table = train(frame, classes.of, bigram, head)
    model = share_out(Model(classes.of, None, bigram, weights, shares, table, head))
    spoken = scratch.keep(speak(frame, model, ends), "spoken")
    model.destroy()
    scratch.drop(frame)
    words_of = spoken.select("row", F.explode(F.arrays_zip("tail", "said")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.said").alias("said"))
    tail = rare_scores(words_of.join(counted, "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), "said"), shares)
    norm = float(np.log10(tokens + 0.5 * (distinct + 1)))
    out = spoken.drop("tail", "said").join(tail, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        ((F.col("score") + F.coalesce("tail_score", F.lit(0.0))) / F.lit(float(np.log(10)))).alias("score"),
    )
