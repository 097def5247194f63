"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``width`` consecutive words (a shorter item is one
window). A window occurs in a document only if every shingle (pair of neighbouring
words; the word itself for a one-word window) of the window does, so for full containment
the necessary prefix of a window is its single rarest shingle. Shingles are ordered by
how often they occur in all documents. A document position holding a prefix shingle
proposes the windows filed under it; the position fixes where the window would start,
which gives the length and positional bounds (it must start and end inside the
document), and the survivors are compared word by word.

The item side is a hash index of at most ``block_bytes`` of item text, broadcast; a
larger benchmark is dealt into blocks of that size by item, which pass over the
documents one after the other. The documents are never shuffled and no pair of
documents is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches

WIDTH = 10
BLOCK_BYTES = 4 << 20

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES or 0x41 <= b <= 0x5A else 0x20 for b in range(256))

HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Index:
    """The windows of one block of items, filed under their rarest shingle."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        self.vocab: dict[bytes, int] = {}
        self.ids, self.width = [i for i, _ in items], width
        flat: list[int] = []
        windows: list[tuple[int, int, int]] = []  # item, start in flat, words
        for k, (_, text) in enumerate(items):
            own = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            if own:
                size = min(width, len(own))
                windows += [(k, len(flat) + i, size) for i in range(len(own) - size + 1)]
            flat += own
        self.flat = np.array(flat, dtype=np.int64)
        self.windows = np.array(windows, dtype=np.int64).reshape(-1, 3)
        self.base = len(self.vocab) + 1
        shingles = {k for row in self.windows for k in self._shingles(self.flat[row[1] : row[1] + row[2]]).tolist()}
        self.shingles = np.array(sorted(shingles), dtype=np.int64)

    def _shingles(self, ids: np.ndarray) -> np.ndarray:
        return ids[:1] if len(ids) == 1 else ids[:-1] * self.base + ids[1:] + self.base

    def encode(self, text: str | None) -> tuple[int, np.ndarray]:
        own = words(text)
        get = self.vocab.get
        return len(own), np.fromiter((get(w, -1) for w in own), dtype=np.int64, count=len(own))

    def keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, position) of all shingles of a document that some window has."""
        if not len(ids) or not len(self.shingles):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        single = np.flatnonzero(known)
        double = np.flatnonzero(known[:-1] & known[1:])
        keys = np.concatenate([ids[single], ids[double] * self.base + ids[double + 1] + self.base])
        at = np.concatenate([single, double])
        place = np.minimum(np.searchsorted(self.shingles, keys), len(self.shingles) - 1)
        own = self.shingles[place] == keys
        return place[own], at[own]

    def count(self, text: str | None, counts: np.ndarray) -> None:
        place, _ = self.keys(self.encode(text)[1])
        counts += np.bincount(place, minlength=len(counts))

    def order(self, counts: np.ndarray) -> Index:
        """File each window under its rarest shingle (ties: the first of the window)."""
        filed = []
        for k, start, size in self.windows.tolist():
            place = np.searchsorted(self.shingles, self._shingles(self.flat[start : start + size]))
            offset = int(np.argmin(counts[place]))
            filed.append((int(place[offset]), k, start, size, offset))
        filed.sort()
        self.filed = np.array(filed, dtype=np.int64).reshape(-1, 5)
        self.prefix = np.unique(self.filed[:, 0])
        self.first = np.searchsorted(self.filed[:, 0], self.prefix)
        self.many = np.diff(np.append(self.first, len(self.filed)))
        self.slot = np.full(len(self.shingles) + 1, -1, dtype=np.int64)
        self.slot[self.prefix] = np.arange(len(self.prefix))
        return self

    def find(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray, set[int]]:
        """Words of the text, and starts, ends and items of all windows that occur in it."""
        n, ids = self.encode(text)
        place, at = self.keys(ids)
        slot = self.slot[place]
        at, slot = at[slot >= 0], slot[slot >= 0]
        starts, ends, items = [], [], set()
        step = 50_000  # candidates compared at once
        for lo in range(0, len(at), 2_000):
            s, p = slot[lo : lo + 2_000], at[lo : lo + 2_000]
            many = self.many[s]
            rows = np.repeat(self.first[s] - np.cumsum(many) + many, many) + np.arange(many.sum())
            begin = np.repeat(p, many) - self.filed[rows, 4]
            inside = (begin >= 0) & (begin + self.filed[rows, 3] <= n)
            rows, begin = rows[inside], begin[inside]
            for i in range(0, len(rows), step):
                r, b = rows[i : i + step], begin[i : i + step]
                size = self.filed[r, 3]
                same = np.ones(len(r), dtype=bool)
                for j in range(self.width):
                    live = same & (j < size)
                    same[live] = ids[b[live] + j] == self.flat[self.filed[r[live], 2] + j]
                starts.append(b[same])
                ends.append(b[same] + size[same])
                items.update(self.filed[r[same], 1].tolist())
        none = np.zeros(0, np.int64)
        return n, np.concatenate([none, *starts]), np.concatenate([none, *ends]), items


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as sorted, disjoint ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def cut_long(text: str | None, width: int, size: int) -> Iterator[str | None]:
    """Pieces of about ``size`` bytes of an item that hold all its windows: neighbours share ``width - 1`` words."""
    if text is None or len(text) <= size // 4:
        yield text
        return
    own, at = words(text), 0
    while at == 0 or at + width <= len(own):
        end, held = at, 0
        while end < len(own) and (held < size or end - at < 2 * width):
            held += len(own[end]) + 1
            end += 1
        yield b" ".join(own[at:end]).decode("utf-8", "surrogatepass")
        if end == len(own):
            return
        at = end - width + 1


def blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The different items, in blocks of about ``block_bytes`` of text each; a long item is dealt in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                found = list(cut_long(text, width, block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.string())], names=["item_id", "text"])

    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    own = own.mapInArrow(run, "item_id string, text string").distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // block_bytes
    for b in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r[0] or "", r[1]) for r in part.collect()), key=lambda x: (x[0], x[1] or ""))


def rarity(docs: DataFrame, index: Index) -> np.ndarray:
    """Occurrences of the block's shingles in all documents."""
    if not len(index.shingles):
        return np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts = np.zeros(len(own.shingles), dtype=np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                own.count(text, counts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["shingle", "n"])

    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(index.shingles), dtype=np.int64)
    for shingle, n in found:  # at most the shingles of one block
        counts[shingle] = n
    shared.unpersist()
    return counts


def matcher(shared):
    """The UDF that adds a block's windows to those found so far."""

    @F.pandas_udf(HITS)
    def match(text: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        own, rows = shared.value, []
        for value, old_starts, old_ends, old_items in zip(text, before["starts"], before["ends"], before["items"]):
            n, starts, ends, items = own.find(value)
            starts, ends = merge(np.append(starts, old_starts).astype(np.int64), np.append(ends, old_ends).astype(np.int64))
            rows.append((n, starts.astype(np.int32), ends.astype(np.int32), sorted({*(own.ids[i] for i in items), *old_items})))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return match


def with_hits(docs: DataFrame, benchmark: DataFrame, column: str = "_hits", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct of the benchmark windows found in ``text`` (see ``HITS``).

    A null or wordless text has no words and no hits; a null or wordless item has no
    window; items with equal texts are all named, and repeated item rows count once.
    All other columns and all rows of ``docs`` stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch, texts = Scratch(spark, "decontaminate"), docs.select(F.col("text").cast("string").alias("text"))
    indexes = blocks(benchmark, width, block_bytes)
    before = F.struct(F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("items"))
    pending = next(indexes)
    while pending is not None:
        index = Index(pending, width)
        shared = spark.sparkContext.broadcast(index.order(rarity(texts, index)))
        pending = next(indexes, None)
        docs = docs.withColumn(column, matcher(shared)(F.col("text").cast("string"), before))
        before = F.struct(*[F.col(column)[c].alias(c) for c in ("starts", "ends", "items")])
        if pending is not None:
            docs = scratch.keep(docs, "hits")
    return docs


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits (the digest is that of the empty string); null and
    wordless items have no window; repeated rows get equal reports; empty tables give no rows or
    no hits; other columns are ignored.
    """
    hit = with_hits(docs.select("doc_id", "text"), benchmark, "_hits", width, block_bytes)

    @F.pandas_udf("n_hit long, n_items long, items_sha256 string")
    def digest(hits: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(np.sum(e) - np.sum(s)), len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for s, e, i in zip(hits["starts"], hits["ends"], hits["items"])]
        return pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256"])

    out = hit.select("doc_id", F.col("_hits.n_words").alias("n_words"), digest("_hits").alias("d"))
    return out.select("doc_id", "n_words", "d.*", (F.col("d.n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any benchmark window, with their columns unchanged, whatever their names.

    Null and empty texts have no window and stay, as do all repeated rows of a clean text; an empty
    benchmark removes nothing and an empty table stays empty.
    """
    column = fresh("_hits", docs)
    return with_hits(docs, benchmark, column, width).filter(F.size(F.col(column)["starts"]) == 0).drop(column)
