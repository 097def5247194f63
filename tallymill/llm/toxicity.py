"""Toxicity scores of texts whose words may be disguised.

A noisy-channel decoder restores disguised words before they are scored. A suspicious
word (digits or signs among or before its letters or instead of them, a letter three times in
a row, a run of single characters) of any length becomes a lattice: each character may stand for itself or for the letters it is
used for in leetspeak, a separator may be dropped or kept as a word boundary, a repeated
letter may be meant once or twice. Viterbi decoding with a beam finds the likeliest
readings under a character trigram model counted over all documents.

A logistic model with an L1 penalty scores the restored words (each distinct word of a
document: the word and its stems). Only features that go with toxic texts beyond what chance
would give the best of all features (a G test) get a weight, so that a clean text doesn't gather
weight by its length. It is fitted on at most ``SAMPLE`` labelled rows of the
training folds, chosen by a hash of their ids; every text is scored whole. The decoded
weight of a word depends on the word alone, so workers remember it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE = 8_192
BITS = 18
REMEMBERED = 200_000
WHOLE = 40  # slots of a lattice that are decoded in one go; longer ones in overlapping pieces
THRESHOLD = 0.7
RANDOM = float(np.log(28))  # cost of a character drawn at random

#: The letters that signs stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*~'/\\,^:;"

_EDGES = ".,;:?\"'()[]{}<>*#%&~^_-/\\|!"
_PLAIN_EDGES = ".,;:?\"'()[]{}<>*#%&"
_LETTER = re.compile(r"[^\W\d_]")
_SUSPICIOUS = re.compile(r"(?=.*[^\W\d_])(?=.*[0-9@$!|+(€£.\-_*~'/\\,^:;]|.*([^\W\d_])\1\1)")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(€£])(?:[ \t._\-*]+(?:[^\W_]|[@$!|+(€£])){2,}(?!\w)")

# classes of the character model: 26 letters, a boundary, anything beyond ASCII
_CLASS = np.array([b - 97 if 97 <= b <= 122 else b - 65 if 65 <= b <= 90 else 26 if b < 128 else 27 for b in range(129)], dtype=np.int64)
_SIZE = 28


def _class(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 27 if ord(c) >= 128 else 26


class CharacterModel:
    """Costs (negative log probabilities) of a character class after two others."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        two = table.sum(0) + 0.5
        back = two / two.sum(1, keepdims=True)
        self.cost = -np.log((table + 20 * back[None]) / (table.sum(2, keepdims=True) + 20))
        self.rows = self.cost.tolist()

    def decode(self, lattice: list[list[tuple[str, float]]], beam: int = 12, best: int = 3) -> list[str]:
        """The likeliest readings of a lattice: each slot offers (string, channel cost)."""
        return [text for _, text in self.ranked(lattice, beam, best)]

    def ranked(self, lattice: list[list[tuple[str, float]]], beam: int = 12, best: int = 3) -> list[tuple[float, str]]:
        """The likeliest readings with their costs."""
        live = [(0.0, 26, 26, "")]
        for slot in lattice:
            step = []
            for cost, a, b, text in live:
                for out, channel in slot:
                    total, x, y = cost + channel, a, b
                    for c in out:
                        k = _class(c)
                        total += self.rows[x][y][k]
                        x, y = y, k
                    step.append((total, x, y, text + out))
            step.sort()
            live, seen = [], set()
            for h in step:
                if h[3] not in seen:
                    seen.add(h[3])
                    live.append(h)
                    if len(live) == beam:
                        break
        ends = sorted((cost + self.rows[a][b][26], text) for cost, a, b, text in live)
        return ends[:best]


def pieces(slots, size: int = 60) -> Iterator:
    """Runs of ``size`` slots, each with half a run before it, so that no word falls between two."""
    return (slots[max(0, i - size // 2) : i + size] for i in range(0, len(slots), size))


def count_characters(docs: DataFrame) -> CharacterModel:
    """The character model of all texts; Spark adds up one table of trigram counts per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SIZE**3, dtype=np.int64)
        for batch in batches:
            raw = "\n".join(t for t in batch["text"].to_pylist() if t)
            c = np.take(_CLASS, np.minimum(np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128))
            if len(c) > 2:
                counts += np.bincount(c[:-2] * (_SIZE * _SIZE) + c[1:-1] * _SIZE + c[2:], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["k", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIZE**3, dtype=np.int64)
    for k, n in found.collect():  # at most 28 ** 3 rows
        counts[k] = n
    return CharacterModel(counts)


def word_lattice(word: str) -> list[list[tuple[str, float]]]:
    """Readings of the characters of one suspicious word."""
    slots, i = [], 0
    while i < len(word):
        c, run = word[i], 1
        while i + run < len(word) and word[i + run] == c:
            run += 1
        if c.isalpha():
            slots.append([(c, 0.0)] if run == 1 else [(c, 0.3), (c * 2, 0.3 if run > 2 else 0.0)])
        else:
            readings = [(letter * n, 0.7) for letter in LEET.get(c, "") for n in ({1, 2} if run > 1 else {1})]
            if c in SEPARATORS or not readings:
                readings += [("", 1.0), (" ", 1.5)]
            elif c in "!|(":
                readings += [("", 2.0), (" ", 1.0)]
            slots.append(readings)
        i += run
    return slots


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """Readings of single characters set apart: each gap is a boundary or nothing."""
    slots: list[list[tuple[str, float]]] = []
    for c in run:
        if c.isalnum() or c in LEET:
            slots.append([(c, 0.0)] if c.isalpha() else [(x, 0.7) for x in LEET.get(c, " ")])
        elif slots and slots[-1] != [("", 0.2), (" ", 1.0)]:
            slots.append([("", 0.2), (" ", 1.0)])
    return slots


class Restorer:
    """Texts to the forms of their distinct words, disguises undone."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def forms(self, word: bytes) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = tuple(dict.fromkeys(self._forms(word.decode("utf-8", "replace").lower())))
        return found

    def _forms(self, word: str) -> list[str]:
        core = word.strip(_EDGES)
        if not core:
            core = word.strip(_PLAIN_EDGES)
            return self._unlettered(core) if core else []
        before = word[: word.index(core)]
        signs = before[len(before.rstrip("!|(")) :]
        if not _LETTER.search(core):
            return self._unlettered(signs + core)
        plain = not _SUSPICIOUS.match(core)
        out = [core] if plain else []
        if signs:  # may be letters or a mark before the word
            out += self._readings(word_lattice(signs + core))
        if not plain:
            bare = word.lstrip(_PLAIN_EDGES).rstrip(_PLAIN_EDGES)
            out += self._readings(word_lattice(bare if bare[-1:] in "!|" and len(bare) == len(core) + 1 else core))
        return out

    def _readings(self, lattice: list[list[tuple[str, float]]]) -> list[str]:
        """The words of a lattice's readings; a long one is decoded in overlapping pieces."""
        own = [lattice] if len(lattice) <= WHOLE else pieces(lattice)
        return [p for piece in own for text in self.model.decode(piece) for p in text.split()]

    def _unlettered(self, core: str) -> list[str]:
        """A word of signs and digits alone: itself, and its readings that are likelier than random letters."""
        lattice = word_lattice(core)
        own = [lattice] if len(lattice) <= WHOLE else pieces(lattice)
        found = [text for piece in own for cost, text in self.model.ranked(piece) if cost < RANDOM * (len(text) + 1)]
        return [core] + [p for text in found for p in text.split()]

    def spaced(self, text: str) -> list[str]:
        """Readings of all runs of single characters in a text."""
        out = []
        for m in _SPACED.finditer(text):
            for run in pieces(spaced_lattice(m[0].lower())):
                for t in self.model.decode(run):
                    out += [p for p in t.split() if len(p) > 2]
        return out

    def words(self, text: str | None) -> set[bytes]:
        return set(text.encode("utf-8", "surrogatepass").lower().split()) if text else set()

    def singles(self, words: set[bytes]) -> bool:
        return any(len(w) <= 3 for w in words)  # a sign may have three bytes


def features(form: str) -> list[int]:
    """Hashed features of one word: itself and its stems."""
    parts = [form] + [f"{n}:{form[:n]}" for n in (4, 5, 6) if len(form) >= n]
    return [zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts]


def document_features(restorer: Restorer, text: str | None) -> np.ndarray:
    own = restorer.words(text)
    forms = {f for w in own for f in restorer.forms(w)}
    if text and restorer.singles(own):
        forms.update(restorer.spaced(text))
    return np.array(sorted(i for f in forms for i in features(f)), dtype=np.int32)


class Scorer:
    """Scores texts with the fitted weights; remembers the weight of each word."""

    def __init__(self, model: CharacterModel, weights: dict[int, float], bias: float):
        self.restorer, self.weights, self.bias, self.known = Restorer(model), weights, bias, {}

    def weight(self, forms) -> float:
        return sum(self.weights.get(i, 0.0) for f in forms for i in features(f))

    def score(self, text: str | None) -> float:
        own, known = self.restorer.words(text), self.known
        new = [w for w in own if w not in known]
        if new:
            if len(known) >= REMEMBERED:
                known.clear()
                new = list(own)
            for w in new:
                forms = self.restorer._forms(w.decode("utf-8", "replace").lower())
                known[w] = max((self.weight((f,)) for f in forms), default=0.0)
        logit = self.bias + sum(map(known.__getitem__, own))
        if text and self.restorer.singles(own):
            logit += sum(max(0.0, self.weight((f,))) for f in set(self.restorer.spaced(text)))
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def beyond_chance(toxic: np.ndarray, seen: np.ndarray, positives: float, total: int) -> np.ndarray:
    """Features whose share of toxic texts exceeds the base rate by more than the best of as many random ones would (G test)."""
    rate = (positives + 0.5) / (total + 1)
    n, k = np.maximum(seen, 1), np.minimum(toxic, seen)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(k > 0, k * np.log(k / (n * rate)), 0) + np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - rate))), 0))
    return (seen > 0) & (k > n * rate) & (g > 2 * np.log(max(2, int((seen > 1).sum()))))


def fit(rows: list[tuple[int, bytes]], rounds: int = 150, rate: float = 0.1, penalty: float = 1e-4, toxic_weight: float = 3.0) -> tuple[dict[int, float], float]:
    """Logistic regression with an L1 penalty and no negative weights (Adam, proximal steps) on (label, feature ids)."""
    if not rows:
        return {}, -2.0
    ids = [np.frombuffer(raw, dtype=np.int32) for _, raw in rows]
    y, sizes = np.array([label for label, _ in rows], dtype=float), np.array([len(i) for i in ids])
    flat, dims = np.concatenate(ids) if sizes.sum() else np.zeros(0, np.int32), 1 << BITS
    row = np.repeat(np.arange(len(y)), sizes)
    telling = beyond_chance(np.bincount(flat, weights=y[row], minlength=dims), np.bincount(flat, minlength=dims), y.sum(), len(y))
    row, flat = row[telling[flat]], flat[telling[flat]]
    w, m, v = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    rate0 = (y.sum() + 1) / (len(y) + 2)
    b, mb, vb = float(np.log(rate0 / (1 - rate0))), 0.0, 0.0
    weigh = np.where(y > 0, toxic_weight, 1.0) / len(y)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[flat], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weigh
        g, gb = np.bincount(flat, weights=error[row], minlength=dims), error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-6
        w -= rate * (m / (1 - 0.9**t)) / scale
        w = np.maximum(w - rate * penalty / scale.clip(min=1e-4), 0)  # no word speaks for a text
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return {int(i): float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(b)


def in_fold(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Whether a row is held out; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, labels: DataFrame, model: CharacterModel, sample: int = SAMPLE) -> tuple[dict[int, float], float]:
    """Weights from the labelled training rows, at most ``sample`` of them (smallest hashed ids)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            rows = [document_features(restorer, t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(rows, pa.binary())], names=["doc_id", "toxic", "ids"])

    found = texts.mapInArrow(run, "doc_id long, toxic int, ids binary").collect()
    return fit([(r["toxic"], bytes(r["ids"])) for r in sorted(found, key=lambda r: (r["doc_id"], r["toxic"], bytes(r["ids"])))])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words. Labels of unknown
    documents and null labels are ignored; without any labels all scores are low. Only
    the text is scored: repeated rows get equal scores, and other columns play no part.
    """
    small_batches(docs.sparkSession)
    model = count_characters(docs)
    weights, bias = train(docs, labels, model, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    out = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
