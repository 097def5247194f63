"""Quality filtering by weak supervision, in DataFrame functions alone.

Each rule looks at a document's measurements and votes good (1), bad (-1) or abstains
(0). Nobody labels anything: expectation-maximisation over the vote patterns of all
documents estimates how often each rule is right about good and about bad documents,
and the posterior probability that a document is good replaces a filter that demands
that all rules pass. The patterns are pre-aggregated by Spark; the driver sees one row
for each distinct pattern, at most 3**(number of rules), whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDTH, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
THRESHOLD = 0.5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeat_words(words: Column, width: int = WIDTH) -> Column:
    """Words covered by windows of ``width`` words that occur at least twice among ``words``.

    Windows are compared by 64-bit hash. Only documents with some repeated window sort theirs.
    """

    def covered(hashes: Column) -> Column:
        def scan(run: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(run, k)["h"] == x["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(run, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, scan))

    def windows(own: Column) -> Column:
        heads = F.slice(own, F.lit(1), F.size(own) - (width - 1))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(own, i + k) for k in range(1, width)]))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashed, covered))


def measure(text: Column) -> Column:
    """The measurements of one text as a struct; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    dup_lines = let(lines, lambda own: F.struct(F.size(own).alias("all"), (F.size(own) - F.size(F.array_distinct(own))).alias("dup")))
    by_word = let(words, lambda own: F.struct(F.size(own).alias("n"), repeat_words(own).alias("repeat"), F.size(F.array_distinct(own)).alias("distinct")))

    def pack(w: Column) -> Column:
        return let(dup_lines, lambda d: F.struct(
            w["n"].cast("long").alias("n_words"),
            _without(text, SPACES).cast("long").alias("word_chars"),
            (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            d["dup"].cast("long").alias("n_dup_lines"),
            w["repeat"].cast("long").alias("n_repeat_words"),
            w["distinct"].cast("long").alias("n_distinct"),
            d["all"].cast("long").alias("n_lines"),
            (F.length(text) - _without(text, UPPER)).cast("long").alias("n_upper"),
            (F.length(text) - _without(text, "!")).cast("long").alias("n_shouts"),
        ))

    return let(by_word, pack)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _per(count: Column, whole: Column) -> Column:
    return count / F.greatest(whole, F.lit(1))


def _bad(found: Column) -> Column:
    return F.when(found, -1).otherwise(0)


#: Rules by name: measurements to a vote. Each kind of junk is seen by two rules at least,
#: so that they can confirm each other; a rule that sees nothing wrong abstains.
RULES = {
    "symbols_in_words": lambda m: _bad(_per(m["n_symbols"], m["n_words"]) > 0.15),
    "symbols_in_characters": lambda m: _bad(_per(m["n_symbols"], m["word_chars"]) > 0.03),
    "repeated_windows": lambda m: _bad(_per(m["n_repeat_words"], m["n_words"]) > 0.1),
    "few_distinct_words": lambda m: _bad((m["n_words"] >= 20) & (_per(m["n_distinct"], m["n_words"]) < 0.3)),
    "repeated_lines": lambda m: _bad((m["n_lines"] >= 3) & (_per(m["n_dup_lines"], m["n_lines"]) > 0.3)),
    "capitals": lambda m: _bad(_per(m["n_upper"], m["word_chars"]) > 0.3),
    "shouts": lambda m: _bad(_per(m["n_shouts"], m["n_words"]) > 0.15),
    "prose": lambda m: F.when((_per(m["n_symbols"], m["n_words"]) < 0.02) & (_per(m["n_upper"], m["word_chars"]) < 0.1) & (_per(m["n_repeat_words"], m["n_words"]) < 0.02), 1).otherwise(0),
}


def votes(m: Column) -> Column:
    return F.array(*[rule(m).cast("int") for rule in RULES.values()])


class Votes:
    """The share of good documents, and how often each rule's votes are right."""

    def __init__(self, prior: float, right: list[float]):
        self.prior, self.right = prior, right

    def weights(self) -> tuple[float, list[float]]:
        """Log odds before any vote, and what a good vote of each rule adds (a bad one takes)."""
        return math.log(self.prior / (1 - self.prior)), [math.log(a / (1 - a)) for a in self.right]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        start, added = self.weights()
        return 1 / (1 + math.exp(-(start + sum(v * a for v, a in zip(pattern, added)))))

    def column(self, own: Column) -> Column:
        start, added = self.weights()
        odds = F.lit(start)
        for i, a in enumerate(added):
            odds += own[i] * F.lit(a)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: dict[tuple[int, ...], int], rules: int, steps: int = 50) -> Votes:
    """Expectation-maximisation over counted vote patterns.

    A rule's accuracy is how often it agrees with the latent class where it votes. The
    accuracies start at 0.9 and stay in [0.6, 0.995], which fixes the meaning of the two
    classes; the share of good documents stays at 0.5 or more, so silence isn't held against a text; pseudo-counts keep them defined for rules that never vote and for an empty
    table.
    """
    model = Votes(0.8, [0.9] * rules)
    for _ in range(steps):
        weighed = [(p, n, model.posterior(p)) for p, n in sorted(patterns.items())]
        prior = (8 + sum(n * q for _, n, q in weighed)) / (10 + sum(n for _, n, _ in weighed))
        right = [(9 + sum(n * (q if p[i] > 0 else 1 - q) for p, n, q in weighed if p[i])) / (10 + sum(n for p, n, _ in weighed if p[i])) for i in range(rules)]
        model = Votes(min(0.95, max(0.5, prior)), [min(0.995, max(0.6, a)) for a in right])
    return model


def fit(measured: DataFrame, column: str) -> Votes:
    """The model for documents whose measurements are in ``column``; base failures take no part."""
    found = measured.filter(~base_failed(F.col(column))).groupBy(votes(F.col(column)).alias("v")).count().collect()
    return estimate({tuple(r["v"]): r["count"] for r in found}, len(RULES))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements, base_failed, posterior, kept.

    A null or empty text has no words and fails the base rules; repeated rows get equal
    verdicts; an empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.keep(docs.select("doc_id", measure(F.col("text")).alias("m")), "measured")
    posterior = fit(measured, "m").column(votes(F.col("m")))
    failed = base_failed(F.col("m"))
    return measured.select("doc_id", "m.*", failed.alias("base_failed"), posterior.alias("posterior"), (~failed & (posterior >= THRESHOLD)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns unchanged.

    Null and empty texts fail the base rules and go, repeated rows share a verdict, an empty table
    stays empty. Texts are measured once: rows are stored with their measurements.
    """
    column = fresh("_m", docs)
    measured = Scratch(docs.sparkSession, "quality").keep(docs.withColumn(column, measure(F.col("text"))), "measured")
    model, m = fit(measured, column), F.col(column)
    return measured.filter(~base_failed(m) & (model.column(votes(m)) >= THRESHOLD)).drop(column)
