"""Personal data: expressions propose spans, checksums confirm them, context adjusts the score.

DataFrame functions only. For each kind a regular expression proposes leftmost,
non-overlapping spans; the text between the matches and the matches themselves give
the code-point offsets. Validators then drop what cannot be genuine: address parts over
255, card numbers failing Luhn, account numbers failing mod-97, wrong digit counts. For
the kinds the method adds, words shortly before a span raise or lower its score, and
spans under ``THRESHOLD`` are dropped. The base kinds always keep their confirmed spans.

The expressions are written so that no text makes them backtrack or recurse deeply:
runs are possessive and start at a run's first character (or where the last match
ended), and long repetitions are nested atomic groups. Each is equivalent to the plain
expression named in its comment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

THRESHOLD = 0.6
NEAR = 40
CHUNK = 256


def _many(unit: str) -> str:
    """``(unit)+`` for units without ambiguity, with bounded recursion."""
    return f"(?>(?>(?>(?:{unit}){{1,60}}){{1,60}})+)"


_LOCAL, _LABEL = r"[A-Za-z0-9._%+\-]", r"[A-Za-z0-9\-]"

#: Words that make a proposed span likelier or less likely.
FOR = {"iban": "iban|account|konto|cuenta|compte|bank|transfer", "card_short": "card|credit|visa|amex|karte|tarjeta|carte", "secret": "token|secret|api|key|password|passwd|credential"}
AGAINST = "order|invoice|isbn|serial|version|sample|example|commit|checksum|sha"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    may: str  # a cheap expression that every text with a match satisfies
    valid: object
    prior: float = 1.0  # score before context; the base kinds need none


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(own: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.substring(own, i, F.lit(1)).cast("int") * F.when(F.pmod(F.length(own) - i, F.lit(2)) == 1, 2).otherwise(1)
            return acc + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(own)), F.lit(0), add)

    return let(digits, lambda own: (F.length(own) > 0) & (F.pmod(total(own), F.lit(10)) == 0))


def mod97(account: Column) -> Column:
    """Whether an international account number passes the mod-97 check."""
    turned = let(F.regexp_replace(account, "[^A-Z0-9]", ""), lambda a: F.concat(F.substring(a, F.lit(5), F.length(a)), F.substring(a, 1, 4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.pmod(F.when(code >= 65, acc * 100 + (code - 55)).otherwise(acc * 10 + (code - 48)), F.lit(97))

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _between(low: int, high: int):
    return lambda m: let(F.length(_digits(m)), lambda n: (n >= low) & (n <= high))


def _card(low: int, high: int):
    return lambda m: let(_digits(m), lambda d: F.when((F.length(d) >= low) & (F.length(d) <= high), luhn(d)).otherwise(False))


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CARD = "[0-9]" + _many(r"[ \-]?[0-9]")

#: The base kinds, in the order in which their spans are listed.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++" + _many(rf"\.{_LABEL}++"), "@", lambda m: F.lit(True)),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", lambda m: F.rlike(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", _CARD, r"[0-9](?:[ \-]?[0-9]){15}", _card(16, 19)),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][ ().0-9\-]+[0-9]", r"\+[0-9]", _between(8, 15)),
)

#: Kinds the method adds; they need a checksum or a context word to be reported.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}[ A-Z0-9]", mod97, 0.7),
    Kind("card_short", r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,14}+(?![0-9])", r"[0-9](?:[ \-]?[0-9]){12}", _card(13, 15), 0.4),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}+(?![A-Za-z0-9])", "[A-Fa-f0-9]{32}", lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Fa-f]")), 0.4),
)
KINDS = (*BASE, *ADDED)


def _prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an int array, in two levels so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def over(chunks: Column) -> Column:
        sums = F.transform(chunks, total)
        bases = let(sums, lambda own: F.transform(own, lambda x, c: total(F.slice(own, F.lit(1), c))))
        return let(bases, lambda base: F.flatten(F.transform(chunks, lambda own, c: F.transform(own, lambda x, i: F.get(base, c) + total(F.slice(own, F.lit(1), i + 1))))))

    chunks = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int")), lambda c: F.slice(own, c * CHUNK + 1, F.lit(CHUNK)))
    return let(values, lambda own: let(chunks(own), over))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _scored(kind: Kind, text: Column, start: Column) -> Column:
    if kind in BASE:
        return F.lit(1.0)
    before = F.lower(F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR))))
    return F.lit(kind.prior) + F.when(F.rlike(before, F.lit(FOR[kind.name])), 0.3).otherwise(0.0) - F.when(F.rlike(before, F.lit(AGAINST)), 0.3).otherwise(0.0)


def _may(kind: Kind, text: Column) -> Column:
    return F.contains(text, F.lit("@")) if kind.may == "@" else F.rlike(text, F.lit(kind.may))


def _hits(kind: Kind, text: Column) -> Column:
    """Confirmed spans of one kind in one text, ascending."""

    def spans(pair: Column) -> Column:
        matches, pieces = pair["m"], pair["p"]
        gaps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))
        rows = let(_prefix_sums(gaps), lambda at: F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(at, i).alias("start"))))
        good = F.filter(rows, lambda r: kind.valid(r["m"]))
        full = F.transform(good, lambda r: F.struct(F.lit(kind.name).alias("kind"), r["start"].alias("start"), (r["start"] + F.length(r["m"])).alias("end"), _scored(kind, text, r["start"]).alias("score")))
        return F.filter(full, lambda r: r["score"] >= THRESHOLD)

    none = F.array().cast(SPANS)
    both = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))
    some = let(both, lambda pair: F.when(F.size(pair["m"]) == 0, none).otherwise(spans(pair).cast(SPANS)))
    return F.when(_may(kind, text), some).otherwise(none)


def spans(text: Column, kinds=KINDS) -> Column:
    """All confirmed spans of a text, by kind as listed and then by start; a null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.flatten(F.array(*[_hits(kind, text) for kind in kinds]))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans, scores.

    Null and empty texts have no spans (the digest is that of the empty string),
    repeated rows get equal reports, an empty table gives no rows, and other columns are
    ignored. Offsets are code points, ends exclusive.
    """
    names = [k.name for k in BASE]

    def digest(found: Column) -> Column:
        base = F.filter(found, lambda s: s["kind"].isin(names))
        of = lambda n: F.size(F.filter(found, lambda s: s["kind"] == n))
        counts = [of(n).cast("long").alias(f"n_{n}") for n in names]
        scores = F.array_join(F.transform(found, lambda s: F.format_number(s["score"], 2)), ",")
        return F.struct(*counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(found).alias("spans"), scores.alias("scores"))

    return docs.select("doc_id", let(spans(F.col("text")), digest).alias("r")).select("doc_id", "r.*")


def redact_text(text: Column) -> Column:
    """The text with every confirmed span replaced by its kind in brackets; null stays null.

    Spans are those of :func:`spans` on the original text. Overlapping ones are merged,
    and a merged span is named after its longest part, the first listed kind among equals.
    """
    shape = "struct<done:array<struct<kind:string,start:int,end:int,longest:int>>,last:struct<kind:string,start:int,end:int,longest:int>>"

    def merge(acc: Column, s: Column) -> Column:
        last, size = acc["last"], s["end"] - s["start"]
        fresh = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), size.alias("longest"))
        kind = F.when(size > last["longest"], s["kind"]).otherwise(last["kind"])
        wider = F.struct(kind.alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.greatest(last["longest"], size).alias("longest"))
        overlap = s["start"] < last["end"]
        done = F.when(F.coalesce(overlap, F.lit(True)), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(F.coalesce(overlap, F.lit(False)), wider).otherwise(fresh).alias("last")).cast(shape)

    def rebuild(own: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(own, i - 1)["end"]).otherwise(0)
            return F.concat(F.substring(text, before + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        end = F.get(own, F.size(own) - 1)["end"]
        return F.concat(F.array_join(F.transform(own, part), ""), F.substring(text, end + 1, F.length(text)))

    def apply(found: Column) -> Column:
        order = F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["kind"].alias("kind")))
        none = F.struct(F.array().alias("done"), F.lit(None).alias("last")).cast(shape)
        merged = let(F.aggregate(F.array_sort(order), none, merge), lambda acc: F.concat(acc["done"], F.array(acc["last"])))
        return F.when(F.size(found) == 0, text).otherwise(let(merged, rebuild))

    return F.when(text.isNotNull(), let(spans(text), apply))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans that :func:`report` lists replaced in ``text``, and ``n_chars`` brought up to date; all rows and columns stay."""
    docs = docs.withColumn("text", redact_text(F.col("text").cast("string")))
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs
