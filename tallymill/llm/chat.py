"""Chat formatting with a checked grammar round trip, in DataFrame functions alone.

The grammar of a formatted conversation is ``( "<s>[INST]" role "[/INST]" text "</s>" )*``.
A deterministic parser reads it back: turns end at the first ``</s>``, a role ends at the
first ``[/INST]``, and one backslash is taken from every escaped control string. A
conversation is first written with its texts as they are; if the parser does not recover
exactly the source turns, or if it holds any control string beside those of its turns (a tokenizer
would take it for a marker), its texts are escaped (a backslash after the
bracket of each control string, one more where there already are some) and parsed
again. Escaping is injective and leaves no control string in a text, so the second
form always parses back; the parse of whichever form is used is what callers get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

#: The control strings of the template.
OPEN, CLOSE, END = "<s>[INST]", "[/INST]", "</s>"
#: A control string after its bracket, with any number of backslashes between.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_MARKER = r"<s>|\[INST\]|\[/INST\]|</s>"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(turns: Column, escaped: bool) -> Column:
    """One string for an array of (role, text)."""
    put = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), put(t["role"]), F.lit(CLOSE), put(t["text"]), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; text outside the grammar yields a turn that equals no source."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.locate(CLOSE, p)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))
        text = F.substring(p, at + len(CLOSE), F.length(p))
        good = F.startswith(p, F.lit(OPEN)) & (at > 0)
        return F.struct(F.when(good, unescape(role)).alias("role"), F.when(good, unescape(text)).alias("text"))

    return F.transform(pieces, turn).cast(TURNS)


def gather(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order of turn (ties: role, then text); nulls in role and text are empty strings.

    A row without a conv_id is a conversation of its own, so such rows are never collected.
    """
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), put("role").alias("role"), put("text").alias("text")).alias("t"))
    listed = lambda own: F.transform(own, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS).alias("turns")
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(listed(F.sort_array(F.collect_list("t"))))
    return grouped.unionByName(rows.filter("conv_id is null").select("conv_id", listed(F.array("t"))))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (source), formatted, parsed (turns read back), escaped (whether escaping was needed).

    Rows are grouped by conv_id (a row without one is a conversation of its own); repeated rows are
    repeated turns; turns without a number come first. A conversation is one row, so it must fit in a task. An empty table gives no rows;
    further columns are ignored.
    """
    own = gather(conversations)
    plain = own.withColumn("formatted", render(F.col("turns"), False)).withColumn("parsed", parse(F.col("formatted")))

    def settle(first: Column) -> Column:
        def second(text: Column) -> Column:
            return F.struct(text.alias("formatted"), parse(text).alias("parsed"), F.lit(True).alias("escaped"))

        same = first["parsed"].eqNullSafe(F.col("turns")) & (F.regexp_count(first["formatted"], F.lit(_MARKER)) == 4 * F.size("turns"))
        return F.when(same, F.struct(first["formatted"].alias("formatted"), first["parsed"].alias("parsed"), F.lit(False).alias("escaped"))).otherwise(let(render(F.col("turns"), True), second))

    return plain.select("conv_id", "turns", settle(F.struct("formatted", "parsed")).alias("f")).select("conv_id", "turns", "f.*")


def digests(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """What the contract asks of each conversation, read back from its formatted string."""

    def of(turns: Column) -> Column:
        loss = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == learn), lambda t: t["text"]), "")
        whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        return let(loss, lambda text: F.struct(
            F.size(turns).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
            F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"),
        ))

    out = formatted.select("conv_id", let(F.col("parsed"), of).alias("d"), F.length("formatted").cast("long").alias("formatted_chars"), "escaped")
    return out.select("conv_id", "d.*", "formatted_chars", "escaped")
