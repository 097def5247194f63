"""What can be decided about a log without folding it: validity, duplicates, chains. Catalyst only.

A client's window of remembered sequences has ``window`` slots; a command with sequence
``s`` uses slot ``s & (window - 1)``. Whatever happens to a command, its slot holds its
sequence afterwards, so what a slot holds before a row is the sequence of the slot's
previous row. A row is a duplicate if that is its own sequence (-1 never is), and a
fresh row evicts what else was there. Rows of a hot client spread over their slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import default_asset, slot_index
from ..schemas import COMMAND_TYPES


def mark_duplicates(log: DataFrame, window: int, ring: DataFrame | None = None, stored: tuple[str, ...] = ()) -> DataFrame:
    """Add ``duplicate``, ``evicted`` and ``origin`` (the row whose result a duplicate repeats).

    ``ring`` holds the remembered sequences of an earlier run, with their ``stored`` results.
    """
    own = log.withColumn("slot", slot_index("client_seq", window)).withColumn("_old", F.lit(False))
    if ring is not None:
        kept = [F.col(c).alias(f"_ring_{c}") for c in stored]
        own = own.unionByName(ring.select("client_id", "client_seq", "slot", *kept, F.lit(-1).cast("long").alias("log_position"), F.lit(True).alias("_old")), allowMissingColumns=True)
    else:
        own = own.withColumns({f"_ring_{c}": F.lit(None).cast("string") for c in stored})
    w = Window.partitionBy("client_id", "slot").orderBy("log_position")
    prior = F.lag("client_seq").over(w)
    duplicate = ~F.col("_old") & F.coalesce((F.col("client_seq") != -1) & (prior == F.col("client_seq")), F.lit(False))
    marked = own.withColumn("duplicate", duplicate).withColumn("_prior", prior)
    first = F.struct("log_position", *[F.col(f"_ring_{c}").alias(c) for c in stored])
    marked = marked.withColumn("origin", F.last(F.when(~F.col("duplicate"), first), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    evicted = ~F.col("duplicate") & F.coalesce((F.col("_prior") != -1) & (F.col("_prior") != F.col("client_seq")), F.lit(False))
    return marked.withColumn("evicted", evicted).filter(~F.col("_old")).drop("_old", "_prior", *[f"_ring_{c}" for c in stored])


def command_fault() -> Column:
    """Status that a command gets whatever the state is, or null."""
    known = F.col("command_type").isin(*COMMAND_TYPES)
    return F.when(F.coalesce(F.col("amount") < 0, F.lit(True)) | ~F.coalesce(known, F.lit(False)), "INVALID_AMOUNT")


def validate(commands: DataFrame) -> DataFrame:
    """Default the asset and add ``fault``."""
    return commands.withColumn("asset_id", default_asset()).withColumn("fault", command_fault())


def final_slots(log: DataFrame, window: int, ring: DataFrame | None = None) -> DataFrame:
    """The occupied slots after a log: per client and slot the last sequence, ascending by (client, sequence)."""
    own = log.select("client_id", "client_seq", "log_position", slot_index("client_seq", window).alias("slot"))
    if ring is not None:
        own = own.unionByName(ring.select("client_id", "client_seq", F.lit(-1).cast("long").alias("log_position"), "slot"))
    last = own.groupBy("client_id", "slot").agg(F.max_by("client_seq", "log_position").alias("client_seq"))
    return last.filter("client_seq != -1")


def batch_fault(max_batch_size: int) -> Column:
    """INVALID_CHAIN for a batch that is too long or whose last leg claims a next one, or null."""
    return F.when(F.size("legs") > max_batch_size, "INVALID_CHAIN").when(F.size("legs") == 0, None).when(F.coalesce(F.element_at("legs", -1)["linked"], F.lit(False)), "INVALID_CHAIN")


def explode_legs(batches: DataFrame, *keep: str) -> DataFrame:
    """One row per leg, with ``chain_id`` (0-based within the batch) and ``chain_last``; no shuffle."""
    last = lambda leg: ~F.coalesce(leg["linked"], F.lit(False))
    # where chains end, ascending; each chain's number is repeated for its legs, which takes one step a leg
    ends = F.filter(F.transform("legs", lambda leg, i: F.when(last(leg), i)), lambda i: i.isNotNull())
    own = batches.select(*keep, "legs", ends.alias("_ends"))
    lengths = F.transform("_ends", lambda end, i: end - F.coalesce(F.get("_ends", i - 1), F.lit(-1)))
    open_ = F.size("legs") - 1 - F.coalesce(F.element_at(F.when(F.size("_ends") > 0, F.col("_ends")), -1), F.lit(-1))
    chains = F.concat(F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n))), F.array_repeat(F.size("_ends"), open_))
    leg, n = F.col("leg.legs"), F.col("leg.n")
    out = own.select(*keep, F.posexplode(F.arrays_zip("legs", chains.alias("n"))).alias("leg_idx", "leg"))
    return out.select(
        *keep, "leg_idx", leg["from_id"].alias("from_id"), leg["to_id"].alias("to_id"), leg["amount"].alias("amount"), F.coalesce(leg["asset_id"], F.lit(0).cast("long")).alias("asset_id"),
        n.alias("chain_id"), last(leg).alias("chain_last"),
    )
