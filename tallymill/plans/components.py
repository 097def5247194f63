"""Parts of a log that no operation connects, and so can be folded apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def key(asset: str, account: str) -> Column:
    """A hashed (asset, account); a collision only joins two parts, which changes no result."""
    return F.xxhash64(F.col(asset), F.col(account))


def conflict_keys(ops: DataFrame) -> DataFrame:
    """``ops`` with ``k1`` and ``k2``, the keys an operation reads or writes (equal if it has one); sinks are neither."""
    one, two = key("asset_id", "a"), key("asset_id", "b")
    owner, third = two, key("asset_id", "c")
    pair = F.col("op").isin("TRANSFER", "CAPTURE", "LEG")
    delegated = F.col("op") == "DELEGATED_TRANSFER"
    ops = ops.withColumn("k1", F.when(delegated, owner).otherwise(one))
    return ops.withColumn("k2", F.when(F.col("sink"), F.col("k1")).when(delegated, third).when(pair, two).otherwise(one))


def _edges(keyed: DataFrame) -> DataFrame:
    own = keyed.filter("k1 != k2").select(F.col("k1").alias("u"), F.col("k2").alias("v"))
    chains = keyed.filter("op = 'LEG'")
    first = chains.groupBy("log_position", "chain_id").agg(F.min("k1").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    linked = chains.join(first, ["log_position", "chain_id"]).filter("k1 != v").select(F.col("k1").alias("u"), "v")
    return own.union(linked).distinct()


def label(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): the smallest vertex that edges lead to; minima spread and labels jump until nothing moves."""
    both = scratch.keep(edges.union(edges.select("v", "u")).distinct())
    labels = scratch.keep(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        lower = scratch.keep(labels.join(near, "v").select("v", F.least("label", "near").alias("label")))
        jump = lower.join(lower.select(F.col("v").alias("label"), F.col("label").alias("next")), "label", "left")
        after = scratch.keep(jump.select("v", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = after.join(labels.select("v", F.col("label").alias("old")), "v").filter("label != old").limit(1).count()
        scratch.drop(labels, lower)
        labels = after
        if not moved:
            return labels


def with_component(ops: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """``ops`` with ``component``: rows that could affect each other have the same one.

    ``by="asset"`` joins assets that a chain spans; ``by="component"`` joins only keys
    that some operation touches together. One account that everything touches gives one
    component either way: the order of its operations is the result.
    """
    if by == "asset":
        keyed = ops.withColumn("k1", F.col("asset_id")).withColumn("k2", F.col("asset_id"))
    else:
        keyed = conflict_keys(ops)
    edges = scratch.keep(_edges(keyed))
    if not edges.limit(1).count():
        return keyed.withColumn("component", F.col("k1")).drop("k1", "k2")
    labels = label(edges, scratch)
    return keyed.join(labels.select(F.col("v").alias("k1"), "label"), "k1", "left").withColumn("component", F.coalesce("label", "k1")).drop("k1", "k2", "label")
