"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits, the cell coordinates become one index
on the Hilbert curve (Skilling's transposition, vectorised in numpy), rows are
range-partitioned and sorted by (index, id), and the sorted run is cut into shards
whose row counts differ by one at most. Neighbours on the curve are neighbours in
every dimension, so a shard covers a small box and the per-shard minima and maxima
(:func:`zone_map`) let a reader skip most shards for a predicate on any dimension.

Only narrow columns are sorted; texts never move. The global rank needs no
single-task window: partition sizes of the sorted run (one small row per partition)
give each partition its first rank, and the position inside the partition comes from
``monotonically_increasing_id``. The sort key ends with the row id, so one hot cell
spreads over as many partitions as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells; ``coords`` is (rows, dimensions), each below 2**bits."""
    x = np.array(coords, dtype=np.int64).T.copy()
    dims = x.shape[0]
    if dims * bits > 62:
        raise ValueError("dims * bits must not exceed 62")
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def hilbert_column(dims: Sequence[Column], bits: int) -> Column:
    """The curve index of already quantised dimensions, as a vectorised UDF."""

    @F.pandas_udf("long")
    def curve(cell: pd.DataFrame) -> pd.Series:
        if cell.empty:
            return pd.Series([], dtype="int64")
        return pd.Series(hilbert_index(cell.to_numpy(dtype=np.int64), bits))

    return curve(F.struct(*[d.cast("long").alias(f"d{i}") for i, d in enumerate(dims)]))


def quantise_number(df: DataFrame, column: str, bits: int) -> Column:
    """Equal-frequency bucket of a number, 0 for null; cut points come from all rows of ``df``."""
    n = 1 << bits
    steps = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(column, steps, 10_000)).first()[0] or []
    cuts = sorted(set(found))
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c) for c in cuts])
    return F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col(column))), F.lit(0))


def quantise_text(column: Column, bits: int) -> Column:
    """Stable bucket of a category; equality predicates on it still prune."""
    return F.pmod(F.xxhash64(F.coalesce(column, F.lit(""))), F.lit(1 << bits))


def rank_along(df: DataFrame, keys: Sequence[str], scratch: Scratch) -> DataFrame:
    """Add ``rank`` (0-based, gapless) in the order of ``keys``, without a one-task sort or window."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = scratch.keep(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "sorted",
    )
    pid = F.shiftright("_at", 33)
    sizes = sorted((r["pid"], r["n"]) for r in run.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect())
    first, total = {}, 0
    for p, n in sizes:  # one entry for each partition
        first[p] = total
        total += n
    lookup = F.create_map(*[F.lit(v) for p, at in first.items() for v in (p, at)]) if first else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    ranked = run.withColumn("rank", (lookup[pid] + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")
    return ranked.withColumn("total", F.lit(total).cast("long"))


def cut_runs(ranked: DataFrame, shards: int) -> DataFrame:
    """Cut a ranked run into ``shards`` runs whose sizes differ by one at most: ``shard`` and ``slot``."""
    base, extra = F.expr(f"total div {shards}"), F.col("total") % shards
    # the first `extra` shards hold base + 1 rows
    head = extra * (base + 1)
    in_head = F.col("rank") < head
    shard = F.when(in_head, F.expr(f"rank div (total div {shards} + 1)")).otherwise(
        extra + F.expr(f"(rank - (total % {shards}) * (total div {shards} + 1)) div greatest(total div {shards}, 1)")
    )
    start = F.col("shard") * base + F.least(F.col("shard").cast("long"), extra)
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - start).cast("long")).drop("rank", "total")


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 5) -> DataFrame:
    """Shard documents by a Hilbert curve over language, source and size.

    Returns one row per input row: doc_id, lang, source, size (UTF-8 bytes of the text
    plus 16; a null text has none), text_crc32, curve, shard, slot. Nulls in lang or
    source count as the empty string, a null doc_id sorts first, repeated rows keep
    one slot each, ties in the curve index go by doc_id, crc and size. An empty table
    gives no rows; other columns of the input are ignored.
    """
    return _placed(docs, shards, bits, Scratch(docs.sparkSession, "hilbert"))


def _placed(docs: DataFrame, shards: int, bits: int, scratch: Scratch, row: str | None = None) -> DataFrame:
    """The rows of :func:`shard_documents`, with the column ``row`` of ``docs`` as ``row`` if one is named."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = scratch.keep(
        docs.select(
            "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
            (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *([F.col(row).alias("row")] if row else []),
        ),
        "metadata",
    )
    cells = [quantise_text(F.col("lang"), bits), quantise_text(F.col("source"), bits), quantise_number(narrow, "size", bits)]
    placed = narrow.withColumn("curve", hilbert_column(cells, bits))
    return cut_runs(rank_along(placed, ["curve", "doc_id", "text_crc32", "size"], scratch), shards)


def zone_map(sharded: DataFrame, columns: Sequence[str] = ("doc_id", "lang", "source", "size")) -> DataFrame:
    """Minimum and maximum of each column in each shard, for pruning."""
    bounds = [f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *bounds)


def prune(zones: DataFrame, **wanted) -> DataFrame:
    """Shards that may hold a row with the wanted values: ``prune(zones, lang="en", size=(0, 500))``."""
    keep = F.lit(True)
    for column, value in wanted.items():
        low, high = value if isinstance(value, tuple) else (value, value)
        keep &= (F.col(f"{column}_max") >= low) & (F.col(f"{column}_min") <= high)
    return zones.filter(keep).select("shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, bits: int = 5) -> None:
    """Write every row of ``docs`` once, with its columns, under ``path/shard=N``, each shard in slot order.

    Rows are told apart by a key given when they are stored, so null and repeated ids stay. The
    folder's column is ``shard``, or that with underscores after it where ``docs`` owns such a column.
    """
    scratch = Scratch(docs.sparkSession, "hilbert")
    row, shard, slot = fresh("row", docs), fresh("shard", docs), fresh("slot", docs)
    stored = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    places = _placed(stored, shards, bits, scratch, row).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored.join(scratch.keep(places, "places"), row).repartitionByRange(n, shard, slot).sortWithinPartitions(shard, slot)
    ordered.select(*docs.columns, shard).write.partitionBy(shard).parquet(path)
    scratch.drop(stored)
