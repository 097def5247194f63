"""Near-duplicate groups by a chosen-path set similarity join.

Documents with equal shingle sets form one class, represented by its smallest id. The
representatives go into ``TREES`` independent trees. A node of a tree is a hash of the
path to it; at each node one or two of the ``COORDINATES`` minwise tokens are chosen by the
node's own hash, and a member goes to the children named by its values there, so similar
documents tend to follow the same paths. Nodes of one member end. Each document is first compared
with the smallest member of one node, the one it shares most root children with; the
links found so far give labels, and a node whose members have one label is finished,
because only links between different groups still matter. Nodes of at most
``SMALL`` members are compared exhaustively, by minwise sketches, inside one task. Larger
nodes branch on, after each member was compared with the node's smallest member, which
joins labels. What is still large after ``LEVELS`` levels is
compared in blocks of bounded size, block against block, so no candidate is given up.

Sketches only choose candidates. Every link is confirmed on the full shingle sets. Groups
are connected components of the links, found by propagating minima with pointer jumping.
Rows of one hot node or group spread over tasks: counts and minima are pre-aggregated, and
joins on hot keys have two freshly dealt sides, which Spark splits when they are skewed.

A pair with similarity 0.75 shares a root child with probability 0.75, and a large node's child with
probability 0.8125 (two tokens at every third node, one elsewhere). So a tree misses it with
probability 0.39 at most, if its root child is large, and all ``TREES`` miss it with probability
1e-4 at most, one in a million if the root children are small. Its sketch estimate falls below ``LIKELY`` with
probability under 1e-4. Deeper branching with two children everywhere was measured and makes more
rows on large groups than the block comparison does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches
from .shingles import Shingler, mix

COORDINATES, TREES, LEVELS, SMALL, BLOCK = 256, 10, 2, 32, 512
PERCENT, LIKELY = 75, 0.645

SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, roots array<long>, low binary"
FEW_IDS = 250_000


def sign(docs: DataFrame) -> DataFrame:
    """Set size, set hash, children of the roots, and minwise sketch (8 bits a coordinate) of each text."""
    small_batches(docs.sparkSession)
    salts = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
    factor, shift = salts[:COORDINATES] | np.uint64(1), salts[COORDINATES:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sizes, first, second, sigs, lows = [], [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingler.hashes(text)
                low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
                for i in range(0, len(own), 512):
                    np.minimum(low, (own[i : i + 512, None] * factor + shift).min(0), out=low)
                sig = (low >> np.uint64(32)).astype(np.uint32)
                sizes.append(len(own))
                first.append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                second.append(int(mix(own).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append(mix(low[:TREES] ^ salts[:TREES]).astype(np.int64).tolist())
                lows.append(sig.astype(np.uint8).tobytes())
            arrays = [batch["doc_id"], *(pa.array(v, pa.int64()) for v in (sizes, first, second)), pa.array(sigs, pa.list_(pa.int64())), pa.array(lows, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "h1", "h2", "roots", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def _agreeing(low: np.ndarray, at: np.ndarray, step: int, chunk: int = 4096) -> np.ndarray:
    """In how many coordinates the sketches at ``at`` and ``at + step`` agree; a few at a time, to stay small."""
    parts = [np.count_nonzero(low[at[i : i + chunk]] == low[at[i : i + chunk] + step], axis=1) for i in range(0, len(at), chunk)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _child(node, coordinate) -> object:
    return F.xxhash64(node, coordinate, F.substring("low", coordinate + 1, F.lit(1)))


def _similar_in(groups: DataFrame) -> DataFrame:
    """Likely pairs (a < b) of different labels inside rows of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["members"]
            flat, offsets = lists.flatten(), np.asarray(lists.offsets)
            offsets = offsets - offsets[0]
            found = [np.zeros((2, 0), np.int64)]
            if len(flat) > 1:
                cid, label = (np.asarray(flat.field(k)) for k in ("cid", "label"))
                low, node = _sketches(flat.field("low")), np.repeat(np.arange(len(lists)), np.diff(offsets))
                for step in range(1, int(np.diff(offsets).max(initial=1))):
                    at = np.flatnonzero((node[:-step] == node[step:]) & (label[:-step] != label[step:]) & (cid[:-step] != cid[step:]))
                    if len(at):
                        at = at[_agreeing(low, at, step) >= LIKELY * COORDINATES]
                        found.append(np.stack([np.minimum(cid[at], cid[at + step]), np.maximum(cid[at], cid[at + step])]))
            pairs = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, name, known = Shingler(), None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(*(batch[c].to_pylist() for c in ("b", "ta", "tb"))):
                if b != name:
                    name, known = b, shingler.hashes(y)
                own = shingler.hashes(x)
                both = len(np.intersect1d(own, known, assume_unique=True))
                keep.append(len(own) > 0 and 100 * both >= percent * (len(own) + len(known) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    return first.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _small(written: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has ``FEW_IDS`` rows at most; longer ones are shuffled."""
    return F.broadcast(written) if written.limit(FEW_IDS + 1).count() <= FEW_IDS else written


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): the smallest vertex reachable from each vertex that has an edge.

    Each round takes the least label among a vertex, its neighbours (the edges hold (v, v)
    too) and then that label's own label, until no label falls.
    """
    ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("e"))
    both = scratch.keep(ends.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).distinct(), "edges")
    lower = scratch.keep(both.groupBy("v").agg(F.min("u").alias("label")), "labels")
    while True:
        own = _small(lower)
        jumped = lower.join(own.select(F.col("v").alias("label"), F.col("label").alias("next")), "label").select("v", F.col("next").alias("label"))
        labels = F.broadcast(jumped) if own is not lower else jumped
        step = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("label"), F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("was"))
        after = scratch.keep(step, "labels")
        moved = after.filter("label != was").limit(1).count()
        scratch.drop(lower)
        lower = after
        if not moved:
            scratch.drop(both)
            return lower.select("v", "label")


def texts_of(ids: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, text) of the given documents; a list of at most ``FEW_IDS`` is broadcast, a longer one is joined."""
    own = docs.select(F.col("doc_id").cast("long").alias("cid"), F.col("text").cast("string").alias("text"))
    ids = scratch.keep(ids.distinct(), "ids")
    return scratch.keep(own.join(_small(ids), "cid", "left_semi"), "texts")


def settle(pairs: DataFrame, docs: DataFrame, low: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Pairs that are likely by their sketches and true on the full sets."""
    near = scratch.keep(_likely(scratch.keep(pairs, f"{name}-pairs"), low), f"{name}-likely")
    texts = texts_of(near.select(F.col("a").alias("cid")).union(near.select("b")), docs, scratch)
    true = scratch.keep(confirm(near, texts).distinct(), name)
    scratch.drop(near, texts)
    return true


def links(reps: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Confirmed links between class representatives, enough of them to connect every group."""
    low = reps.select("cid", "low")
    rows = reps.select("cid", F.explode("roots").alias("node"))
    sizes = scratch.keep(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).filter("size > 1"), "sizes")
    members = scratch.keep(rows.join(sizes, "node").select("node", "cid", "size", "pivot"), "members")

    # each document first meets the one pivot it shares most root children with
    met = members.filter("cid != pivot").groupBy("cid", "pivot").agg(F.count("*").alias("n"))
    first = met.groupBy("cid").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("a")).select("a", F.col("cid").alias("b"))
    confirmed = [settle(first, docs, low, scratch, "first")]
    known = _small(components(confirmed[0], scratch))
    labelled = members.join(known.select(F.col("v").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    rows = _open(scratch.keep(labelled.select("node", "cid", "label"), "labelled"), scratch)

    waiting = []
    for level in range(1, LEVELS + 1):
        sizes = scratch.keep(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).filter("size > 1"), "sizes")
        members = scratch.keep(rows.join(sizes, "node"), "members")
        gathered = F.collect_list(F.struct("cid", "label", "low")).alias("members")
        few = members.filter(F.col("size") <= SMALL).join(low, "cid").groupBy("node").agg(gathered)
        waiting.append(scratch.keep(_similar_in(few), "pairs"))
        large = members.filter(F.col("size") > SMALL)
        if not large.limit(1).count():
            break
        if level == LEVELS:
            confirmed.append(_in_blocks(_relabelled(large, confirmed, scratch), low, docs, scratch))
            break
        stars = large.filter("cid != pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
        confirmed.append(settle(stars, docs, low, scratch, "stars"))
        linked = confirmed[-1].select(F.col("a").alias("pivot"), F.col("b").alias("cid"), F.lit(True).alias("linked"))
        joined = large.join(linked, ["pivot", "cid"], "left")
        own = F.col("linked") | (F.col("cid") == F.col("pivot"))
        going = _open(scratch.keep(joined.select("node", "cid", F.when(own, F.col("pivot")).otherwise(F.col("label")).alias("label")), "labelled"), scratch).join(low, "cid")
        one, two = (F.pmod(F.xxhash64("node", F.lit(level), F.lit(k)), F.lit(COORDINATES)).cast("int") for k in (1, 2))
        branch = F.when(F.pmod(F.xxhash64("node", F.lit(level), F.lit(3)), F.lit(3)) == 0, F.array(one, two)).otherwise(F.array(one))
        rows = going.select("cid", "label", "node", "low", F.explode(branch).alias("at")).select("cid", "label", _child(F.col("node"), F.col("at")).alias("node"))
    pairs = waiting[0]
    for more in waiting[1:]:
        pairs = pairs.union(more)
    confirmed.append(settle(pairs.distinct(), docs, low, scratch, "links"))
    return _all(confirmed)


def _all(confirmed: list[DataFrame]) -> DataFrame:
    out = confirmed[0]
    for more in confirmed[1:]:
        out = out.union(more)
    return out


def _relabelled(members: DataFrame, confirmed: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Members of nodes with the labels that all confirmed links give them, without the nodes that are finished."""
    known = _small(components(_all(confirmed), scratch))
    own = members.drop("label", "size").join(known.select(F.col("v").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    rest = scratch.keep(own, "labelled")
    sizes = rest.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("node", "size")
    return scratch.keep(rest.join(_small(scratch.keep(sizes, "open")), "node"), "members")


def _open(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """The members of nodes whose members don't all belong together yet."""
    mixed = labelled.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("node")
    return labelled.join(_small(scratch.keep(mixed, "open")), "node", "left_semi")


def _likely(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """Pairs whose sketches agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                same = (_sketches(batch["la"]) == _sketches(batch["lb"])).sum(1) >= LIKELY * COORDINATES
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(same))

    both = pairs.join(low.select(F.col("cid").alias("b"), F.col("low").alias("lb")), "b").join(low.select(F.col("cid").alias("a"), F.col("low").alias("la")), "a")
    return both.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def _in_blocks(large: DataFrame, low: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between members of different labels, each pair of blocks of a node compared exhaustively in one task.

    Blocks carry the shingle sets, so likely pairs are confirmed where they are found, and
    a task emits only links that join what it has not joined yet: no more than it has members.
    """
    texts = texts_of(large.select("cid"), docs, scratch)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            own = [shingler.hashes(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["cid"], pa.array(own, pa.binary())], names=["cid", "set"])

    full = scratch.keep(texts.mapInArrow(sets, "cid long, set binary").join(low, "cid"), "sets")
    scratch.drop(texts)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid", "node"), F.col("blocks")).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lower, upper = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("node", lower, upper, (F.col("own") > F.col("other")).alias("second"), "cid", "label").join(full, "cid")
    ordered = rows.repartition(parts, "node", "i", "j").sortWithinPartitions("node", "i", "j", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for *at, second, cid, label, low, own in zip(*(batch[c].to_pylist() for c in ("node", "i", "j", "second", "cid", "label", "low", "set"))):
                if at != key:
                    out += _join_block(held)
                    key, held = at, []
                held.append((second, cid, label, low, own, at[1] == at[2]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = _join_block(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return scratch.keep(ordered.mapInArrow(run, "a long, b long").distinct(), "block-links")


def _join_block(held: list[tuple]) -> list[tuple[int, int]]:
    """Confirmed links of one pair of blocks, likeliest pairs first, until nothing new can be joined."""
    if len(held) < 2:
        return []
    second, cids, labels = (np.array([h[k] for h in held]) for k in (0, 1, 2))
    low = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8).reshape(-1, COORDINATES)
    found = [np.zeros((3, 0), np.int64)]
    for step in range(1, len(held)):
        far = labels[:-step] != labels[step:]
        if not held[0][5]:
            far &= second[:-step] != second[step:]
        at = np.flatnonzero(far)
        if len(at):
            same = _agreeing(low, at, step)
            likely = same >= LIKELY * COORDINATES
            found.append(np.stack([at[likely], at[likely] + step, same[likely]]))
    first, other, same = np.concatenate(found, axis=1)
    order, parent, out = np.argsort(-same, kind="stable"), {}, []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    known: dict[int, np.ndarray] = {}
    for i, j in zip(first[order].tolist(), other[order].tolist()):
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x == y:
            continue
        for k in (i, j):
            if k not in known:
                known[k] = np.frombuffer(held[k][4], dtype=np.uint64)
        both = len(np.intersect1d(known[i], known[j], assume_unique=True))
        if 100 * both >= PERCENT * (len(known[i]) + len(known[j]) - both):
            parent[max(x, y)] = min(x, y)
            out.append((int(min(cids[i], cids[j])), int(max(cids[i], cids[j]))))
    return out


def group(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets are distinct ``WORDS``-word shingles of the whole text, A-Z lower-cased; a shorter
    text is one shingle; null, empty and wordless texts have an empty set and are linked
    with nothing. Rows with one doc_id are one document; if their texts differ, it has the longest of them
    (the greatest of equally long ones). A null doc_id is a component of
    its own. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = texts.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("doc_id", "n")
    several = scratch.keep(several, "several-texts")
    if not several.limit(1).count():
        return _group(own, scratch)
    longest = own.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text"))
    single = scratch.keep(own.join(several, "doc_id", "left_anti").unionByName(longest), "documents")
    again = _group(single, scratch).join(several, "doc_id", "left")
    return again.select("doc_id", "n_shingles", "component_id", "kept", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1)))).alias("copy")).drop("copy")


def _group(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """:func:`group` of documents whose ids have one text each."""
    signed = scratch.keep(sign(docs), "signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("cid")), "classes")
    reps = scratch.keep(full.join(classes.select(F.col("cid").alias("doc_id"), F.lit(True).alias("own")), "doc_id", "left_semi").select(F.col("doc_id").alias("cid"), "roots", "low"), "representatives")
    found = scratch.keep(components(links(reps, docs, scratch), scratch), "components")
    named = scratch.keep(classes.join(found.select(F.col("v").alias("cid"), "label"), "cid", "left").select("h1", "h2", "n_shingles", F.coalesce("label", "cid").alias("found")), "named")
    out = signed.join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that represent their group (repeated rows of one once, with its text), with their columns unchanged.

    Rows without a doc_id are documents of their own and all stay; an empty table stays empty.
    """
    keep = group(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    row, whole = fresh("_row", docs), F.struct(*docs.columns)
    named = docs.filter("doc_id is not null").join(keep, "doc_id", "left_semi")
    once = named.groupBy("doc_id").agg(F.max_by(whole, F.struct(F.length("text"), F.col("text"))).alias(row)).select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return once.union(docs.filter("doc_id is null"))
