"""Prefix trie of conversations as a node table with minimal perfect hash slots.

A node is a distinct sequence of first turns. Its name is a running 128-bit digest over the turns, so each conversation
names its nodes in one pass in which only the digest so far is held:

1. **Enumerate.** Conversations are streamed in turn order; their prefix digests are grouped to nodes with counts, smallest
   member and parent digest (partial counts first, so a first turn that a third of all conversations share is a few rows).
2. **Shards.** Nodes with more than ``hot`` members form the top of the trie: at most ``MAX_TOP``, since ``hot`` grows with the
   number of turns. Below it, each subtree lies whole in a shard, named by its uppermost node, so a hot subtree is spread over shards.
3. **Slots.** A shard gives each of its digests a slot by a minimal perfect hash (levels of bit tables; keys that collide in a level
   go on to the next). A look-up compares the digest stored in the slot, so a foreign digest is never taken for a node.
4. **Accumulate.** Counts are scattered into flat arrays by slot; one array of parent slots then carries leaves and saved
   tokens upwards, from the deepest nodes to the least deep. The sums of the shards' uppermost nodes, added up per parent, enter the
   top shard, where the same is done once more.

The arrays of a shard take about 150 bytes a node: they hold whole subtrees of at most ``hot`` conversations, and their turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, worker_cache

MAX_TOP = 1 << 19
MIN_HOT = 256
SHARD_NODES = 100_000
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
LEVELS = 64


def step_digest(*parts: Column) -> Column:
    """16 bytes for a turn: of the SHA-256 over its parts (null is empty), each after its length."""
    texts = [F.coalesce(p, F.lit("")) for p in parts]
    return F.substring(F.unhex(F.sha2(F.concat_ws("", *[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)), 1, 16)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


# -- minimal perfect hash

def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 128-bit keys (two words) for each level."""
    with np.errstate(over="ignore"):
        x = a ^ (b * U64(0x9E3779B97F4A7C15)) ^ U64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Slots:
    """Minimal perfect hash of distinct 128-bit keys: slots ``0 .. n - 1``, verified when looked up."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.levels: list[np.ndarray] = []
        rest, base = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) == LEVELS:
                raise ValueError("keys repeat")
            size = max(64, 2 * len(rest))
            at = (_mix(a[rest], b[rest], len(self.levels)) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.where(alone, base - 1 + np.cumsum(alone), -1)
            self.levels.append(rank)
            slot = rank[at]
            self.a[slot[slot >= 0]], self.b[slot[slot >= 0]] = a[rest[slot >= 0]], b[rest[slot >= 0]]
            base += int(alone.sum())
            rest = rest[slot < 0]

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys of no slot."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for level, rank in enumerate(self.levels):
            slot = rank[(_mix(a[todo], b[todo], level) % U64(len(rank))).astype(np.int64)]
            out[todo[slot >= 0]] = slot[slot >= 0]
            todo = todo[slot < 0]
        own = out >= 0
        own[own] = (self.a[out[own]] == a[own]) & (self.b[out[own]] == b[own])
        return np.where(own, out, -1)


# -- Spark tasks

def _chain(top):
    """Rows ``conv, step, words`` in order, each conversation after a row without step (its root): one row per prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("prefix_trie")
        hot = frozenset(top.value) if top is not None else frozenset()
        conv = None
        node = parent = anchor = ROOT
        depth = 0
        held: tuple | None = None  # the last row waits until the next tells whether its conversation goes on

        def out(rows: list[tuple]) -> pa.RecordBatch:
            c, n, p, a, d, w, e = zip(*rows, strict=True) if rows else ((),) * 7
            n, p, a = (np.frombuffer(b"".join(x), "<i8").reshape(-1, 2) for x in (n, p, a))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()), *[pa.array(x[:, k]) for x in (n, p, a) for k in (0, 1)], pa.array(d, pa.int32()), pa.array(w, pa.int64()),
                 pa.array(e, pa.int32())], ["conv", "n1", "n2", "p1", "p2", "a1", "a2", "depth", "words", "ends"])

        for batch in batches:
            rows = []
            for c, step, w in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held is not None:
                    rows.append((*held, int(step is None)))
                if step is None:
                    conv, node, parent, anchor, depth = c, ROOT, ROOT, ROOT, 0
                else:
                    parent, node, depth = node, hashlib.blake2b(node + step, digest_size=16).digest(), depth + 1
                    if anchor == ROOT and node not in hot:
                        anchor = node
                held = (conv, node, parent, anchor, depth, w)
            yield out(rows)
        if held is not None:
            yield out([(*held, 1)])
    return run


def _accumulate(table: pa.Table) -> pa.Table:
    """The nodes of one shard with children, leaves and saved tokens of their subtrees."""
    col = {k: table[k].to_numpy() for k in table.column_names}
    a, b = col["n1"].view(U64), col["n2"].view(U64)
    slots = Slots(a, b)
    at = slots.look_up(a, b)
    n = len(at)

    def scatter(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = col[name]
        return out

    depth, conv, n_convs, words = (scatter(k) for k in ("depth", "conv", "n_convs", "words"))
    kids, leaves, saved = (scatter(k) for k in ("kids", "leaves", "saved"))  # from shards below
    parent = np.full(n, -1, np.int64)
    parent[at] = np.where(col["depth"] > 0, slots.look_up(col["p1"].view(U64), col["p2"].view(U64)), -1)
    own = parent >= 0
    kids += np.bincount(parent[own], minlength=n)
    leaves[kids == 0] = 1
    saved += (n_convs - 1) * words
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        up = level[own[level]]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    over = pa.array(conv[np.maximum(parent, 0)], mask=~own)
    return pa.table({"n1": slots.a.view(np.int64), "n2": slots.b.view(np.int64), "p1": _back(at, col["p1"]), "p2": _back(at, col["p2"]), "depth": depth,
                     "conv": conv, "parent_conv": over, "n_convs": n_convs, "n_children": kids, "n_leaves": leaves, "saved": saved})


def _back(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[at] = values
    return out


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``n1, n2, text`` in order of node and block: one SHA-256 per node over its texts, joined by commas."""
    node, state = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        a, b, s = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], ["n1", "n2", "sha"])

    for batch in batches:
        rows = []
        for a, b, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if node == (a, b):
                state.update(b"," + text.encode())
                continue
            if node:
                rows.append((*node, state.hexdigest()))
            node, state = (a, b), hashlib.sha256(text.encode())
        yield out(rows)
    if node:
        yield out([(*node, state.hexdigest())])


def prefix_trie(steps: DataFrame, *, max_top: int = MAX_TOP, min_hot: int = MIN_HOT, shard_nodes: int = SHARD_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of ``steps``: ``conv`` long, ``pos`` long, ``step`` binary, ``words`` long.

    A conversation is a row without step, with the smallest ``pos`` (the root, so that conversations without turns are members of it),
    and one row per turn in the order of ``pos``; positions of a conversation differ. Equal ``step`` bytes are equal turns and have equal
    ``words``. Returns

    * nodes ``n1, n2`` (the digest), ``depth, conv`` (smallest member), ``parent_conv`` (null for the root), ``n_convs, n_children, n_leaves`` (childless
      nodes of the subtree, itself included), ``saved`` (over the subtree, (n_convs - 1) * words of a node's last turn);
    * ends ``n1, n2, conv``: one row per conversation, the node it ends at.

    Rows with a null ``conv`` belong to no conversation and are left out. An empty table gives no nodes, not even a root. Other columns
    are ignored.
    """
    spark = steps.sparkSession
    ship(spark)
    rows = steps.where("conv IS NOT NULL").select("conv", "pos", "step", "words")
    rows = cut(rows.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "step", "words"))
    schema = ", ".join(f"{x} long" for x in ("conv", "n1", "n2", "p1", "p2", "a1", "a2")) + ", depth int, words long, ends int"
    hot = max(min_hot, -(-rows.count() // max_top))
    plain = rows.mapInArrow(_chain(None), schema)
    # at most ``max_top`` nodes have more than ``hot`` members, since every member is a row
    often = plain.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("n1", "n2").toArrow()
    pairs = np.stack([often["n1"].to_numpy(), often["n2"].to_numpy()], 1).astype("<i8") if often.num_rows else np.zeros((0, 2), "<i8")
    top = spark.sparkContext.broadcast({x.tobytes() for x in pairs} | {ROOT})
    marked = rows.mapInArrow(_chain(top), schema)
    nodes = cut(marked.groupBy("n1", "n2").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), *[F.min(x).alias(x) for x in ("p1", "p2", "a1", "a2", "depth", "words")]))
    below = F.col("a1").eqNullSafe(0) & F.col("a2").eqNullSafe(0)  # the digest of the root: no anchor, a node of the top
    shards = max(1, -(-nodes.count() // shard_nodes))
    done = "n1 long, n2 long, p1 long, p2 long, depth long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long"
    columns = ["n1", "n2", "p1", "p2", "depth", "conv", "n_convs", "words", "kids", "leaves", "saved"]
    none = [F.lit(0).cast("bigint").alias(x) for x in ("kids", "leaves", "saved")]
    low = (nodes.where(~below).select(F.pmod(F.xxhash64("a1", "a2"), F.lit(shards)).alias("shard"), *columns[:-3], *none)
           .groupBy("shard").applyInArrow(lambda t: _accumulate(t.select(columns)), done))
    low = cut(low)
    sums = (low.where("parent_conv IS NULL").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2"))
            .agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved")))
    high = nodes.where(below).drop("kids").join(sums, ["n1", "n2"], "left").select(
        F.lit(0).alias("shard"), *columns[:-3], *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("kids", "leaves", "saved")])
    high = cut(high.groupBy("shard").applyInArrow(lambda t: _accumulate(t.select(columns)), done))
    over = F.broadcast(high.select(F.col("n1").alias("o1"), F.col("n2").alias("o2"), F.col("conv").alias("over")))  # at most max_top + 1 rows of 24 bytes
    low = (low.join(over, (F.col("p1") == F.col("o1")) & (F.col("p2") == F.col("o2")) & F.col("parent_conv").isNull(), "left")
           .withColumn("parent_conv", F.coalesce("parent_conv", "over")).drop("o1", "o2", "over"))
    ends = marked.where("ends = 1").select("n1", "n2", "conv")
    return high.unionByName(low).drop("p1", "p2"), ends


def ends_digest(ends: DataFrame, block_bits: int = 16) -> DataFrame:
    """``n1, n2, sha``: SHA-256 over the decimal ids of the conversations that end at a node, ascending, joined by commas.

    Ids are written out per block of ``2 ** block_bits`` consecutive ids, so no group is larger than that; a node's blocks are then hashed one
    after the other (SHA-256 has no other way), in one task but never held together.
    """
    block = F.shiftright("conv", block_bits)
    parts = (ends.groupBy("n1", "n2", block.alias("block"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text")))
    return (parts.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "block").select("n1", "n2", "text")
            .mapInArrow(_hash_blocks, "n1 long, n2 long, sha string"))
