"""Near duplicates among embeddings by NN-descent.

1. Equal vectors become one node.
2. A first neighbour graph: nodes are sorted by the signs of a few random projections, in several seeded orders, and
   each meets the next few of every order.
3. Rounds of neighbours-of-neighbours joins: the neighbours of each node, in both directions, meet each other, and
   every node keeps its ``k`` nearest. Lists of hubs are dealt into parts, anew in each round. Links that were met
   are kept as edges of components (a star for each part), also when closer neighbours push them out of a list.
4. Lists that are full of links are saturated: they are enlarged to the whole component of threshold edges and ``k``
   more outside of it, and orders and rounds are repeated for what is outside, until no list is full of links.
5. The members of a component are compared in blocks in double precision. That gives exact link counts within
   components without a row for each pair.
6. Recall is audited, as the mean over sampled nodes that have links, against all vectors; while it is too low, the
   search goes on with more orders and longer lists, and it is an error if it stays too low.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, ship, stored, unit_hash

SLACK = 1e-4   # what single precision may be off; pairs this close below the threshold are compared in double
BLOCK = 256
PART = 64
AUDIT = 300     # nodes with links that the audit wants
SENT = 4800     # nodes that are compared with all in one pass
SALTS = 8


def unit(rows: list[bytes]) -> np.ndarray:
    """Unit vectors in single precision; shorter vectors count as padded with zeros."""
    x = matrix(rows)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def matrix(rows: list[bytes]) -> np.ndarray:
    width = max(map(len, rows)) // 8
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows)).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r) // 8] = np.frombuffer(r)
    return out


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles of each vector; null when it is null, zero or holds null or non-finite components."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and len(v.values) and not v.values.null_count else None
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            most = np.abs(x).max()
            if not 1e-100 < most < 1e100:  # by a power of two, so that squares neither overflow nor vanish
                x = np.ldexp(x, -np.frexp(most)[1])
            out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])


def _orders(seeds: list[int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(1).to_pylist())
            for seed in seeds:
                # drawn row by row, so a narrower batch has the first of the same rows
                p = x @ np.random.default_rng(seed).normal(size=(x.shape[1], bits + 1)).astype(np.float32)
                code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), seed)), pa.array(code, pa.int64()), pa.array(p[:, bits].astype(np.float64)), batch.column(0),
                     batch.column(2), pa.array([y.tobytes() for y in x], pa.binary())], ["seed", "code", "along", "node", "c", "v"])
    return run


def _singles(rows: list[bytes]) -> np.ndarray:
    width = max(map(len, rows)) // 4
    out = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        out[i, :len(r) // 4] = np.frombuffer(r, np.float32)
    return out


def _adjacent(reach: int, threshold: float):
    """Similarity of each row with the ``reach`` rows before the run of its component in its order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, node, c, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            old = len(node)
            seed = np.append(seed, batch.column(0).to_numpy())
            node = np.append(node, batch.column(3).to_numpy())
            c = np.append(c, batch.column(4).to_numpy())
            raw += batch.column(5).to_pylist()
            if not len(node):
                continue
            x = _singles(raw)
            start = np.append(True, (seed[1:] != seed[:-1]) | (c[1:] != c[:-1]))
            start = np.maximum.accumulate(np.where(start, np.arange(len(node)), 0))
            a, b, s = [], [], []
            for step in range(1, reach + 1):
                i = np.arange(old, len(node))
                i = i[start[i] >= step]
                j = start[i] - step
                fine = (seed[i] == seed[j]) & (c[i] != c[j])
                i, j = i[fine], j[fine]
                a.append(node[j])
                b.append(node[i])
                s.append(np.einsum("ij,ij->i", x[j], x[i]))
            a, b, s = (np.concatenate(z) for z in (a, b, s))
            yield _edges(a, b, s, s >= threshold - SLACK)
            last = start[-1]  # the next batch may go on with this run: what is before it, and its own last rows
            keep = np.append(np.arange(max(last - reach, 0), last), np.arange(max(len(node) - reach, last), len(node)))
            seed, node, c, raw = seed[keep], node[keep], c[keep], [raw[k] for k in keep]
    return run


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray, tie: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.append(a, b), pa.int64()), pa.array(np.append(b, a), pa.int64()),
                                       pa.array(np.append(s, s), pa.float32()), pa.array(np.append(tie, np.zeros(len(tie), bool)))],
                                      ["u", "v", "sim", "tie"])


def _meet(threshold: float):
    """Rows ``at, part, node, least, fresh, c, vec`` sorted by (at, part): all pairs of a part from two components, one of
    them fresh, that would enter the list of one of them; and as ties a star for each set of the part that links join."""
    def pairs(rows):
        node, least, fresh = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.float32), np.array([r[4] for r in rows])
        c = np.array([r[5] for r in rows])
        x = _singles([r[6] for r in rows])
        s = x @ x.T
        apart = c[:, None] != c[None]
        link = apart & (s >= threshold - SLACK)
        root = np.arange(len(rows))
        while True:
            new = np.minimum(root, np.where(link, root[None], len(rows)).min(1))
            if (new == root).all():
                break
            root = new
        tie = np.zeros_like(link)
        tie[root, np.arange(len(rows))] = True
        tie &= apart
        i, j = np.nonzero(np.triu(apart & (fresh[:, None] | fresh[None]) & (s > np.minimum(least[:, None], least[None])), 1) | tie)
        return node[i], node[j], s[i, j], tie[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    if len(held) > 1:
                        out.append(pairs(held))
                        size += len(out[-1][0])
                    held = []
                    if size > 50_000:
                        yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))
                        out, size = [], 0
                held.append(row)
        if len(held) > 1:
            out.append(pairs(held))
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))
    return run


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node (``held``) with the least similarity of its list (-1 while it is not full), and all ties."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("tie").alias("tie"))
    w = Window.partitionBy("u")
    rank = F.row_number().over(w.orderBy(F.col("sim").desc(), "v"))
    top = one.withColumn("rank", rank).withColumn("held", F.col("rank") <= k).where("held OR tie")
    full = F.count(F.when(F.col("held"), 1)).over(w) == k
    return top.withColumn("least", F.when(full, F.min(F.when(F.col("held"), F.col("sim"))).over(w)).otherwise(F.lit(-1.0)).cast("float")).drop("rank")


def _exact(threshold: float):
    """Rows ``component, block, side, node, copies, v`` sorted by block: links within a block, in double precision.

    Gives ``node, root, n``: how many vectors of the block's other slice (or its own) the node links with, and a node of its
    links in this block that stands for all it reaches here."""
    def links(rows):
        node, copies = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        side, x = np.array([r[2] for r in rows]), matrix([r[5] for r in rows])
        norm = np.linalg.norm(x, axis=1)
        near = (x @ x.T) / norm[:, None] / norm[None] >= threshold
        near &= (side[:, None] != side[None]) | (side[:, None] == 2)
        np.fill_diagonal(near, False)
        root = np.arange(len(node))
        order = np.argsort(node)
        while True:  # smallest position by node id, spread along links until nothing changes
            place = np.empty(len(node), np.int64)
            place[order] = np.arange(len(node))
            low = np.where(near, place[root][None], len(node)).min(1, initial=len(node))
            new = np.where(low < place[root], order[np.minimum(low, len(node) - 1)], root)
            if (new == root).all():
                break
            root = new
        n = near @ copies
        keep = n > 0
        return node[keep], node[root][keep], n[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links(held)], ["node", "root", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield emit()
                    held = []
                held.append(row)
        if held:
            yield emit()
    return run


def _audit(queries, threshold: float):
    """Rows ``node, v, c``: for each queried node its links among them, and how many of these are of its component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, own = queries.value
        names, own = np.array(names), np.array(own)
        n, hit = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                some = batch.slice(at, 4 * BLOCK)
                x = matrix([*vectors, *some.column(1).to_pylist()])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                near = (x[:len(names)] @ x[len(names):].T >= threshold) & (names[:, None] != some.column(0).to_numpy()[None])
                n += near.sum(1)
                hit += (near & (own[:, None] == some.column(2).to_numpy()[None])).sum(1)
        seen = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(names[seen], pa.int64()), pa.array(n[seen]), pa.array(hit[seen])], ["a", "n", "hit"])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    k: int = 10, orders: int = 8, reach: int = 3, rounds: int = 3, min_recall: float = 0.99,
                    attempts: int = 3) -> DataFrame:
    """One row per input row: ``id, n_links, component, kept``.

    Two rows link when the cosine of their vectors, in double precision, reaches ``threshold``. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing. ``component`` is the smallest id reachable by links, ``kept`` whether
    it is the row's own. Rows that repeat an id are rows of their own. Other columns are ignored; an empty table
    gives an empty result. The search is approximate: links between components that no found edge joins are missed;
    its recall is audited on ``AUDIT`` nodes that have links and the search repeated up to ``attempts`` times, each with twice
    the orders and lists, while it is below ``min_recall``; if the last is still below, that is an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    raw = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("x"))
    kind = dict(raw.dtypes)["id"]
    rows = stored(raw.mapInArrow(_usable, f"id {kind}, v binary").withColumn("same", F.unhex(F.md5("v"))), "vectors")
    groups = rows.where("v IS NOT NULL").groupBy("same").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"),
                                                            F.min("v").alias("v"))
    nodes = stored(stored(groups, "vectors").withColumn("node", F.monotonically_increasing_id()), "vectors")
    total = nodes.count()
    single = stored(nodes.select("node", "v").mapInArrow(_singled, "node long, v32 binary"), "vectors")
    bits = max(1, int(math.log2(max(total, 2) / 8)))
    found, kin, graph = None, None, None
    for attempt in range(attempts):
        seeds = list(range(1, 1 + orders * 2 ** attempt))
        size = k * 2 ** attempt
        full = True
        while full:  # each time round joins components; lists that were full of links go on outside of theirs
            named = _named(nodes, found)
            near = None if graph is None else _apart(graph, kin, named)
            kin = None if near is None else stored(nearest(near.where("same").drop("same"), size).where("held").select("u", "v", "sim"), "graph")
            first = (nodes.select("node", "v").join(named, "node").select("node", "v", "c")
                     .mapInArrow(_orders(seeds, bits), "seed long, code long, along double, node long, c long, v binary")
                     .repartitionByRange("seed", "code", "along", "node").sortWithinPartitions("seed", "code", "along", "node")
                     .mapInArrow(_adjacent(reach, threshold), "u long, v long, sim float, tie boolean").withColumn("fresh", F.lit(True)))
            graph = stored(nearest(first if near is None else first.unionByName(near.where("NOT same").drop("same")), size), "graph")
            links = [graph]
            for step in range(rounds):
                graph = stored(nearest(graph.where("held").select("u", "v", "sim", F.lit(False).alias("fresh"), F.lit(False).alias("tie"))
                                       .unionByName(_round(graph, kin, named, single, step, threshold)), size), "graph")
                links.append(graph)
            edges = functools.reduce(DataFrame.unionByName, links).where(F.col("tie") | (F.col("sim") >= threshold - SLACK))
            edges = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
            if found is not None:
                edges = edges.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = components(edges)
            full = not graph.where(F.col("least") >= threshold - SLACK).isEmpty()
        spread = _blocks(nodes, found)
        exact = stored(spread.mapInArrow(_exact(threshold), "node long, root long, n long"), "links")
        linked = components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")))
        share = recall(nodes, linked, threshold)
        if share >= min_recall:
            break
    else:
        raise RuntimeError(f"links are missing: the audited recall is {share:.4f}, below {min_recall}, after {attempts} attempts")
    counts = exact.groupBy("node").agg(F.sum("n").alias("n"))
    label = nodes.drop("v").join(linked, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = label.groupBy("component").agg(F.min("least").alias("first"))
    label = (label.join(least, "component").select("same", "copies", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "first")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    some = (rows.where("v IS NOT NULL").select("id", "same").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
            .join(cut(label), ["same", "salt"])
            .select("id", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.col("first").alias("component")))
    rest = rows.where("v IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return some.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def _named(nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    """``node, c``: the component of each node, itself where it has no links yet."""
    if found is None:
        return nodes.select("node", F.col("node").alias("c"))
    return stored(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c")), "names")


def _apart(graph: DataFrame, kin: DataFrame | None, named: DataFrame) -> DataFrame:
    """The lists so far, ``same`` where both nodes are of one component."""
    lists = graph.where("held").select("u", "v", "sim")
    lists = lists if kin is None else lists.unionByName(kin)
    name = lambda x: named.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"))
    return (lists.join(name("u"), "u").join(name("v"), "v")
            .select("u", "v", "sim", F.lit(False).alias("fresh"), F.lit(False).alias("tie"), (F.col("cu") == F.col("cv")).alias("same")))


def _round(graph: DataFrame, kin: DataFrame | None, named: DataFrame, single: DataFrame, step: int, threshold: float) -> DataFrame:
    """What neighbours of a node, in both directions and of its own component or not, find by meeting each other."""
    least = graph.groupBy("u").agg(F.first("least").alias("least"))
    lists = graph.where("held").select("u", "v", "fresh")
    lists = lists if kin is None else lists.unionByName(kin.select("u", "v", F.lit(False).alias("fresh")))
    both = lists.select(F.col("u").alias("at"), F.col("v").alias("node"), "fresh").unionByName(
        lists.select(F.col("v").alias("at"), F.col("u").alias("node"), "fresh"))
    both = both.groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
    held = both.groupBy("at").agg(F.count(F.lit(1)).alias("held"), F.max("fresh").alias("any")).where("any AND held > 1").drop("any")
    members = (both.join(held, "at").withColumn("part", F.pmod(F.xxhash64("node", F.lit(step)),
                                                               F.ceil(F.col("held") / PART)).cast("int"))
               .join(least.withColumnRenamed("u", "node"), "node", "left").join(single.join(named, "node"), "node")
               .select("at", "part", "node", F.coalesce("least", F.lit(-1.0).cast("float")).alias("least"), "fresh", "c", "v32"))
    return (members.repartition("at", "part").sortWithinPartitions("at", "part")
            .mapInArrow(_meet(threshold), "u long, v long, sim float, tie boolean").withColumn("fresh", F.lit(True)))


def _singled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in unit(batch.column(1).to_pylist())], pa.binary())],
                                         ["node", "v32"])


def _blocks(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Members of each component dealt into slices of about ``BLOCK``; every two slices (and each with itself) make a block."""
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return (found.join(size, "component").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("block", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
            .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
            .join(nodes.select("node", "copies", "v"), "node").select("component", "block", "side", "node", "copies", "v")
            .repartition("component", "block").sortWithinPartitions("component", "block"))


def recall(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Mean over nodes that have links with any node of the share of these links within one component.

    Nodes are drawn by a seeded hash, at most ``SENT`` at a time, until ``AUDIT`` of them have links or all are drawn."""
    tagged = nodes.select("node", "v").join(_named(nodes, found), "node")
    drawn = nodes.select("node", unit_hash(1, F.col("node")).alias("h"))
    last, size, linked, share = None, AUDIT, 0, 0.0
    while linked < AUDIT:
        left = drawn if last is None else drawn.where((F.col("h") > last["h"]) | ((F.col("h") == last["h"]) & (F.col("node") > last["node"])))
        names = cut(left.orderBy("h", "node").limit(size))
        some = tagged.join(F.broadcast(names), "node").orderBy("h", "node").collect()  # at most SENT rows
        if not some:
            break
        sent = nodes.sparkSession.sparkContext.broadcast(([r["node"] for r in some], [bytes(r["v"]) for r in some], [r["c"] for r in some]))
        m = (tagged.select("node", "v", "c").mapInArrow(_audit(sent, threshold), "a long, n long, hit long")
             .groupBy("a").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
             .agg(F.count(F.lit(1)).alias("linked"), F.sum(F.col("hit") / F.col("n")).alias("share")).first())
        linked, share, last, size = linked + m["linked"], share + (m["share"] or 0.0), some[-1], min(2 * size, SENT)
    return share / linked if linked else 1.0
