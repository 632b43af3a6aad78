"""N-gram Jaccard join by vertical partitioning.

The n-grams (word shingles) of all texts have one global order: rarer first, where rarity is the count of the
n-gram's slot in a table of fixed size. The order is cut into fragments of equal mass. The overlap of a
candidate pair is counted in each fragment separately, between the two slices of the sets that lie in it, and
summed per pair; 64-bit n-gram hashes stand for the n-grams.

Candidates (exact: no linked pair is missed):

* equal sets are one node; only nodes are compared;
* two sets that link share an n-gram among the first of the order of both (prefix filter), and their sizes lie in the same or
  adjacent bands; so holders of an n-gram meet in windows of two bands;
* in each window all holders are first compared with one (a star), which links most near copies;
* then holders in different components are compared with each other, each pair at the first
  n-gram it shares, in blocks, so that a group of thousands is never expanded into all pairs. Both steps first
  drop pairs whose overlap cannot suffice by their counts in ``SKETCH`` hash classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, components, cut, discard, maybe_in, numpy_bitmap, numpy_maybe_in, ship, stored, worker_cache
from .textvec import shingle_set, word_hashes

SLOT_BITS = 18
FRAGMENTS = 8
SKETCH = 64
BLOCK = 512
BITS = 1 << 22
MAX_BITS = 1 << 27  # of the bitmap of n-grams held twice, 16 MB


def bits_for(keys: int) -> int:
    """About eight bits a key, within ``BITS`` and ``MAX_BITS``."""
    return min(max(BITS, 1 << (8 * keys).bit_length()), MAX_BITS)


def enough(inter: Column, a: Column, b: Column, percent: int) -> Column:
    """``100 * |intersection| >= percent * |union|`` in whole numbers."""
    return 100 * inter >= percent * (a + b - inter)


class Order:
    """The global order of n-gram hashes and its fragments, from the slot counts (a table of fixed size)."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        order = np.argsort(counts, kind="stable")
        mass = np.cumsum(counts[order])
        part = np.minimum(mass * FRAGMENTS // max(int(mass[-1]), 1), FRAGMENTS - 1)
        # a slot count lies in one fragment, so fragments are ranges of the order
        part = part[np.searchsorted(counts[order], counts[order], "left")]
        self.fragment = np.zeros(len(counts), np.int8)
        self.fragment[order] = part

    def slots(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def prefix(self, grams: np.ndarray, percent: int) -> np.ndarray:
        """The first of the order that two linked sets must share, given their size alone."""
        n = len(grams)
        size = n - -(-percent * n // 100) + 1
        return grams[np.lexsort((grams, self.counts[self.slots(grams)]))[:size]]


def sketch(grams: np.ndarray) -> bytes:
    """Counts in ``SKETCH`` hash classes; empty when one does not fit a byte (then nothing is ruled out)."""
    counts = np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and n-gram set of each text of column 1, a slice of rows at a time."""
    for at in range(0, batch.num_rows, 500):
        h, first = word_hashes(batch.column(1).slice(at, 500))
        for i in range(len(first) - 1):
            yield at + i, shingle_set(h[first[i]:first[i + 1]], size)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most 1,000 at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield batch.slice(at, 1000)


def _survey(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        kind = None
        for batch in batches:
            kind = kind or batch.schema.field(0).type
            n, digest = [], []
            for _, grams in _sets(batch, size):
                n.append(len(grams))
                digest.append(_digest(grams) if len(grams) else None)
                np.add.at(counts, (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
            nothing = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), nothing,
                                              nothing], ["id", "n", "digest", "slot", "held"])
        slot = np.flatnonzero(counts)
        for k in range(0, len(slot), 50_000):
            s = slot[k:k + 50_000]
            none = len(s)
            yield pa.RecordBatch.from_arrays([pa.nulls(none, kind), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()),
                                              pa.array(s, pa.int64()), pa.array(counts[s])], ["id", "n", "digest", "slot", "held"])
    return run


def _profiles(size: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for batch in _small(batches):
            rows = [(i, _digest(g), sketch(g), o.prefix(g, percent)) for i, g in _sets(batch, size) if len(g)]
            lists = [x[3].view(np.int64) for x in rows]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([x[0] for x in rows], pa.int64())), pa.array([x[1] for x in rows], pa.binary()),
                 pa.array([x[2] for x in rows], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))],
                ["id", "digest", "sketch", "firsts"])
    return run


def _held_twice(often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            keep = numpy_maybe_in(often.value, values)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            offsets = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32)
            some = pa.array(np.diff(offsets) > 0)
            firsts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[keep]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], firsts], batch.schema.names).filter(some)
    return run


def _slices(size: int, order):
    """The set of each text by its digest, cut into the fragments of the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        kind = pa.list_(pa.list_(pa.int64()))
        for batch in _small(batches):
            digests, ends, grams = [], [0], []
            for _, g in _sets(batch, size):
                if len(g):
                    part = o.fragment[o.slots(g)]
                    digests.append(_digest(g))
                    ends += (ends[-1] + np.cumsum(np.bincount(part, minlength=FRAGMENTS))).tolist()
                    grams.append(g[np.argsort(part, kind="stable")].view(np.int64))
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(len(digests) + 1, dtype=np.int32) * FRAGMENTS), inner)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), outer.cast(kind)], ["digest", "fragments"])
    return run


def _possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap of sketched sets may suffice (row by row); the sketch bounds it from above."""
    most = np.minimum(a, b).sum(-1, dtype=np.int64)
    return 100 * most >= percent * (na + nb - most)


def _rule_out(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if not sa[i] or not sb[i]:
                    keep.append(i)
                elif _possible(np.frombuffer(sa[i], np.uint8), np.frombuffer(sb[i], np.uint8), na[i], nb[i], percent):
                    keep.append(i)
            yield batch.select([0, 1, 2, 3]).take(pa.array(keep, pa.int64()))
    return run


def _share(before: pa.ListArray) -> np.ndarray | None:
    """How many n-grams each two rows share (a square matrix), counted over slices of the n-grams held more than once."""
    values = before.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(before)), before.value_lengths().to_numpy(zero_copy_only=False))
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times > 1
    if not often.any():
        return None
    row, at = row[often[at]], (np.cumsum(often) - 1)[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(before), len(before)), np.float32)
    for k in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(at, [k, k + 2048])
        held = np.zeros((len(before), 2048), np.float32)
        held[row[lo:hi], at[lo:hi] - k] = 1
        out += held @ held.T
    return out


def _cross(percent: int):
    """Rows ``gram, win, block, node, component, side, n, band, sketch, before`` sorted by the first three; a block holds
    two slices (``side`` 0 and 1, or 2 for a slice with itself), ``before`` the earlier n-grams of a row. Gives pairs of different
    components that may link, share no earlier n-gram, and whose smaller band is the window's first."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        win = rows.column(1)[0].as_py()
        node, comp, side, n, band = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4, 5, 6, 7))
        if len(node) < 2 or (comp == comp[0]).all():
            return None
        sketches = rows.column(8).to_pylist()
        s = np.stack([np.frombuffer(x, np.uint8) if x else np.full(SKETCH, 255, np.uint8) for x in sketches])
        blind = np.array([not x for x in sketches])
        shared = _share(rows.column(9))
        out = []
        for i in range(len(node) - 1):
            j = np.arange(i + 1, len(node))
            j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[j] == 2)) & (np.minimum(band[j], band[i]) + 1 == win)]
            small, large = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
            j = j[100 * small >= percent * large]
            if len(j) and shared is not None:
                j = j[shared[i, j] == 0]
            if len(j):
                j = j[blind[i] | blind[j] | _possible(s[j], s[i], n[j], n[i], percent)]
                first = node[i] < node[j]
                out.append((np.where(first, node[i], node[j]), np.where(first, node[j], node[i]),
                            np.where(first, n[i], n[j]), np.where(first, n[j], n[i])))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        open_group: pa.RecordBatch | None = None
        for batch in batches:
            if open_group is not None:
                batch = pa.concat_batches([open_group, batch])
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)])
            at = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1]).tolist()
            for lo, hi in zip(at, at[1:], strict=False):
                if (found := pairs(batch.slice(lo, hi - lo))) is not None:
                    yield found
            open_group = batch.slice(at[-1])
        if open_group is not None and (found := pairs(open_group)) is not None:
            yield found
    return run


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, *, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n, component``: size of its n-gram set and the smallest id reachable by links.

    Words are runs without ASCII spaces, A-Z lower-cased; the set holds the distinct runs of ``shingle`` words, or with
    fewer words the whole sequence. Two rows link when ``100 * |intersection| >= percent * |union|``. Null and
    empty texts and texts of spaces have no n-grams and link with nothing (``n`` 0, ``component`` their own id). Equal sets are
    linked. Rows that repeat an id are rows of their own. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    kind = dict(d.dtypes)["id"]
    survey = stored(d.mapInArrow(_survey(shingle), f"id {kind}, n long, digest binary, slot long, held long"), "ngram-survey")
    slots = survey.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("held").alias("held")).toArrow()  # 2**SLOT_BITS rows at most
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["held"].to_numpy()
    order = spark.sparkContext.broadcast(Order(counts))
    rows = survey.where("slot IS NULL").select("id", "n", "digest")
    nodes = cut(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.max("n").alias("n")))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    profiles = d.mapInArrow(_profiles(shingle, percent, order), f"id {kind}, digest binary, sketch binary, firsts array<long>")
    profiles = stored(profiles.join(nodes, (profiles["digest"] == nodes["digest"]) & profiles["id"].eqNullSafe(nodes["id"]))
                      .select("node", "n", "sketch", "firsts"), "ngram-profiles")  # a row said again is there again
    # keep of the firsts what another node holds as well (and, by chance, a little more)
    twice = profiles.select(F.explode("firsts").alias("gram")).groupBy("gram").count().where("count > 1")
    # a set of n gives at most n - ceil(n * percent / 100) + 1 firsts, and half as many can be held twice
    most = nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    often = spark.sparkContext.broadcast(numpy_bitmap(twice, "gram", bits_for(int(most) // 2)))
    all_firsts, profiles = profiles, stored(profiles.mapInArrow(_held_twice(often), profiles.schema), "ngram-profiles")
    discard(all_firsts)
    # a little wider than the ratio of sizes of linked sets, so that rounding cannot part them by two bands
    width = 1.0001 * math.log(100 / percent) if percent < 100 else 1.0
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    holders = profiles.select(F.explode("firsts").alias("gram"), "node", "n", band.alias("band"))
    holders = holders.withColumn("win", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    holders = holders.withColumn("key", F.xxhash64("gram", "win"))

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among the pairs ``a, b, na, nb``: overlaps counted in each fragment, summed per pair.

        Sets meet by their digest, so copies need no look-up; they are exchanged once, by digest, and once more for each
        pair they are the first of.
        """
        pairs = cut(pairs.distinct())
        own = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        own = cut(nodes.join(own, "node", "left_semi").withColumn("at", F.xxhash64("id")))
        near = d.where(maybe_in(bitmap(own, "at", BITS), F.xxhash64("id"), BITS))
        sets = (near.mapInArrow(_slices(shingle, order), "digest binary, fragments array<array<long>>")
                .repartition("digest").dropDuplicates(["digest"]))
        named = own.select("node", "digest")
        pairs = (pairs.join(named.toDF("a", "da"), "a").join(named.toDF("b", "db"), "b").select("a", "b", "na", "nb", "da", "db"))
        left = sets.select(F.col("digest").alias("da"), F.col("fragments").alias("fa"))
        right = sets.select(F.col("digest").alias("db"), F.col("fragments").alias("fb"))
        parts = F.zip_with("fa", "fb", lambda x, y: F.size(F.array_intersect(x, y)).cast("bigint"))
        both = pairs.join(left, "da").join(right, "db").select(
            "a", "b", "na", "nb", F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n + x).alias("inter"))
        return both.where(enough(F.col("inter"), F.col("na"), F.col("nb"), percent)).select("a", "b")

    first = (holders.groupBy("gram", "win").agg(F.min(F.when(F.col("band") < F.col("win"), F.struct("node", "n"))).alias("hub"), F.count(F.lit(1)).alias("k"))
             .where("k > 1 AND hub IS NOT NULL"))
    first = stored(first.select(F.col("gram").alias("g"), F.col("win").alias("w"), F.xxhash64("gram", "win").alias("key"),
                                F.col("hub.node").alias("a"), F.col("hub.n").alias("na"), "k"), "ngram-hubs")
    live = holders.where(maybe_in(bitmap(first, "key", BITS), F.col("key"), BITS))
    live = stored(live.join(first.drop("key"), (F.col("gram") == F.col("g")) & (F.col("win") == F.col("w"))).where("node <> a")
                  .select("gram", "win", "node", "n", "band", "a", "na", "k"), "ngram-holders")
    star = (live.where(100 * F.least("n", "na") >= percent * F.greatest("n", "na"))
            .select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).distinct())
    look = profiles.select(F.col("node").alias("x"), "sketch")
    star = (star.join(look.withColumnRenamed("sketch", "sa"), F.col("a") == F.col("x")).drop("x")
            .join(look.withColumnRenamed("sketch", "sb"), F.col("b") == F.col("x")).select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(_rule_out(percent), "a long, b long, na long, nb long"))
    links = cut(verify(star))
    found = components(links)

    # the rest: holders in different components, without their hub, which all have met
    member = cut(live.where("k > 2").select("gram", "win", "node", "band", "k").join(found, "node", "left")
                 .withColumn("component", F.coalesce("component", "node")))
    mixed = (member.groupBy("gram", "win").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("band").alias("band"))
             .where("lo < hi AND band < win").select(F.col("gram").alias("g"), F.col("win").alias("w")))
    parts = F.ceil(F.col("k") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = (member.join(mixed, (F.col("gram") == F.col("g")) & (F.col("win") == F.col("w"))).withColumn("parts", parts).withColumn("own", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("block", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
              .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
              .select("gram", "win", "block", "node", "component", "side", "band"))
    cross = (spread.join(profiles, "node")
             .select("gram", "win", "block", "node", "component", "side", "n", "band", "sketch",
                     F.expr("slice(firsts, 1, cast(array_position(firsts, gram) as int) - 1)").alias("before"))
             .repartition("gram", "win", "block").sortWithinPartitions("gram", "win", "block")
             .mapInArrow(_cross(percent), "a long, b long, na long, nb long").distinct())
    links = links.unionByName(verify(cross))
    found = components(links)

    label = (nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = label.groupBy("component").agg(F.min("id").alias("least"))
    label = cut(label.join(least, "component").select("digest", "least"))
    parts = 8  # rows of one large group of copies meet their label in several parts
    label = label.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    some = (rows.where("digest IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
            .join(label, ["digest", "part"]).select("id", "n", F.col("least").alias("component")))
    return some.unionByName(rows.where("digest IS NULL").select("id", "n", F.col("id").alias("component")))
