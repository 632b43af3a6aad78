"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (bags of words and word pairs in a fixed number of slots), one of the
target text and one of all raw text, give every document the log of its importance weight, the
sum of log ratios over its n-grams. A document's key is that plus Gumbel noise seeded by its id, and the ``k`` documents of
the largest keys are a sample without replacement in proportion to the weights. The raw model counts every
document; the target model counts labelled good ones, a bounded sample of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, unit_hash, worker_cache
from .textvec import mix64, word_hashes

SLOTS = 1 << 14
TARGET_ROWS = 20_000
KEY_STEPS = 1 << 20  # keys are compared in steps of 1 / KEY_STEPS


def slots_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(slots, first)`` of the n-grams of texts, a slice of texts at a time: words, then pairs of adjacent words."""
    for at in range(0, len(column), 200):
        h, first = word_hashes(column.slice(at, 200))
        pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
        pairs[h[:-1] == h[1:]] = 0  # any word said twice is one and the same pair
        pairs = np.append(pairs, np.zeros(len(h) - len(pairs), np.uint64))
        ends = first[1:][np.diff(first) > 0] - 1
        grams = (np.stack([h, pairs], 1) % np.uint64(SLOTS)).astype(np.int32)
        grams[ends, 1] = SLOTS  # no pair reaches into the next text
        yield grams, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("quality")
    counts = np.zeros(SLOTS + 1, np.int64)
    for batch in batches:
        for grams, _ in slots_of(batch.column(0)):
            counts += np.bincount(grams.ravel(), minlength=SLOTS + 1)
    at = np.flatnonzero(counts[:SLOTS])
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["slot", "n"])


def model(texts: DataFrame) -> np.ndarray:
    """Smoothed log probability of each slot (``SLOTS`` values, whatever the number of texts)."""
    got = texts.mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(SLOTS)
    counts[got["slot"].to_numpy()] += got["n"].to_numpy()
    return np.log(counts / counts.sum())


def _weigh(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        r = np.append(ratio.value, 0.0)
        for batch in batches:
            out, n = [], []
            for grams, first in slots_of(batch.column(1)):
                sums = np.concatenate([[0.0], np.cumsum(r[grams].sum(1))])
                out.append(sums[first[1:]] - sums[first[:-1]])
                n.append(np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out)), pa.array(np.concatenate(n), pa.int64()),
                                              *batch.columns[2:]], ["id", "log_weight", "n_words", *batch.schema.names[2:]])
    return run


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The ``k``-th largest value of a whole-number column, by counting ever finer slices (at most 4096 counts
    reach the driver at a time); the least value when there are fewer rows, None without rows."""
    m = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not m["n"] or k < 1:
        return None
    lo, width, left = m["lo"], 1, min(k, m["n"])
    while width * 4096 <= m["hi"] - lo:
        width *= 4096
    while True:
        cell = F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).cast("bigint") if width > 1 else F.col(column) - F.lit(lo)
        got = (rows.where(F.col(column).between(lo, lo + width * 4096 - 1)).groupBy(cell.alias("cell")).count()
               .orderBy(F.col("cell").desc()).collect())
        for r in got:
            if left <= r["count"]:
                lo += r["cell"] * width
                break
            left -= r["count"]
        if width == 1:
            return lo
        width //= 4096


def share_like(rows: DataFrame, good: DataFrame, bad: DataFrame) -> float | None:
    """Estimated share of ``rows`` that is like those of ``good``; None unless both classes have rows.

    The cut on the log weight per word is where the kept shares of good and bad rows differ most, so a handful of
    wrong labels and the length of texts hardly move it. The share of all rows above it is corrected by both shares."""
    per = rows.withColumn("per", F.round(F.col("log_weight") / F.greatest("n_words", F.lit(1)), 2))
    one = lambda ids: dict(map(tuple, per.join(F.broadcast(ids), "id", "left_semi").groupBy("per").count().collect()))
    g, b = one(good), one(bad)  # counts by hundredths
    if not g or not b:
        return None
    above = lambda counts, at: sum(n for x, n in counts.items() if x >= at) / sum(counts.values())
    at = max(sorted(set(g) | set(b)), key=lambda x: above(g, x) - above(b, x))
    hit, false = above(g, at), above(b, at)
    if hit <= false:
        return None
    share = per.agg(F.avg((F.col("per") >= at).cast("double"))).first()[0]
    return min(max((share - false) / (hit - false), 0.0), 1.0)


def resample(docs: DataFrame, target_ids: DataFrame, keep: float | None = None, seed: int = 11, *, id_col: str = "doc_id",
             text_col: str = "text", target_rows: int = TARGET_ROWS, kept_good: float = 0.999, bad_ids: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``id, log_weight, n_words, key, kept``.

    ``target_ids`` (column ``id``) names good documents; at most ``target_rows`` of them, the first by a seeded hash,
    make the target model. ``keep`` is the share of all rows to keep (``k``, rounded up). Without it, ``bad_ids`` (column
    ``id``, as many at most) gives ``k``: the share of all rows that is like the good ones, as ``share_like`` estimates it from
    the log weights per word of both classes. Without bad rows either, ``k`` is as many rows as have a key no less than the share ``kept_good`` of the good ones has, so that text like the target
    stays whatever share of the table is not. Null and empty texts have weight 1 (log 0). Rows that
    repeat an id and text have the same key and are kept or dropped together. Without target ids all weights
    are 1 and, if ``keep`` is not given, all rows stay. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    kind = dict(d.dtypes)["id"]
    some = cut(target_ids.select("id").distinct().orderBy(unit_hash(seed, F.col("id")), "id").limit(target_rows))
    target = d.join(F.broadcast(some), "id", "left_semi").select("t")  # at most target_rows ids
    ratio = model(target) - model(d.select("t")) if not some.isEmpty() else np.zeros(SLOTS)
    weighed = d.mapInArrow(_weigh(spark.sparkContext.broadcast(ratio)), f"id {kind}, log_weight double, n_words long")
    noise = -F.log(-F.log((unit_hash(seed + 1, F.col("id")) + F.lit(0.5)) / F.lit(float(1 << 60))))
    rows = cut(weighed.withColumn("key", F.round((F.col("log_weight") + noise) * KEY_STEPS).cast("bigint")))
    if keep is None and bad_ids is not None and not some.isEmpty():
        bad = cut(bad_ids.select("id").distinct().orderBy(unit_hash(seed, F.col("id")), "id").limit(target_rows))
        keep = share_like(rows, some, bad)
    if keep is None:
        good = rows.join(F.broadcast(some), "id", "left_semi").select("key")
        floor = good.agg(F.expr(f"percentile(key, {1 - kept_good})").alias("p")).first()["p"]
        k = rows.where(F.col("key") >= floor).count() if floor is not None else rows.count()
    else:
        k = math.ceil(keep * rows.count())
    least = kth_largest(rows, "key", k)
    return rows.select("id", "log_weight", "n_words", (F.col("key") / KEY_STEPS).alias("key"),
                       (F.col("key") >= F.lit(least).cast("bigint") if least is not None else F.lit(False)).alias("kept"))
