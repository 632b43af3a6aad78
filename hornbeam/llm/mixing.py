"""Mix sources to target weights: capped water-filling and seeded repetitions.

Targets: every source gets its weight's share of the total, clamped at ``max_epochs`` times its
own size; what clamped sources leave over is shared again by weight among the others, until
no target is above its clamp.

Repetitions: a source that needs ``e`` epochs takes every document ``floor(e)`` times and then
more documents in a seeded order until its target is met. The point of that order
where the target is met is found by refinement: sizes are summed per source and slice of the hash
space, then only the slice that holds the point is cut into finer slices, and only the few
documents of the last slice are ordered. No source is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, SLICE_BITS, LEVELS = 60, 12, 3
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    """Number of words: runs of anything but blank, tab, line feed, VT, FF, CR. Null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def bounded(df: DataFrame, text_col: str) -> DataFrame:
    """Hint a broadcast only when the measured bytes are small; else leave a shuffle join."""
    m = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if m["b"] + 100 * m["n"] <= BROADCAST_BYTES else df


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``sources`` (``source, size, weight``; one row each).

    ``total`` is an aggregate expression over the table, such as ``1.5 * sum(size)``. A round clamps all
    sources whose share is above their clamp; clamped sources stay so. It ends when a round clamps none,
    after as many rounds as there are distinct clamp-to-weight ratios at most. When all are
    clamped the rest of the total is left unused.
    """
    clamp = F.lit(float(max_epochs)) * F.col("size")
    s = cut(sources.withColumn("clamped", F.lit(False)))
    whole = s.agg(total.cast("double")).first()[0] or 0.0
    while True:
        m = s.agg(F.sum(F.when(F.col("clamped"), clamp)).alias("used"),
                  F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("w")).first()
        rest, w = max(whole - (m["used"] or 0.0), 0.0), m["w"] or 0
        share = F.col("weight") * F.lit(rest) / F.lit(float(w or 1))
        if not w or not s.where(~F.col("clamped") & (share > clamp)).limit(1).count():
            return s.withColumn("target", F.when(F.col("clamped"), clamp).otherwise(share)).drop("clamped")
        s = cut(s.withColumn("clamped", F.col("clamped") | (share > clamp)))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, *,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``id, size, source, source_size, target, taken, repeats``.

    Sources in code-point order, null last (a source of its own), take ``weights`` in turn, repeating.
    Together they share ``share`` times all words. ``taken`` counts the words the mix takes from the
    document, repeats included; per source it sums to the target within one word. The
    document where the target is met is taken in part. ``repeats`` are whole times,
    that part counted when it is at least half of the document. Empty and null texts have size 0
    and are never taken; rows that repeat an id and text are taken one by one in any order (they are
    alike). An empty table gives an empty result; other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                    word_count(F.col(text_col)).alias("size"))
    d = cut(d.withColumn("h", unit_hash(seed, F.col("id"))))

    sizes = d.groupBy("source").agg(F.sum("size").alias("size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    # one row per source: the only global order here, over the names alone
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights)).cast("int") + 1)
    plan = water_fill(sizes.withColumn("weight", w), F.sum("size") * F.lit(float(share)), max_epochs)

    # whole epochs, and the words to take beyond them
    epochs = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("bigint")
    plan = plan.withColumn("whole", epochs)
    plan = cut(plan.withColumn("more", F.round(F.col("target") - F.col("whole") * F.col("size")).cast("bigint"))
               .withColumnsRenamed({"size": "source_size", "source": "s"}).drop("weight"))
    d = d.join(bounded(plan, "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    # the slice of each level that holds the point where `more` words are reached
    point = None
    by_source = Window.partitionBy("source")
    rows = d.where("more > 0").select("source", "h", "size", "more")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - SLICE_BITS * level
        cells = rows.withColumn("slice", F.shiftright("h", shift))
        if point is not None:
            near = bounded(point.select(F.col("source").alias("s"), F.col("slice").alias("up"), "before"), "s")
            cells = cells.join(near, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("slice", SLICE_BITS) == F.col("up")))
        else:
            cells = cells.withColumn("before", F.lit(0).cast("bigint"))
        cells = cells.groupBy("source", "slice", "more", "before").agg(F.sum("size").alias("size"))
        upto = F.col("before") + F.sum("size").over(by_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("upto", upto).where(F.col("upto") >= F.col("more"))
        first = F.row_number().over(by_source.orderBy("slice"))
        point = cut(cells.withColumn("k", first).where("k = 1")
                    .select("source", "slice", (F.col("upto") - F.col("size")).alias("before")))

    end = bounded(point.select(F.col("source").alias("s"), "slice", "before"), "s")
    d = d.join(end, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    mine = F.shiftright("h", HASH_BITS - SLICE_BITS * LEVELS)
    d = d.withColumn("side", F.when(F.col("slice").isNull() | (mine > F.col("slice")), 1)
                     .when(mine < F.col("slice"), -1).otherwise(0))
    away = d.where("side <> 0").withColumn("extra", F.when(F.col("side") < 0, F.col("size")).otherwise(0))
    order = by_source.orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = d.where("side = 0").withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("upto")))).drop("upto")
    out = away.unionByName(last)
    return out.select(
        "id", "size", "source", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
        (F.col("whole") + ((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size"))).cast("bigint")).alias("repeats"))
