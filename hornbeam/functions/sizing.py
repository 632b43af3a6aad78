"""Joins of data-size tables with schema-size ones, by measured bytes.

A schema-level table (properties, requests, rules) is broadcast only when its rows, measured, stay below
a byte bound. Beyond it the join is spread over (key, part) instead: a few copies of the
small side meet equal parts of the large one, so a property that holds a third of all
facts is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bytes of a schema-level table that we accept to ship to every executor.
MAX_BROADCAST_BYTES = 32 << 20
PARTS = 16


def row_bytes(df: DataFrame) -> F.Column:
    """Aggregate: bytes of all rows as text (plus some for each row)."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 32), F.lit(0))


def fits(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the measured rows of ``df`` may be broadcast (one small job)."""
    return df.agg(row_bytes(df)).first()[0] <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint when its measured bytes allow it; a shuffle join else."""
    return F.broadcast(df) if fits(df) else df


def spread_join(big: DataFrame, small: DataFrame, on: list[tuple[str, str]], by: list[str],
                small_fits: bool) -> DataFrame:
    """Inner join of ``big`` with ``small`` where each ``big`` column equals its ``small`` column.

    ``small_fits`` says that the measured bytes of ``small`` allow a broadcast. Else both sides get a part number,
    ``big`` from a hash of its columns ``by`` and ``small`` one copy for each part.
    """
    if small_fits:
        small = F.broadcast(small)
    else:
        big = big.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
        small = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        on = [*on, ("_part", "_copy")]
    cond = None
    for b, s in on:
        c = big[b] == small[s]
        cond = c if cond is None else cond & c
    return big.join(small, cond).drop("_part", "_copy")


def materialize_small(df: DataFrame) -> DataFrame:
    """Compute a small table (schema-level, or one row per request) and cut its lineage.

    Uses a reliable ``checkpoint`` into the session's ``spark.checkpoint.dir``
    (shared storage on a cluster), so the rows survive executor loss and every
    later plan reads a short scan instead of re-planning the branch that made
    them. Plans that chain cached tables otherwise nest whole sub-plans inside
    each other, which makes planning grow exponentially.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
