"""Heavy values: facts of one value that are too many for one task are dealt into parts.

The keys with more facts than a bound are few (the bound grows with the facts), so they are known to every task by a broadcast of
at most ``MAX_HEAVY`` rows. A join on the key then runs over (key, part): the many side is dealt by a hash of another column,
the few side gives every part a copy. Other keys have one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import materialize_small

HEAVY_FACTS = 4096  # facts of one value from which they are dealt into parts
MAX_HEAVY = 1 << 17  # at most so many values count as heavy


class Heavy:
    """Heavy keys of ``counts``: its columns ``keys`` and ``n``, the facts of each key."""

    def __init__(self, counts: DataFrame, keys: list[str]):
        self.keys = keys
        facts = counts.agg(F.sum("n")).first()[0] or 0
        self.bound = max(HEAVY_FACTS, -(-int(facts) // MAX_HEAVY))
        self.tags = materialize_small(counts.where(F.col("n") > self.bound).select(
            *[F.col(k).alias(f"_t_{k}") for k in keys], F.ceil(F.col("n") / self.bound).cast("int").alias("_t_parts")))

    def deal(self, rows: DataFrame, at: list[str], by: list[str] | None) -> DataFrame:
        """``rows`` with ``_part``, their key in columns ``at``: the part of their ``by`` values, or one copy for each part without ``by``."""
        same = None
        for a, k in zip(at, self.keys, strict=True):
            one = F.col(a) == F.col(f"_t_{k}")
            same = one if same is None else same & one
        r = rows.join(F.broadcast(self.tags), same, "left")
        parts = F.coalesce("_t_parts", F.lit(1))
        part = F.explode(F.sequence(F.lit(0), parts - 1)) if by is None else F.pmod(F.xxhash64(*by), parts).cast("int")
        return r.select(*rows.columns, part.alias("_part"))
