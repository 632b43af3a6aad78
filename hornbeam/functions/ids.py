"""Compact ids: the names of a knowledge graph (IRIs, values) as 64-bit numbers.

Measures only ask whether two names are equal, so every fact-level exchange carries numbers and names come back on
the rule table. The id of a name is its 64-bit hash, which needs neither a dictionary join nor an exchange of names; that no two
names share an id is measured, not assumed: one aggregation over the ids compares a second hash of the names behind each. Names
that do clash (some hundred among 10^11) are hashed again under another seed until none do. ``counted_by_ids`` measures it on the
distinct facts that a measure keeps anyway, so the facts are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 8
MAX_CLASHES = 1 << 16  # clashing ids that the expression may list

RULE_NAMES = ("head", "body1", "body2")
CLASS_LISTS = ("d0", "d1", "d2", "c12", "c13", "c23", "c123")


def _hash(name: Column, seed: int) -> Column:
    return F.xxhash64(name) if seed == 0 else F.xxhash64(F.lit(seed), name)


def _check(name: Column) -> Column:
    """32 bits of another hash family: names that share an id and these too (less than one chance in 10^7 among 10^11 names) go unseen."""
    return F.hash(name)


def _both(first: Column, second: Column) -> Column:
    """Two 32-bit numbers in the halves of one."""
    return F.shiftleft(first.cast("bigint"), 32).bitwiseOR(second.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def _halves(both: str) -> tuple[Column, Column]:
    return F.shiftright(both, 32).cast("int"), F.shiftright(F.shiftleft(both, 32), 32).cast("int")


class NameIds:
    """Ids for the names of ``facts`` and ``schema``: equal names have equal ids, different names different ones."""

    def __init__(self, facts: DataFrame | None, schema: DataFrame):
        """``facts`` None leaves their names to ``counted_by_ids``."""
        self.levels: list[list[int]] = []
        self.schema_names = schema.select(F.explode(F.array("property", "dom", "ran")).alias("name")).where("name IS NOT NULL")
        if facts is None:
            return
        names = facts.select(F.explode(F.array("subject", "object")).alias("name")).where("name IS NOT NULL").unionByName(self.schema_names)
        while self.clashes(self.checked(names)):
            pass

    def checked(self, names: DataFrame) -> DataFrame:
        """``(id, lo, hi)`` of each row of ``names(name)``, a second hash as both ``lo`` and ``hi``."""
        other = _check(F.col("name"))
        return names.select(self.id_of(F.col("name")).alias("id"), other.alias("lo"), other.alias("hi"))

    def clashes(self, checked: DataFrame) -> bool:
        """Whether names share ids; if so, these ids get another level."""
        clash = (checked.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                 .where("lo <> hi").select("id").limit(MAX_CLASHES + 1).toArrow()["id"].to_pylist())
        if clash and (len(self.levels) == MAX_LEVELS or len(clash) > MAX_CLASHES):
            raise RuntimeError("names share too many 64-bit ids")
        self.levels += [clash] if clash else []
        return bool(clash)

    def id_of(self, name: Column) -> Column:
        out = _hash(name, 0)
        for seed, clash in enumerate(self.levels, 1):
            out = F.when(out.isin(clash), _hash(name, seed)).otherwise(out)
        return F.when(name.isNotNull(), out)

    def encode(self, df: DataFrame, columns: Iterable[str], lists: Iterable[str] = ()) -> DataFrame:
        """``df`` with ids in place of the names in ``columns`` and in the array columns ``lists``."""
        own = {c: self.id_of(F.col(c)) for c in columns}
        own |= {c: F.transform(c, self.id_of) for c in lists}
        return df.select(*[own[c].alias(c) if c in own else c for c in df.columns])

    def facts(self, facts: DataFrame) -> DataFrame:
        return self.encode(facts.select("property", "subject", "object"), ("property", "subject", "object"))

    def schema(self, schema: DataFrame) -> DataFrame:
        return self.encode(schema.select("property", "dom", "ran"), ("property", "dom", "ran"))

    def rules(self, classified: DataFrame) -> DataFrame:
        return self.encode(classified, RULE_NAMES, CLASS_LISTS)

    def restore(self, df: DataFrame, names: DataFrame, columns: Iterable[str]) -> DataFrame:
        """``df`` with the names of ``names(property)`` back in place of their ids in ``columns`` (null stays null)."""
        n = names.select(self.id_of(F.col("property")).alias("_id"), F.col("property").alias("_name"))
        for c in columns:
            df = df.join(n, df[c] == n["_id"], "left").withColumn(c, F.col("_name")).drop("_id", "_name")
        return df


def counted_by_ids(facts: DataFrame, schema: DataFrame, count: Callable[..., DataFrame], ends: tuple[str, str]) -> tuple[NameIds, DataFrame, DataFrame]:
    """``(ids, counts, kept)`` from one pass over ``facts``: ``count`` of the facts by ids, and ``kept``, the persisted table behind it.

    ``count`` groups typed facts with second hashes of their names in the halves of ``check``, in the order of the id columns ``ends``. Names
    that share an id make more groups, which the check finds on ``kept``; only then are the facts read again.
    """
    ids = NameIds(None, schema)
    while True:
        own = ids.encode(facts.select("*", _both(_check(F.col("subject")), _check(F.col("object"))).alias("check")), ("property", "subject", "object"))
        kept = count(own, ids.schema(schema)).persist(StorageLevel.MEMORY_AND_DISK)
        seen = kept.select(F.inline(F.array(*[F.struct(F.col(e).alias("id"), x.alias("lo"), x.alias("hi")) for e, x in zip(ends, _halves("check"), strict=True)])))
        if not ids.clashes(seen.where("id IS NOT NULL").unionByName(ids.checked(ids.schema_names))):
            return ids, kept.drop("check"), kept
        kept.unpersist()
