"""Fact-level operators: vertical partitioning, sizes, sets, sides and degrees.

Data model (see README):

* ``facts(property, subject, object)`` is a *bag*; sizes (D2) count it as a bag.
* ``fact_sets(cls_lo, cls_hi, v_lo, v_hi, props)`` groups the distinct facts by
  their class-aligned identity: the two classes in sorted order and the value at
  each. Two properties with the same class pair share a row exactly when they
  hold the same fact, whatever their orientation (``p(A,B)`` and ``q(B,A)``).
  This is the one shuffle every rule measure starts from.
* ``sides(property, cls, key, other)``: two rows per distinct fact, one seen from
  each of its classes.
* ``degrees(property, cls, key, n)``: distinct ``other`` values per key.
* ``degree_maps(cls, key, m)``: for one typed key, the degree of every property
  holding it. Its size per key is bounded by the number of properties, so a hot
  key is still one small row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import fits, spread_join


def vertical_partition(facts: DataFrame) -> DataFrame:
    """The per-property bag, as ``(property, subject, object, n)`` with multiplicity ``n``."""
    return facts.groupBy("property", "subject", "object").agg(F.count(F.lit(1)).alias("n"))


def property_sizes(facts: DataFrame) -> DataFrame:
    """Bag size per property ``(property, n)``."""
    return facts.groupBy("property").agg(F.count(F.lit(1)).alias("n"))


def triple_sets(facts: DataFrame) -> DataFrame:
    """D3: distinct facts ``(property, subject, object)``."""
    return facts.select("property", "subject", "object").dropDuplicates()


def typed_facts(facts: DataFrame, schema: DataFrame, *more: str) -> DataFrame:
    """Facts of typed properties with their classes ``(property, dom, ran, subject, object)``, and the columns ``more``.

    The schema is property-level; it is broadcast only after its size is checked, else the facts of
    a property are spread over several parts.
    """
    sch = schema.select(F.col("property").alias("_p"), "dom", "ran")
    return spread_join(facts.select("property", "subject", "object", *more), sch, [("property", "_p")],
                       ["subject", "object"], fits(sch)).select("property", "dom", "ran", "subject", "object", *more)


CHECK = "check"  # second hashes of a fact's names in one number, beside their ids


def canonical(typed: DataFrame) -> DataFrame:
    """Class-aligned identity of each typed fact (narrow); the halves of ``CHECK`` are turned with the names."""
    lo_is_dom = F.col("dom") < F.col("ran")
    turned = F.shiftleft(CHECK, 32).bitwiseOR(F.shiftrightunsigned(CHECK, 32))
    return typed.select(
        "property",
        F.least("dom", "ran").alias("cls_lo"),
        F.greatest("dom", "ran").alias("cls_hi"),
        F.when(lo_is_dom, F.col("subject")).otherwise(F.col("object")).alias("v_lo"),
        F.when(lo_is_dom, F.col("object")).otherwise(F.col("subject")).alias("v_hi"),
        *[F.when(lo_is_dom, F.col(CHECK)).otherwise(turned).alias(CHECK)][:CHECK in typed.columns],
    )


def fact_sets(typed: DataFrame) -> DataFrame:
    """Distinct facts grouped by identity: ``(cls_lo, cls_hi, v_lo, v_hi, props)``.

    ``collect_set`` aggregates partially on the map side, so duplicates of a fact
    collapse before the shuffle; a group never holds more than one entry per
    property.
    """
    return (canonical(typed)
            .groupBy("cls_lo", "cls_hi", "v_lo", "v_hi")
            .agg(F.array_sort(F.collect_set("property")).alias("props")))


def typed_counts(facts: DataFrame, schema: DataFrame, checks: bool = False) -> DataFrame:
    """Distinct typed facts by identity with their bag multiplicity.

    ``(property, cls_lo, cls_hi, v_lo, v_hi, n)``: one pass over the facts gives
    both the bag sizes (``sizes_from_counts``) and the fact sets
    (``fact_sets_from_counts``). A plain hash aggregate with map-side combine. ``checks`` keeps ``CHECK`` too.
    """
    more = [CHECK][:checks]
    return (canonical(typed_facts(facts, schema, *more)).groupBy("property", "cls_lo", "cls_hi", "v_lo", "v_hi", *more)
            .agg(F.count(F.lit(1)).alias("n")))


def counted_facts(facts: DataFrame, schema: DataFrame, checks: bool = False) -> DataFrame:
    """Distinct typed facts in their own direction with their bag multiplicity:
    ``(property, dom, ran, subject, object, n)``, one pass with map-side combine. ``checks`` keeps ``CHECK`` too."""
    more = [CHECK][:checks]
    return (typed_facts(facts, schema, *more).groupBy("property", "dom", "ran", "subject", "object", *more)
            .agg(F.count(F.lit(1)).alias("n")))


def largest_objects(facts: DataFrame) -> DataFrame:
    """One object per subject (the largest by name) with the number ``n`` of its facts: ``(property, subject, object, n)``."""
    return facts.groupBy("property", "subject").agg(F.max("object").alias("object"), F.count(F.lit(1)).alias("n"))


MASK_BITS = 63  # properties whose sets fit in one number


def bit_names(schema: DataFrame) -> list | None:
    """Typed properties in order, whose places are the bits of a set; None when they are more than ``MASK_BITS``."""
    names = sorted(r[0] for r in schema.select("property").where("property IS NOT NULL").distinct().limit(MASK_BITS + 1).collect())
    return names if len(names) <= MASK_BITS else None


def typed_sets(facts: DataFrame, schema: DataFrame, names: list) -> DataFrame:
    """``fact_sets`` and bag sizes from one exchange: ``(cls_lo, cls_hi, v_lo, v_hi, check, mask, n)``, the property set of a fact as the
    bits of ``mask`` by ``names``. Bag sizes are the rows with ``mask`` 0, a property as ``cls_lo`` and its ``n``: each fact counts
    for its own row and for that of its property, which the map side keeps as one."""
    kind = dict(schema.dtypes)["property"]
    bit = (F.array_position(F.array(*[F.lit(x).cast(kind) for x in names]).cast(f"array<{kind}>"), F.col("property")) - 1).cast("int")
    c = canonical(typed_facts(facts, schema, CHECK)).withColumn("bit", bit)
    own = F.struct(*["cls_lo", "cls_hi", "v_lo", "v_hi", CHECK], F.expr("shiftleft(1L, bit)").alias("mask"))
    none = [F.lit(None).cast(dict(c.dtypes)[x]).alias(x) for x in ("cls_hi", "v_lo", "v_hi", CHECK)]
    size = F.struct(F.col("property").alias("cls_lo"), *none, F.lit(0).cast("bigint").alias("mask"))
    return (c.select(F.inline(F.array(own, size))).groupBy("cls_lo", "cls_hi", "v_lo", "v_hi", CHECK)
            .agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("n")))


def sizes_from_sets(sets: DataFrame) -> DataFrame:
    """D2 bag sizes ``(property, n)`` of typed properties, from ``typed_sets``."""
    return sets.where("mask = 0").select(F.col("cls_lo").alias("property"), "n")


def held(names: list, kind: str, wanted: set | None = None) -> Column:
    """The properties of ``mask``, in order; only those ``wanted``, if given."""
    return F.array_compact(F.array(*[F.when(F.getbit("mask", F.lit(i)) == 1, F.lit(p).cast(kind)) for i, p in enumerate(names)
                                     if wanted is None or p in wanted]))


def fact_sets_from_masks(sets: DataFrame, names: list, kind: str, wanted: set) -> DataFrame:
    """``fact_sets`` of the ``wanted`` properties from ``typed_sets``: rows as they are, nothing is exchanged."""
    bits = sum(1 << i for i, p in enumerate(names) if p in wanted)
    return (sets.where(F.col("mask").bitwiseAND(F.lit(bits).cast("bigint")) != 0)
            .select("cls_lo", "cls_hi", "v_lo", "v_hi", held(names, kind, wanted).alias("props")))


def sizes_from_counts(counts: DataFrame) -> DataFrame:
    """D2 bag sizes ``(property, n)`` of typed properties, from ``typed_counts``."""
    return counts.groupBy("property").agg(F.sum("n").cast("bigint").alias("n"))


def fact_sets_from_counts(counts: DataFrame) -> DataFrame:
    """``fact_sets`` from ``typed_counts`` (rows are already distinct per property)."""
    return (counts.groupBy("cls_lo", "cls_hi", "v_lo", "v_hi")
            .agg(F.array_sort(F.collect_list("property")).alias("props")))


def fact_sets_from_bits(counts: DataFrame, names: list) -> DataFrame:
    """``fact_sets_from_counts`` for rows with ``bit``, the place of their property in the sorted ``names`` (at most ``MASK_BITS``): a set
    travels as one number and is merged by a plain hash aggregate."""
    kind = dict(counts.dtypes)["property"]
    return (counts.groupBy("cls_lo", "cls_hi", "v_lo", "v_hi").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
            .select("cls_lo", "cls_hi", "v_lo", "v_hi", held(names, kind).alias("props")))


def sides(fsets: DataFrame) -> DataFrame:
    """Two rows per distinct fact: ``(property, cls, key, other)`` (narrow)."""
    return (fsets.select(F.explode("props").alias("property"), "cls_lo", "cls_hi", "v_lo", "v_hi")
            .select(F.inline(F.array(
                F.struct(F.col("property"), F.col("cls_lo").alias("cls"),
                         F.col("v_lo").alias("key"), F.col("v_hi").alias("other")),
                F.struct(F.col("property"), F.col("cls_hi").alias("cls"),
                         F.col("v_hi").alias("key"), F.col("v_lo").alias("other"))))))


def degrees(side: DataFrame) -> DataFrame:
    """Distinct partners per typed key: ``(property, cls, key, n)``."""
    return side.groupBy("property", "cls", "key").agg(F.count(F.lit(1)).alias("n"))


def degree_maps(deg: DataFrame) -> DataFrame:
    """``(cls, key, m map<property, n>)``: one row per typed key."""
    return deg.groupBy("cls", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("property", "n"))).alias("m"))


def distinct_sizes(side: DataFrame) -> DataFrame:
    """Distinct fact count per property ``(property, n)`` (each fact has one side per class)."""
    return (side.groupBy("property").agg(F.count(F.lit(1)).alias("n2"))
            .select("property", (F.col("n2") / 2).cast("bigint").alias("n")))
