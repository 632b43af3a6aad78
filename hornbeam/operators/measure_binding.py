"""Binding measure (C16, E4-E7, D9, F11): support = distinct variable bindings.

Notation: ``col_C(r)`` = distinct values of ``r`` at class ``C``; ``V`` = the
intersection of the ``col`` sets of the rule's atoms at their shared class;
``other_C(r, V)`` = distinct values at ``r``'s other class on rows whose value at
``C`` lies in ``V``. ``|r|`` = bag size.

=========  ===========================================  ================================
pattern    support                                      confidence denominator
=========  ===========================================  ================================
M1         |col_c12(r0) ∩ col_c23(r1) ∩ col_c13(r2)|     |col_c23(r1) ∩ col_c13(r2)|
M2         |other_X(r0,V) ∩ other_X(r1,V)|, X = ran(r0)  |col_X(r1) ∩ col_X(r2)|
M3a        |other_K(r0,V) ∩ other_K(r1,V)|               |col_K(r1) ∩ col_K(r2)|
M3b        |V|                                           same
M3c        |other_K(r0,V) ∩ other_K(r2,V)|               same
M3d        0 (no class common to all three)              1
M4         |other_K(r0,V) ∩ other_K(r1,V)|, K = c12[0]   |r1|
=========  ===========================================  ================================

K is the first class common to all three atoms, in the head's order. A 0
denominator counts as 1 for three atoms. Head coverage = support / |r0|.

Facts are regrouped twice, whatever the number of rules, and every fact-level exchange carries plain columns only:

* **Key sets.** A value (key) is held by a set of (property, class) pairs. Two order-free 64-bit hashes over its pairs name
  the set, so keys with one set share a name. The distinct sets form a dictionary with the number of keys of each, its pairs
  read from one representative key. ``V`` of a request is a containment test once per distinct set.
* **Entry sets.** Each fact gives its other value an entry (property, class, name of the key's set), as the number that a dictionary
  of the entries in requests gives it; entries that no request asks for are left out. Distinct entries of an ``other``
  value name its entry set in the same way, and a second dictionary counts the values of each. Whether a value lies in
  both ``other`` sets of a request is tested once per distinct entry set.

The facts of one hot key meet its set's name in parts (``dealing``); a hot ``other`` value is counted by its distinct entries, each an
exchange key of its own.

Requests are canonical (sorted members), computed once for all rules that share them, and
counted with partial aggregation: one row per request and task. Facts are read only from the classes at which some request looks
at their property. ``one_object_per_subject=True``
first keeps one object per subject (the largest), the single-valued view of
multi-valued properties.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ratio4
from ..functions.sizing import MAX_BROADCAST_BYTES, fits, materialize_small, row_bytes, spread_join
from . import facts as fx
from .candidates import CANDIDATE_COLUMNS
from .dealing import Heavy
from .measure_join import attach


def _first(c: str) -> Column:
    return F.get(F.col(c), 0)


def _member(p: Column, c: Column) -> Column:
    return F.struct(p.alias("p"), c.alias("c"))


def _named_sets(rows: DataFrame, key: str, entry: list[str], names: tuple[str, str], *more: Column) -> DataFrame:
    """``key`` with the name of the set of its distinct rows ``entry``: two order-free hashes, 128 bits together."""
    return rows.groupBy(key).agg(*[F.bit_xor(F.xxhash64(F.lit(seed), *entry)).alias(n) for seed, n in enumerate(names)], *more)


class BindingContext:
    """Dictionary of key sets, and entries of other values, from the distinct facts."""

    def __init__(self, facts: DataFrame, schema: DataFrame, props: DataFrame | None = None,
                 one_object_per_subject: bool = False, sizes: DataFrame | None = None,
                 counts: DataFrame | None = None, small: bool = True, asked: DataFrame | None = None):
        """``asked(p, c)`` are the properties and classes that requests look at; the facts are not read from their other sides."""
        own = counts if counts is not None else fx.counted_facts(facts, schema)
        if props is not None:
            own = spread_join(own, props.withColumnRenamed("property", "_p"), [("property", "_p")],
                              ["subject", "object"], small).drop("_p")
        if one_object_per_subject:
            own = (own.groupBy("property", "dom", "ran", "subject")
                   .agg(F.max("object").alias("object")))
        self.small = small
        self.side = own.select(F.inline(F.array(
            F.struct(F.col("property").alias("p"), F.col("dom").alias("c"),
                     F.col("subject").alias("key"), F.col("object").alias("other")),
            F.struct(F.col("property").alias("p"), F.col("ran").alias("c"),
                     F.col("object").alias("key"), F.col("subject").alias("other")))))
        if asked is not None:
            self.side = spread_join(self.side, asked.toDF("_p", "_c"), [("p", "_p"), ("c", "_c")], ["key", "other"], small).drop("_p", "_c")
        # Distinct values of each column, with the facts behind them (partial counts before the exchange)
        self.held = (self.side.groupBy("key", "p", "c").agg(F.count(F.lit(1)).alias("n"))
                     .persist(StorageLevel.MEMORY_AND_DISK))
        self.keys = (_named_sets(self.held, "key", ["p", "c"], ("s1", "s2"), F.sum("n").alias("n"))
                     .persist(StorageLevel.MEMORY_AND_DISK))
        self.sets = self._dictionary(self.keys, self.held, "key", ("s1", "s2")).groupBy("s1", "s2", "n").agg(
            F.collect_list(F.struct("p", "c")).alias("held")).persist(StorageLevel.MEMORY_AND_DISK)
        self.entries: DataFrame | None = None
        self.bag_sizes = sizes if sizes is not None else fx.property_sizes(facts)

    @staticmethod
    def _dictionary(named: DataFrame, rows: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
        """The rows of one representative key of each distinct set, with the set's name and the number ``n`` of its keys."""
        sets = named.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("_rep"))
        return rows.drop("n").join(sets, F.col(key) == F.col("_rep")).drop(key, "_rep")

    def release(self) -> None:
        for df in (self.held, self.keys, self.sets, self.entries):
            if df is not None:
                df.unpersist()

    def holding(self, req: DataFrame) -> DataFrame:
        """``(members, s1, s2, n)``: the sets that hold every member of a request, and their numbers of keys."""
        r = req.select("members").distinct().withColumn("first", F.get("members", 0))
        k = self.sets.select("s1", "s2", "n", "held", F.explode("held").alias("one"))
        return (spread_join(k, r, [("one", "first")], ["s1"], self.small)
                .where(F.size(F.array_except("members", "held")) == 0).select("members", "s1", "s2", "n"))

    def set_sizes(self, req: DataFrame) -> DataFrame:
        """``req(members)`` -> ``(members, value)``: number of keys held by every member."""
        return self.holding(req).groupBy("members").agg(F.sum("n").alias("value"))

    def other_sets(self, entries: DataFrame) -> DataFrame:
        """Dictionary of sets of ``entries(e, p, c, s1, s2)``: ``(o1, o2, n, e)``, one row per entry of a set that ``n`` other values have."""
        known = fits(entries)
        asked = entries.select(F.col("p").alias("_p"), F.col("c").alias("_c")).distinct()
        side = spread_join(self.side, asked, [("p", "_p"), ("c", "_c")], ["key", "other"], known).drop("_p", "_c")
        heavy = Heavy(self.keys.select("key", "n"), ["key"])
        names = heavy.deal(self.keys.drop("n"), ["key"], None)
        tagged = heavy.deal(side, ["key"], ["p", "c", "other"]).join(names, ["key", "_part"])
        same = entries.toDF("e", *[f"_{x}" for x in ("p", "c", "s1", "s2")])
        tagged = spread_join(tagged, same, [(x, f"_{x}") for x in ("p", "c", "s1", "s2")], ["other"], known)
        self.entries = tagged.select("other", "e").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        others = _named_sets(self.entries, "other", ["e"], ("o1", "o2"))
        return self._dictionary(others, self.entries, "other", ("o1", "o2"))

    def other_overlap(self, req: DataFrame) -> DataFrame:
        """``req(members, a, b, K)`` -> value = |other_K(a, V) ∩ other_K(b, V)|."""
        req = req.select("members", "a", "b", "K").distinct()
        asked = (self.holding(req).drop("n").join(req, "members")
                 .select("members", "a", "b", "K", "s1", "s2", F.explode(F.array_distinct(F.array("a", "b"))).alias("p"), F.col("K").alias("c")))
        entry = ["p", "c", "s1", "s2"]
        entries = materialize_small(asked.select(*entry).distinct().select(F.monotonically_increasing_id().alias("e"), *entry))
        met = self.other_sets(entries).join(asked.join(entries, entry).drop("c", "s1", "s2"), "e").groupBy("members", "a", "b", "K", "o1", "o2", "n").agg(
            F.max(F.col("p") == F.col("a")).alias("in_a"), F.max(F.col("p") == F.col("b")).alias("in_b"))
        return met.where("in_a AND in_b").groupBy("members", "a", "b", "K").agg(F.sum("n").alias("value"))


def score_binding(facts: DataFrame, schema: DataFrame, classified: DataFrame,
                  one_object_per_subject: bool = False, sizes: DataFrame | None = None,
                  counts: DataFrame | None = None) -> DataFrame:
    """Score classified candidates with the binding measure.

    Returns ``(head, body1, body2, pattern, support, body_size, head_size, conf,
    head_coverage)``.
    """
    cl = classified
    kind = dict(cl.dtypes)["head"]  # names, or their ids
    members_kind = f"array<struct<p:{kind},c:{kind}>>"
    pb = F.col("pattern_binding")
    h, b1, b2 = F.col("head"), F.col("body1"), F.col("body2")

    # class of each atom in V, and of the denominator set
    k_all = (F.when(pb == "M2", F.get(F.col("d0"), 1))
             .when(pb.isin("M3a", "M3b", "M3c"), _first("c123"))
             .when(pb == "M4", _first("c12")))
    k0 = F.when(pb == "M1", _first("c12")).otherwise(k_all)
    k1 = F.when(pb == "M1", _first("c23")).otherwise(k_all)
    k2 = F.when(pb == "M1", _first("c13")).otherwise(k_all)
    has_v = pb.isin("M1", "M2", "M3a", "M3b", "M3c", "M4")
    three = b2.isNotNull()
    members = F.when(has_v, F.when(three, F.array_sort(F.array(
        _member(h, k0), _member(b1, k1), _member(b2, k2))))
        .otherwise(F.array_sort(F.array(_member(h, k0), _member(b1, k1)))))
    den_members = F.when(has_v & three, F.array_sort(F.array(_member(b1, k1), _member(b2, k2))))
    oo = pb.isin("M2", "M3a", "M3c", "M4")
    oa = F.when(pb == "M3c", b2).otherwise(b1)
    base = cl.select(*CANDIDATE_COLUMNS, pb.alias("pattern"), members.alias("members"),
                     den_members.alias("den_members"),
                     F.when(oo, F.least(h, oa)).alias("oa"), F.when(oo, F.greatest(h, oa)).alias("ob"),
                     F.when(oo, k_all).alias("oK"))
    base = materialize_small(base)  # every request table below is a projection of it
    b = base
    has = b.agg(F.count("members").alias("members"), F.count("oa").alias("oa"), row_bytes(b).alias("bytes")).first()
    props = (b.select(F.explode(F.array("head", "body1", "body2")).alias("property"))
             .where(F.col("property").isNotNull()).distinct())
    looked_at = (b.select(F.explode(F.flatten(F.filter(F.array("members", "den_members"), lambda x: x.isNotNull()))).alias("m"))
                 .select("m.p", "m.c").where("p IS NOT NULL AND c IS NOT NULL").distinct())
    ctx = BindingContext(facts, schema, props, one_object_per_subject, sizes, counts,
                         has["bytes"] <= MAX_BROADCAST_BYTES, looked_at)
    pat = F.col("pattern")
    is_set = pat.isin("M1", "M3b")
    size_req = (b.where(is_set).select("members")
                .unionByName(b.where(F.col("den_members").isNotNull())
                             .select(F.col("den_members").alias("members"))))
    none = F.lit(None).cast(kind)
    asks_set, asks_overlap = has["members"], has["oa"]
    keys = ["kind", "members", "a", "b", "K"]
    vals = (ctx.bag_sizes.select(F.lit("size").alias("kind"), F.lit(None).cast(members_kind).alias("members"), F.col("property").alias("a"),
                                 none.alias("b"), none.alias("K"), F.col("n").alias("value")))
    if asks_set:
        vals = vals.unionByName(ctx.set_sizes(size_req).select(
            F.lit("set").alias("kind"), "members", none.alias("a"), none.alias("b"), none.alias("K"), "value"))
    if asks_overlap:
        vals = vals.unionByName(ctx.other_overlap(b.where(F.col("oa").isNotNull()).select(
            "members", F.col("oa").alias("a"), F.col("ob").alias("b"), F.col("oK").alias("K"))).select(F.lit("overlap").alias("kind"), *keys[1:], "value"))
    vals = materialize_small(vals)
    ctx.release()

    def ask(role: str, name: str, when: Column, members: str, *rest: str) -> Column:
        padded = [F.col(members) if members else F.lit(None).cast(members_kind), *[F.col(x) for x in rest], *[none] * (3 - len(rest))]
        return F.when(when, F.struct(F.lit(role).alias("role"), F.lit(name).alias("kind"),
                                     *[c.alias(k) for c, k in zip(padded, keys[1:], strict=True)]))

    asked = b.select(*CANDIDATE_COLUMNS, "pattern", F.col("oa").isNotNull().alias("overlaps"), F.inline(F.filter(F.array(
        ask("set", "set", is_set, "members"), ask("den", "set", F.col("den_members").isNotNull(), "den_members"),
        ask("oo", "overlap", F.col("oa").isNotNull(), "members", "oa", "ob", "oK"),
        ask("head", "size", F.lit(True), "", "head"), ask("body", "size", F.lit(True), "", "body1")), lambda x: x.isNotNull())))
    r = attach(asked, vals, [*CANDIDATE_COLUMNS, "pattern", "overlaps"], ("set", "den", "oo", "head", "body"), keys)
    three = F.col("body2").isNotNull()
    support = (F.when(is_set, F.col("v_set"))
               .when(F.col("overlaps"), F.col("v_oo")).otherwise(F.lit(0)))
    den = F.when(~three, F.col("v_body")).otherwise(F.col("v_den"))
    den = F.when(three & (F.coalesce(den, F.lit(0)) == 0), F.lit(1)).otherwise(den)
    out = r.select(*CANDIDATE_COLUMNS, "pattern",
                   F.coalesce(support, F.lit(0)).cast("bigint").alias("support"),
                   F.coalesce(den, F.lit(0)).cast("bigint").alias("body_size"),
                   F.coalesce(F.col("v_head"), F.lit(0)).cast("bigint").alias("head_size"))
    return out.select("*", ratio4(F.col("support"), F.col("body_size")).alias("conf"),
                      ratio4(F.col("support"), F.col("head_size")).alias("head_coverage"))
