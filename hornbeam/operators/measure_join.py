"""Join measure (C5-C15, D7, D8, F5, F6): support = distinct joined rows.

For a rule ``r0 <= r1 ^ r2`` the literal definition joins the three property
tables on their shared classes and counts DISTINCT joined rows. On distinct
facts a DISTINCT over all joined columns is the join of the distinct tables, so
the count factorises over the join keys and no join fan-out is materialised:

=============  =====================================================================
pattern        support
=============  =====================================================================
P2             rows of pair(r0, r1) (facts held by both, aligned by class)
S1 / S2        sum over pair(r0, r1) rows of deg(r2, C, value at C)
S3             sum over pair(r0, r2) rows of deg(r1, C, value at C)
S5b            sum over pair(r1, r2) rows of deg(r0, C, value at C)
S4_star / S5a  sum over keys k of class K of deg(r0,K,k) * deg(r1,K,k) * deg(r2,K,k)
S4_triangle    rows of the three-way equi-join (no degree form); joined from the
               pivot class with the fewest wedges, computed from degrees first; where these
               are many, heavy pivot values in a grid of parts or from their closing edges
S6             body atoms unconnected: head-path / cross-product form from degrees
S7 / S8        0 (head not connected / nothing shared)
=============  =====================================================================

Confidence denominator (three atoms): sum over keys of deg(r1)*deg(r2) on
ran(r0) for S1, otherwise on the first class of c23 in r1's order; 0 for S6/S8.
Two atoms: the bag size of r1. Head coverage: support / bag size of r0.

Every request is reduced to a canonical key (unordered where the count is
symmetric) and computed once for all rules sharing it; all rules of all
patterns are scored by one plan. Supports grow with products of degrees (2.2 M
facts on one hub value give 1e19 for a star), so ``support`` and ``body_size`` stay
``decimal(38,0)`` up to the scores.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import passes, ratio4
from ..functions.sizing import MAX_BROADCAST_BYTES, materialize_small, row_bytes, spread_join
from . import facts as fx
from .candidates import CANDIDATE_COLUMNS
from .dealing import Heavy

DEC = "decimal(38,0)"
PAIR_PATTERNS = ("S1", "S2", "S3", "S5b")
STAR_PATTERNS = ("S4_star", "S5a")
SPREAD = 8  # parts of the rules that ask for one value
WEDGE_PART = 4096  # facts of an edge at one pivot value that meet the other edge in one cell
LIGHT = 2.0  # wedges for each fact of both edges up to which they are joined without reducing the edges first
CLOSING = 1 << 19  # closing facts that all tasks may know
TURN = 1.0  # wedges of a pivot value for each closing fact, from which it is joined along the closing edge


def _first(c: str) -> Column:
    return F.get(F.col(c), 0)


def _lookup(m: str, k: Column) -> Column:
    return F.try_element_at(F.col(m), k)


# --------------------------------------------------------------------------
# Building blocks
# --------------------------------------------------------------------------

class JoinContext:
    """Shared inputs of one scoring plan: fact sets, sides, degree maps, sizes.

    Fact sets and degree maps feed several branches (and the triangle pivot
    choice, which runs first), so they are persisted with disk spill; a lost
    block is recomputed from lineage; ``release`` frees them once the values are
    computed. ``small`` says that the rule table, and so every request table (at most
    a few rows for each rule), was measured to be small enough for a broadcast.
    """

    def __init__(self, facts: DataFrame, schema: DataFrame, props: DataFrame | None = None,
                 sizes: DataFrame | None = None, counts: DataFrame | None = None,
                 small: bool = True):
        self.small = small
        if counts is not None and "mask" in counts.columns:  # ``typed_sets``, which the caller keeps
            names, kind = fx.bit_names(schema), dict(schema.dtypes)["property"]
            self.fsets = fx.fact_sets_from_masks(counts, names, kind, set(names) if props is None else {r[0] for r in props.collect()})
        else:
            self.fsets = self.sets_of(fx.typed_counts(facts, schema) if counts is None else counts, props).persist(StorageLevel.MEMORY_AND_DISK)
        self.side = fx.sides(self.fsets)
        self.deg = fx.degrees(self.side)
        self.dmap = fx.degree_maps(self.deg).persist(StorageLevel.MEMORY_AND_DISK)
        self._heavy: Heavy | None = None
        self.bag_sizes = sizes if sizes is not None else fx.property_sizes(facts)

    def sets_of(self, counts: DataFrame, props: DataFrame | None) -> DataFrame:
        names = sorted(r[0] for r in props.limit(fx.MASK_BITS + 1).collect()) if props is not None else []
        if props is not None:
            bit = F.array_position(F.array(*[F.lit(x).cast(dict(props.dtypes)["property"]) for x in names[:fx.MASK_BITS]]), F.col("property"))
            props = props.select(F.col("property").alias("_p"), *[(bit - 1).cast("int").alias("bit")][:len(names)])
            counts = spread_join(counts, props, [("property", "_p")], ["v_lo", "v_hi"], self.small).drop("_p")
        few = 0 < len(names) <= fx.MASK_BITS
        return fx.fact_sets_from_bits(counts, names) if few else fx.fact_sets_from_counts(counts)

    def release(self) -> None:
        self.fsets.unpersist()
        self.dmap.unpersist()

    # -- distinct fact count per property
    def distinct_sizes(self) -> DataFrame:
        return fx.distinct_sizes(self.side)

    def _pair_rows(self, r: DataFrame) -> DataFrame:
        """Fact-set rows holding both ``x`` and ``y`` of each request in ``r``."""
        f = self.fsets.select(F.explode("props").alias("_x"), "props", "cls_lo", "cls_hi", "v_lo", "v_hi")
        return (spread_join(f, r, [("_x", "x")], ["v_lo", "v_hi"], self.small)
                .where(F.array_contains(F.col("props"), F.col("y"))))

    def pair_count(self, req: DataFrame) -> DataFrame:
        """``req(x, y)`` -> terms of value = number of facts x and y share (aligned)."""
        return self._pair_rows(req.select("x", "y").distinct()).select("x", "y", F.lit(1).cast(DEC).alias("value"))

    def pair_deg(self, req: DataFrame) -> DataFrame:
        """``req(x, y, C, z)`` -> terms of value = sum over pair(x, y) rows of deg(z, C, value at C).

        Pair rows are first counted per value at C (partial aggregation absorbs a
        hot value), then meet the degree map of that value once.
        """
        req = req.select("x", "y", "C", "z").distinct()
        r = req.select("x", "y", "C").distinct()
        k = (F.when(F.col("C") == F.col("cls_lo"), F.col("v_lo"))
             .when(F.col("C") == F.col("cls_hi"), F.col("v_hi")))
        pk = (self._pair_rows(r).groupBy("x", "y", "C", k.alias("k"))
              .agg(F.count(F.lit(1)).alias("cnt")))
        j = pk.join(self.dmap, (F.col("C") == F.col("cls")) & (F.col("k") == F.col("key")))
        q = req.toDF("_x", "_y", "_C", "z")
        j = spread_join(j, q, [("x", "_x"), ("y", "_y"), ("C", "_C")], ["k"], self.small)
        term = F.col("cnt").cast(DEC) * _lookup("m", F.col("z")).cast(DEC)
        return j.select("x", "y", "C", "z", term.alias("value"))

    def deg_products(self, req: DataFrame) -> DataFrame:
        """``req(a, b, c, K)`` -> terms of value = sum over keys k of class K of deg(a)*deg(b)[*deg(c)].

        ``c`` null gives the two-factor dot product. One pass over the degree
        maps serves every request: a key row meets only the requests whose
        first property holds it.
        """
        r = req.select("a", "b", "c", "K").distinct()
        d = self.dmap.select("cls", "key", "m", F.explode("m").alias("pa", "na"))
        j = spread_join(d, r, [("cls", "K"), ("pa", "a")], ["key"], self.small)
        nb = _lookup("m", F.col("b")).cast(DEC)
        nc = F.when(F.col("c").isNull(), F.lit(1).cast(DEC)).otherwise(
            _lookup("m", F.col("c")).cast(DEC))
        term = F.col("na").cast(DEC) * nb * nc
        return j.select("a", "b", "c", "K", term.alias("value"))

    # -- values with very many facts

    def heavy(self) -> Heavy:
        if self._heavy is None:
            total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, b: a + b)
            self._heavy = Heavy(self.dmap.select("cls", "key", total.alias("n")), ["cls", "key"])
        return self._heavy

    def with_degrees(self, rows: DataFrame, cls: str, key: str, by: str, name: str) -> DataFrame:
        """Inner join of fact rows with the degree map of ``(cls, key)`` as ``name``. The facts of a heavy value meet copies of its
        (small) map in parts, by their ``by`` value, so no value is one task."""
        at = self.heavy().deal(self.dmap, ["cls", "key"], None).select(
            F.col("cls").alias("_c"), F.col("key").alias("_k"), F.col("_part").alias("_p"), F.col("m").alias(name))
        r = self.heavy().deal(rows, [cls, key], [by])
        cond = (F.col(cls) == F.col("_c")) & (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p"))
        return r.join(at, cond).drop("_c", "_k", "_p", "_part")

    def head_path(self, req: DataFrame) -> DataFrame:
        """``req(h, K1, K2, p, q)`` -> terms of the sum over distinct facts of h of deg(p,K1,.)*deg(q,K2,.).

        The head's facts are read from the side of the class with more keys (the sum is the same from either), once for all requests over
        them; those of a heavy value are dealt into parts. Degrees met there are summed by the value at the other class before they travel, so
        that value is read once for each head and property, whatever its number of facts.
        """
        r = req.select("h", "K1", "K2", "p", "q").distinct()
        keys = self.dmap.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
        for c in ("K1", "K2"):
            r = r.join(keys.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}")), c, "left").fillna(0, [f"n_{c}"])
        turned = (F.col("n_K2") > F.col("n_K1")) | ((F.col("n_K2") == F.col("n_K1")) & (F.col("K2") < F.col("K1")))
        ways = (("C1", "K1", "K2"), ("C2", "K2", "K1"), ("a", "p", "q"), ("b", "q", "p"))
        plan = materialize_small(r.select("h", "K1", "K2", "p", "q", *[F.when(turned, F.col(y)).otherwise(F.col(x)).alias(c) for c, x, y in ways]))
        s = spread_join(self.side, plan.select("h", "C1", "C2").distinct(), [("property", "h"), ("cls", "C1")], ["key", "other"], self.small)
        s = s.select("h", "C1", "C2", F.col("key").alias("v1"), F.col("other").alias("v2"))
        j = self.with_degrees(s, "C1", "v1", "v2", "_m")
        first = plan.select(F.col("h").alias("_h"), F.col("C1").alias("_C1"), F.col("C2").alias("_C2"), "a").distinct()
        j = spread_join(j, first, [("h", "_h"), ("C1", "_C1"), ("C2", "_C2")], ["v1", "v2"], self.small)
        j = j.withColumn("n1", _lookup("_m", F.col("a"))).where("n1 IS NOT NULL")
        j = j.groupBy("h", "C1", "C2", "a", "v2").agg(F.sum(F.col("n1").cast(DEC)).alias("n1"))
        j = j.join(self.dmap, (F.col("C2") == F.col("cls")) & (F.col("v2") == F.col("key")))
        every = plan.select("K1", "K2", "p", "q", "b", *[F.col(c).alias(f"_{c}") for c in ("h", "C1", "C2", "a")])
        j = spread_join(j, every, [(c, f"_{c}") for c in ("h", "C1", "C2", "a")], ["v2"], self.small)
        term = F.col("n1").cast(DEC) * _lookup("m", F.col("b")).cast(DEC)
        return j.select("h", "K1", "K2", "p", "q", term.alias("value"))

    def triangles(self, req: DataFrame) -> DataFrame:
        """``req(e0, e1, e2, X, Y, Z)`` -> terms of value = rows of the three-way join.

        ``e0`` holds classes {X, Y}, ``e1`` {X, Z}, ``e2`` {Y, Z}; a request is canonical
        (``e0 < e1 < e2``), so each triangle is joined once for all rules over it. The wedge
        count of each pivot class is a degree dot product; the join runs from
        the pivot with the fewest wedges. Up to ``LIGHT`` wedges for each fact of both edges they are joined as they are (``few_wedges``), else
        the edges are reduced first (``many_wedges``).
        """
        keys = ["e0", "e1", "e2", "X", "Y", "Z"]
        req = materialize_small(req.select(*keys).distinct().withColumn("tid", F.monotonically_increasing_id()))
        plan = self.pivots(req).withColumn("few", F.col("wedges").cast("double") <= LIGHT * (F.col("na") + F.col("nb")))
        ways = [r["few"] for r in plan.select("few").distinct().collect()] or [True]
        closed = [(self.few_wedges if few else self.many_wedges)(plan.where(F.col("few") == few)) for few in ways]
        every = closed[0] if len(closed) == 1 else closed[0].unionByName(closed[1])
        counted = every.groupBy("tid").agg(F.count(F.lit(1)).cast(DEC).alias("value"))
        return req.join(counted, "tid").select(*keys, "value")

    def few_wedges(self, plan: DataFrame) -> DataFrame:
        """``(tid)`` of each closed wedge, for triangles whose wedges are about as many as the facts of their edges.

        The edge with more facts is exchanged once for all triangles that hold it at the pivot class, by the pivot value; its facts at
        a heavy value are dealt into parts, the other edge's copied. The closing facts are known to all tasks when they are at most ``CLOSING``.
        """
        ends = [("pa", "cu", "pb"), ("pb", "cw", "pa")]
        first, second = (F.struct(F.col(p).alias("bp"), F.col(c).alias("bc"), F.col(o).alias("sp")) for p, c, o in ends)
        plan = plan.select("tid", "P", "pc", "nc", F.when(F.col("na") >= F.col("nb"), first).otherwise(second).alias("way")).select("*", "way.*")
        groups = materialize_small(plan.select("bp", "P").distinct().withColumn("g", F.monotonically_increasing_id()))
        closing = materialize_small(plan.select("pc", "bc", "nc").distinct().withColumn("k", F.monotonically_increasing_id()))
        plan = plan.join(groups, ["bp", "P"]).join(closing.drop("nc"), ["pc", "bc"]).select("tid", "g", "k", "P", "sp")
        big = spread_join(self.side, groups, [("property", "bp"), ("cls", "P")], ["key", "other"], self.small).select(
            "g", "P", F.col("key").alias("pk"), F.col("other").alias("x"))
        small = spread_join(self.side, plan, [("property", "sp"), ("cls", "P")], ["key", "other"], self.small).select(
            "tid", "g", "k", "P", F.col("key").alias("pk"), F.col("other").alias("y"))
        big = self.heavy().deal(big, ["P", "pk"], ["x"]).drop("P")
        wedges = big.join(self.heavy().deal(small, ["P", "pk"], None).drop("P"), ["g", "pk", "_part"]).select("tid", "k", "x", "y")
        met = spread_join(self.side, closing.drop("nc"), [("property", "pc"), ("cls", "bc")], ["key", "other"], self.small).select(
            "k", F.col("key").alias("x"), F.col("other").alias("y"))
        known = (closing.agg(F.sum("nc")).first()[0] or 0) <= CLOSING
        return wedges.join(F.broadcast(met) if known else met, ["k", "x", "y"]).select("tid")

    def many_wedges(self, plan: DataFrame) -> DataFrame:
        """``(tid)`` of each closed wedge; both edges are reduced to facts that can meet (``edges``), and each pivot value is joined in the cheaper of two ways:

        * its wedges are closed by an exact match on the third property's facts (``grid``);
        * a value with more wedges than there are closing facts is joined along these instead: each first edge meets the
          closing facts at its far value, and the second edge closes. At most all closing facts are met for one such value.
        """
        a_rows, b_rows = self.edges(plan)
        c_rows = spread_join(self.side, plan, [("property", "pc"), ("cls", "cu")], ["key", "other"], self.small).select(
            "tid", "cu", F.col("key").alias("u"), F.col("other").alias("w"))
        turned = F.col("na").cast("double") * F.col("nb") > TURN * F.col("nc")
        a_grid, b_grid = self.grid(a_rows.where(~turned), b_rows.where(~turned))
        closed = a_grid.join(b_grid, ["tid", "pk", "i", "j"]).join(c_rows, ["tid", "u", "w"]).select("tid")
        # the first edges of a turned pivot meet the closing facts at u, dealt by w when u is heavy
        hub = self.heavy().deal(a_rows.where(turned).select("tid", "cu", "pk", "u"), ["cu", "u"], None)
        along = hub.join(self.heavy().deal(c_rows, ["cu", "u"], ["w"]), ["tid", "cu", "u", "_part"]).select("tid", "pk", "w")
        along = along.join(b_rows.where(turned).select("tid", "pk", "w"), ["tid", "pk", "w"]).select("tid")
        return closed.unionByName(along)

    def pivots(self, req: DataFrame) -> DataFrame:
        """The plan of each request: pivot class ``P``, edges ``pa`` and ``pb`` with far classes ``cu`` and ``cw``, closing property
        ``pc``, its number of facts ``nc``, those of the edges ``na`` and ``nb``, and the ``wedges``."""
        opts = [("X", "e0", "e1", "Y", "Z", "e2"),
                ("Y", "e0", "e2", "X", "Z", "e1"),
                ("Z", "e1", "e2", "X", "Y", "e0")]
        cands = req.select("tid", F.inline(F.array(*[F.struct(
            F.col(piv).alias("P"), F.col(a).alias("pa"), F.col(b).alias("pb"), F.col(ua).alias("cu"),
            F.col(ub).alias("cw"), F.col(c).alias("pc")) for piv, a, b, ua, ub, c in opts])))
        dots = self.deg_products(cands.select(F.col("pa").alias("a"), F.col("pb").alias("b"),
                                              F.lit(None).cast(dict(req.dtypes)["e0"]).alias("c"), F.col("P").alias("K")))
        dots = dots.groupBy("a", "b", "K").agg(F.sum("value").alias("value"))
        costed = cands.join(dots.select(F.col("a").alias("pa"), F.col("b").alias("pb"),
                                        F.col("K").alias("P"), F.col("value").alias("wedges")),
                            ["pa", "pb", "P"], "left")
        sizes = materialize_small(self.distinct_sizes())
        for p, n in (("pa", "na"), ("pb", "nb"), ("pc", "nc")):
            costed = costed.join(sizes.select(F.col("property").alias(p), F.col("n").alias(n)), p, "left").withColumn(n, F.coalesce(n, F.lit(0).cast("bigint")))
        # of pivots with as many wedges, the one with the fewest closing facts
        best = (costed.withColumn("wedges", F.coalesce("wedges", F.lit(0).cast(DEC))).groupBy("tid")
                .agg(F.min_by(F.struct("P", "pa", "pb", "cu", "cw", "pc", "wedges", "na", "nb", "nc"), F.struct("wedges", "nc")).alias("best"))
                .select("tid", "best.*"))
        return materialize_small(best)

    def edges(self, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Facts of both edges ``(tid, cu, nc, pk, u or w, na, nb)`` that the other edge meets at the pivot value ``pk`` and the closing
        property at the far value; ``na`` and ``nb`` are the facts of the edges at ``pk``, known to both sides alike."""
        def edge(p: str, far: str, far_class: str) -> DataFrame:
            rows = spread_join(self.side, plan, [("property", p), ("cls", "P")], ["key", "other"], self.small).select(
                "tid", "pa", "pb", "pc", "nc", "P", "cu", F.col("key").alias("pk"), F.col("other").alias(far), F.col(far_class).alias("_far"))
            rows = (self.with_degrees(rows, "P", "pk", far, "_m")
                    .withColumn("na", _lookup("_m", F.col("pa"))).withColumn("nb", _lookup("_m", F.col("pb")))
                    .where("na IS NOT NULL AND nb IS NOT NULL").drop("_m"))
            rows = self.with_degrees(rows, "_far", far, "pk", "_m").where(_lookup("_m", F.col("pc")).isNotNull())
            return rows.select("tid", "cu", "nc", "pk", far, "na", "nb")

        return edge("pa", "u", "cu"), edge("pb", "w", "cw")

    @staticmethod
    def grid(a_rows: DataFrame, b_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both edges of a pivot value dealt into a grid: ``i`` numbers the row parts of the first edge's facts, ``j`` the column parts of
        the second's, about ``WEDGE_PART`` facts each; each fact is in all cells of its row or column, so a cell reads two parts."""
        rows, columns = (F.ceil(F.col(n) / WEDGE_PART).cast("int") for n in ("na", "nb"))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        a = a_rows.select("tid", "pk", "u", F.pmod(F.xxhash64("u"), rows).cast("int").alias("i"), every(columns).alias("j"))
        b = b_rows.select("tid", "pk", "w", every(rows).alias("i"), F.pmod(F.xxhash64("w"), columns).cast("int").alias("j"))
        return a, b


# --------------------------------------------------------------------------
# Scoring
# --------------------------------------------------------------------------

REQUEST = ("kind", "k1", "k2", "k3", "k4", "k5", "k6")


def attach(asked: DataFrame, vals: DataFrame, rule: list[str], roles: tuple[str, ...], request: tuple[str, ...] = REQUEST) -> DataFrame:
    """One row per rule with the value of each role as ``v_<role>``, from its requests and the values of all requests.

    Requests are dealt by their whole key: a value that many rules ask for (a property's size) is copied to ``SPREAD`` parts.
    """
    v = vals.select(*[F.col(c).alias(f"_{c}") for c in request], "value").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.xxhash64(*rule), F.lit(SPREAD)).cast("int")
    cond = F.col("_part") == F.col("_copy")
    for c in request:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = asked.withColumn("_part", part).join(v, cond, "left")
    return met.groupBy(*rule).agg(*[F.max(F.when(F.col("role") == x, F.col("value"))).alias(f"v_{x}") for x in roles])


BOUNDS = ("bound0", "bound1", "bound2")


def may_pass(b: DataFrame, vals: DataFrame, ask, min_conf: float, min_hc: float) -> DataFrame:
    """The rules of ``b`` whose scores may reach both thresholds, by upper bounds of their supports.

    A bound holds for every graph, and rounding keeps order, so a rule that is left out could not pass:

    * pair patterns: a row of pair(x, y) with value v at C is a fact of x and of y, so the support is at most the degree product of x
      and z on C, and that of y and z;
    * triangles: at most the wedges of each of the three pivot classes;
    * two atoms: at most the size of either; stars: the support itself, which degrees give;
    * S6 has confidence 0, S7 and S8 support 0.
    """
    asked = b.select(*b.columns, F.inline(F.filter(F.array(
        ask("den", "dot", F.col("dK").isNotNull(), "da", "db", "", "dK"),
        ask("star", "dot", F.col("sa").isNotNull(), "sa", "sb", "sc", "sK"),
        *[ask(name, "dot", F.col(f"K_{name}").isNotNull(), f"a_{name}", f"b_{name}", "", f"K_{name}") for name in BOUNDS],
        ask("head", "size", F.lit(True), "head"), ask("body", "size", F.lit(True), "body1")), lambda x: x.isNotNull())))
    r = attach(asked, vals, b.columns, ("den", "star", "head", "body", *BOUNDS))
    pat = F.col("pattern")
    zero = F.lit(0).cast(DEC)
    met = {name: F.when(F.col(f"K_{name}").isNotNull(), F.coalesce(F.col(f"v_{name}"), zero)) for name in BOUNDS}
    upper = (F.when(pat == "P2", F.least("v_head", "v_body"))
             .when(pat.isin(*PAIR_PATTERNS) | (pat == "S4_triangle"), F.least(*met.values()))
             .when(pat.isin(*STAR_PATTERNS), F.coalesce(F.col("v_star"), zero)).otherwise(zero))
    body = F.when(F.col("body2").isNull(), F.col("v_body")).otherwise(F.col("v_den"))
    may = passes(ratio4(upper, body), ratio4(upper, F.col("v_head")), min_conf, min_hc)
    return r.where((pat == "S6") & (F.lit(min_conf) <= 0) | F.coalesce(may, F.lit(False))).select(*b.columns)


def score_join(facts: DataFrame, schema: DataFrame, classified: DataFrame,
               sizes: DataFrame | None = None, counts: DataFrame | None = None,
               thresholds: tuple[float, float] | None = None) -> DataFrame:
    """Score classified candidates with the join measure.

    Returns ``(head, body1, body2, pattern, support, body_size, head_size, conf,
    head_coverage)``; scores are rounded HALF_UP to 4 places, 0 on a 0 denominator.

    All request keys are computed once on the (schema-level) candidate table,
    which is persisted; every request table is a projection of it, so the plan
    grows linearly with the number of building blocks.

    With ``thresholds`` (least confidence and head coverage) rules that cannot reach them are left out before pairs and triangles
    are joined (``may_pass``); the rows of all others are the same.
    """
    cl = classified
    pj = F.col("pattern_join")
    three = F.col("body2").isNotNull()
    kind = dict(cl.dtypes)["head"]  # names, or their ids
    none = F.lit(None).cast(kind)

    # pair-based supports (S1, S2, S3, S5b): pair(x, y) against deg(z) on class C
    is_pair = pj.isin(*PAIR_PATTERNS)
    x_e = F.when(pj.isin("S1", "S2", "S3"), F.col("head")).otherwise(F.col("body1"))
    y_e = F.when(pj.isin("S1", "S2"), F.col("body1")).otherwise(F.col("body2"))
    c_e = (F.when(pj == "S1", F.get(F.col("d0"), 1)).when(pj == "S2", _first("c13"))
           .otherwise(_first("c12")))
    z_e = (F.when(pj.isin("S1", "S2"), F.col("body2")).when(pj == "S3", F.col("body1"))
           .otherwise(F.col("head")))
    # plain pair counts: P2, and S6 with a two-class overlap on one side
    s6_left2 = (pj == "S6") & (F.col("n12") == 2)
    s6_right2 = (pj == "S6") & (F.col("n13") == 2)
    cnt_need = (pj == "P2") | s6_left2 | s6_right2
    cx = F.when(s6_right2, F.col("body2")).otherwise(F.col("body1"))
    # degree products: stars, denominators, S6 one-class dots
    sorted3 = F.array_sort(F.array("head", "body1", "body2"))
    is_star = pj.isin(*STAR_PATTERNS)
    den_cls = (F.when(~three | pj.isin("S6", "S8"), none)
               .when(pj == "S1", F.get(F.col("d0"), 1)).otherwise(_first("c23")))
    s6_l1 = (pj == "S6") & (F.col("n12") == 1) & (F.col("n13") == 0)
    s6_r1 = (pj == "S6") & (F.col("n13") == 1) & (F.col("n12") == 0)
    o_other = F.when(s6_l1, F.col("body1")).otherwise(F.col("body2"))
    s6_path = (pj == "S6") & (F.col("n12") == 1) & (F.col("n13") == 1)
    tri = pj == "S4_triangle"

    # canonical triangle: the three atoms in order with the class each two share
    atoms = F.array_sort(F.array(*[F.struct(F.col(p).alias("p"), F.col(d).alias("d"))
                                   for p, d in (("head", "d0"), ("body1", "d1"), ("body2", "d2"))]))
    edge = lambda i: F.get(atoms, i)
    meet = lambda i, j: F.get(F.array_intersect(edge(i)["d"], edge(j)["d"]), 0)

    base = cl.select(
        *CANDIDATE_COLUMNS, pj.alias("pattern"),
        F.when(is_pair, F.least(x_e, y_e)).alias("px"), F.when(is_pair, F.greatest(x_e, y_e)).alias("py"),
        F.when(is_pair, c_e).alias("pC"), F.when(is_pair, z_e).alias("pz"),
        F.when(cnt_need, F.least("head", cx)).alias("cx"),
        F.when(cnt_need, F.greatest("head", cx)).alias("cy"),
        F.when(is_star, F.get(sorted3, 0)).alias("sa"), F.when(is_star, F.get(sorted3, 1)).alias("sb"),
        F.when(is_star, F.get(sorted3, 2)).alias("sc"), F.when(is_star, _first("c12")).alias("sK"),
        F.when(den_cls.isNotNull(), F.least("body1", "body2")).alias("da"),
        F.when(den_cls.isNotNull(), F.greatest("body1", "body2")).alias("db"), den_cls.alias("dK"),
        F.when(s6_l1 | s6_r1, F.least("head", o_other)).alias("oa"),
        F.when(s6_l1 | s6_r1, F.greatest("head", o_other)).alias("ob"),
        F.when(s6_l1, _first("c12")).when(s6_r1, _first("c13")).alias("oK"),
        F.when(s6_path, _first("c12")).alias("K12"), F.when(s6_path, _first("c13")).alias("K13"),
        *[F.when(tri, edge(i)["p"]).alias(f"e{i}") for i in range(3)],
        F.when(tri, meet(0, 1)).alias("X"), F.when(tri, meet(0, 2)).alias("Y"),
        F.when(tri, meet(1, 2)).alias("Z"),
        F.when(s6_left2 | s6_l1, F.col("body2")).when(s6_right2 | s6_r1, F.col("body1"))
        .alias("s6_third"),
        F.when(s6_path, F.lit("path")).when(s6_left2 | s6_right2, F.lit("pairx"))
        .when(s6_l1 | s6_r1, F.lit("dotx")).alias("s6_kind"),
    )
    # degree products that bound the support of a pair pattern or a triangle: two properties and the class on which they meet
    bounds = []
    for name, end, corner in zip(BOUNDS, ("px", "py", None), (("e0", "e1", "X"), ("e0", "e2", "Y"), ("e1", "e2", "Z")), strict=True):
        of_pair = (F.least(end, "pz"), F.greatest(end, "pz"), F.col("pC")) if end else (none, none, none)
        bounds += [F.when(F.col("px").isNotNull(), x).otherwise(F.col(t)).alias(f"{part}_{name}")
                   for part, x, t in zip("abK", of_pair, corner, strict=True)]
    base = base.select("*", *bounds) if thresholds is not None else base
    base = materialize_small(base)  # every request table below is a projection of it
    b = base

    def requests(rules: DataFrame):
        """One job tells which branches have requests and whether the rule table may be broadcast."""
        return rules.agg(*[F.count(c).alias(c) for c in ("px", "cx", "sa", "dK", "oK", "s6_third", "X")],
                         F.count(F.when(F.col("s6_kind") == "path", 1)).alias("path"), row_bytes(rules).alias("bytes")).first()

    has = requests(b)
    props = (b.select(F.explode(F.array("head", "body1", "body2")).alias("property"))
             .where(F.col("property").isNotNull()).distinct())
    ctx = JoinContext(facts, schema, props, sizes, counts, has["bytes"] <= MAX_BROADCAST_BYTES)

    def some(column: str, **names: str) -> DataFrame:
        return b.where(F.col(column).isNotNull()).select(*[F.col(v).alias(k) if v else none.alias(k) for k, v in names.items()])

    # what the branches have in common: a request is its kind and up to six keys, a term adds to its value
    def term(name: str, made: DataFrame, *keys: str) -> DataFrame:
        padded = [*[F.col(k) for k in keys], *[none] * (len(REQUEST) - 1 - len(keys))]
        return made.select(F.lit(name).alias(REQUEST[0]), *[c.alias(k) for c, k in zip(padded, REQUEST[1:], strict=True)],
                           F.col("value").cast(DEC).alias("value"))

    def summed(terms: list[DataFrame]) -> DataFrame:
        every = terms[0]
        for t in terms[1:]:
            every = every.unionByName(t)
        return materialize_small(every.groupBy(*REQUEST).agg(F.sum("value").alias("value")))  # one exchange of partial sums

    def from_degrees() -> list[DataFrame]:
        asked = [some("sa", a="sa", b="sb", c="sc", K="sK"), some("dK", a="da", b="db", c="", K="dK")]
        if thresholds is None or thresholds[0] <= 0:  # else S6 cannot pass
            asked.append(some("oK", a="oa", b="ob", c="", K="oK"))
        if thresholds is not None:
            asked += [some(f"K_{n}", a=f"a_{n}", b=f"b_{n}", c="", K=f"K_{n}") for n in BOUNDS]
        dots = asked[0]
        for x in asked[1:]:
            dots = dots.unionByName(x)
        out = [term("size", ctx.bag_sizes.withColumnRenamed("n", "value"), "property")]
        if has["sa"] + has["dK"] + has["oK"] + has["px"] + has["X"]:
            out.append(term("dot", ctx.deg_products(dots), "a", "b", "c", "K"))
        return out

    def from_facts() -> list[DataFrame]:
        out: list[DataFrame] = []
        if has["px"]:
            out.append(term("pair", ctx.pair_deg(some("px", x="px", y="py", C="pC", z="pz")), "x", "y", "C", "z"))
        if has["cx"]:
            out.append(term("count", ctx.pair_count(some("cx", x="cx", y="cy")), "x", "y"))
        if has["path"]:
            out.append(term("path", ctx.head_path(b.where(F.col("s6_kind") == "path").select(
                F.col("head").alias("h"), F.col("K12").alias("K1"), F.col("K13").alias("K2"),
                F.col("body1").alias("p"), F.col("body2").alias("q"))), "h", "K1", "K2", "p", "q"))
        if has["X"]:
            out.append(term("triangle", ctx.triangles(some("X", e0="e0", e1="e1", e2="e2", X="X", Y="Y", Z="Z")), "e0", "e1", "e2", "X", "Y", "Z"))
        if has["s6_third"]:
            out.append(term("facts", ctx.distinct_sizes().withColumnRenamed("n", "value"), "property"))
        return out

    def ask(role: str, name: str, when: Column, *keys: str) -> Column:
        padded = [*[F.col(k) if k else none for k in keys], *[none] * (len(REQUEST) - 1 - len(keys))]
        return F.when(when, F.struct(F.lit(role).alias("role"), F.lit(name).alias(REQUEST[0]),
                                     *[c.alias(k) for c, k in zip(padded, REQUEST[1:], strict=True)]))

    if thresholds is None:
        vals = summed([*from_degrees(), *from_facts()])
    else:
        vals = summed(from_degrees())
        b = materialize_small(may_pass(b, vals, ask, *thresholds))
        has = requests(b)
        rest = from_facts()
        vals = vals.unionByName(summed(rest)) if rest else vals
    ctx.release()

    path = F.coalesce(F.col("s6_kind") == "path", F.lit(False))
    asked = b.select(*CANDIDATE_COLUMNS, "pattern", "s6_kind", F.inline(F.filter(F.array(
        ask("pairdeg", "pair", F.col("px").isNotNull(), "px", "py", "pC", "pz"),
        ask("paircnt", "count", F.col("cx").isNotNull(), "cx", "cy"),
        ask("star", "dot", F.col("sa").isNotNull(), "sa", "sb", "sc", "sK"),
        ask("den", "dot", F.col("dK").isNotNull(), "da", "db", "", "dK"),
        ask("dot", "dot", F.col("oK").isNotNull(), "oa", "ob", "", "oK"),
        ask("path", "path", path, "head", "K12", "K13", "body1", "body2"),
        ask("tri", "triangle", F.col("X").isNotNull(), "e0", "e1", "e2", "X", "Y", "Z"),
        ask("third", "facts", F.col("s6_third").isNotNull(), "s6_third"),
        ask("head", "size", F.lit(True), "head"), ask("body", "size", F.lit(True), "body1")), lambda x: x.isNotNull())))
    r = attach(asked, vals, [*CANDIDATE_COLUMNS, "pattern", "s6_kind"], ("pairdeg", "paircnt", "star", "den", "dot", "path", "tri", "third", "head", "body"))

    pat = F.col("pattern")
    s6 = F.col("s6_kind")
    zero = F.lit(0).cast(DEC)
    s6_support = (F.when(s6 == "path", F.col("v_path"))
                  .when(s6 == "pairx", F.col("v_paircnt") * F.col("v_third"))
                  .when(s6 == "dotx", F.col("v_dot") * F.col("v_third")))
    support = (F.when(pat == "P2", F.col("v_paircnt"))
               .when(pat.isin(*PAIR_PATTERNS), F.col("v_pairdeg"))
               .when(pat.isin(*STAR_PATTERNS), F.col("v_star"))
               .when(pat == "S4_triangle", F.col("v_tri"))
               .when(pat == "S6", s6_support)
               .otherwise(zero))
    body = F.when(F.col("body2").isNull(), F.col("v_body")).otherwise(F.col("v_den"))
    out = r.select(*CANDIDATE_COLUMNS, "pattern",
                   F.coalesce(support, zero).cast(DEC).alias("support"),
                   F.coalesce(body, zero).cast(DEC).alias("body_size"),
                   F.coalesce(F.col("v_head"), zero).cast("bigint").alias("head_size"))
    return out.select("*", ratio4(F.col("support"), F.col("body_size")).alias("conf"),
                      ratio4(F.col("support"), F.col("head_size")).alias("head_coverage"))
