"""Candidate rules and their shape.

A candidate is an ordered k-subset of a cluster: ``head <= body1 [^ body2]``.
The rules of a cluster are numbered and unranked by arithmetic, so the n(n-1)(n-2) rules of one large cluster are
made by as many tasks as there are partitions; the same rule coming from several clusters is kept once.

``classify`` attaches the class arrays ``d0, d1, d2`` (``[dom, ran]``), the
overlaps ``c12 = d0 ∩ d1``, ``c13 = d0 ∩ d2``, ``c23 = d1 ∩ d2`` (each in the order
of its first operand) and the pattern of each measure with the classes it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small, fits, materialize_small

CANDIDATE_COLUMNS = ["head", "body1", "body2"]
RANGE = 1 << 16  # rules that one row of a range table stands for


def ordered_subsets(clusters: DataFrame, k: int) -> DataFrame:
    """distinct ``(head, body1, body2)``; ``body2`` is null when ``k`` = 2.

    The subsets of a cluster of n properties are numbered, n(n-1) or n(n-1)(n-2) of them, and a number is unranked by
    arithmetic to the ranks of its atoms. Ranges of numbers are dealt to as many tasks as there are partitions, so one large
    cluster is made by all of them, and exchanges carry numbers only: (cluster, first number), then the rule as property numbers.
    """
    if k not in (2, 3):
        raise ValueError("rules have 2 or 3 atoms")
    spark = clusters.sparkSession
    members = materialize_small(clusters.select("properties").withColumn("cid", F.monotonically_increasing_id())
                                .select("cid", F.size("properties").cast("bigint").alias("n"), F.posexplode("properties").alias("rank", "property")))
    numbers = materialize_small(members.select("property").distinct().withColumn("pid", F.monotonically_increasing_id()))
    small = fits(members)
    ranks = members.join(F.broadcast(numbers) if small else numbers, "property").select("cid", F.col("rank").cast("bigint").alias("rank"), "pid")
    n = F.col("n")
    total = n * (n - 1) if k == 2 else n * (n - 1) * (n - 2)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    span = members.where("rank = 0").select("cid", "n", F.lit(0).cast("bigint").alias("lo"), total.alias("hi")).where("hi > 0")
    for step in (RANGE * RANGE, RANGE):  # a given number of partitions is not merged by their few bytes
        first = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(step).cast("bigint")))
        span = (span.select("cid", "n", "hi", first.alias("lo")).select("cid", "n", "lo", F.least("hi", F.col("lo") + step).alias("hi"))
                .repartition(parts, "cid", "lo"))
    rule = span.select("cid", "n", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("t"))
    if k == 2:
        rule = rule.select("cid", F.expr("t div (n - 1)").alias("head"), F.expr("t % (n - 1)").alias("body1"))
    else:
        rule = rule.select("cid", F.expr("t div ((n - 1) * (n - 2))").alias("head"), F.expr("t % ((n - 1) * (n - 2)) div (n - 2)").alias("body1"),
                           F.expr("t % (n - 2)").alias("body2"))
    # ranks among the properties that are left, to ranks among all
    rule = rule.withColumn("body1", F.expr("body1 + if(body1 >= head, 1, 0)"))
    atoms = CANDIDATE_COLUMNS[:k]
    if k == 3:
        rule = (rule.withColumn("body2", F.expr("body2 + if(body2 >= least(head, body1), 1, 0)"))
                .withColumn("body2", F.expr("body2 + if(body2 >= greatest(head, body1), 1, 0)")))
    for a in atoms:
        at = ranks.select(F.col("cid").alias("_cid"), F.col("rank").alias("_rank"), F.col("pid").alias(f"{a}_id"))
        at = F.broadcast(at) if small else at
        rule = rule.join(at, (F.col("cid") == F.col("_cid")) & (F.col(a) == F.col("_rank"))).drop("_cid", "_rank", a)
    rule = rule.select(*[f"{a}_id" for a in atoms]).distinct()
    for a in atoms:
        names = numbers.select(F.col("pid").alias(f"{a}_id"), F.col("property").alias(a))
        rule = rule.join(F.broadcast(names) if small else names, f"{a}_id")
    return rule.select("head", "body1", F.col("body2") if k == 3 else F.lit(None).cast("string").alias("body2"))


def connected_triples(schema: DataFrame) -> DataFrame:
    """Ordered triples of distinct properties in which every two atoms share a class.

    A user-supplied candidate table wider than clusters (it holds triangles,
    which clusters of equal class sets never form). Built with equi-joins on
    the shared class, so only connected atoms ever meet.
    """
    atoms = schema.select("property", F.explode(F.array("dom", "ran")).alias("cls"))
    edges = (atoms.toDF("p", "cls").join(atoms.toDF("q", "cls"), "cls")
             .where(F.col("p") != F.col("q")).select("p", "q").distinct())
    wedge = (edges.toDF("head", "body1").join(edges.toDF("head", "body2"), "head")
             .where(F.col("body1") != F.col("body2")))
    return wedge.join(edges.toDF("body1", "body2"), ["body1", "body2"], "leftsemi").select(
        "head", "body1", "body2")


def open_paths(schema: DataFrame) -> DataFrame:
    """Ordered triples where exactly two of the three atom pairs share a class.

    Their rules are not fully connected: bodies apart (S6) or the head apart
    from one body (S7). Built with equi-joins on shared classes and one
    anti-join.
    """
    atoms = schema.select("property", F.explode(F.array("dom", "ran")).alias("cls"))
    edges = (atoms.toDF("p", "cls").join(atoms.toDF("q", "cls"), "cls")
             .where(F.col("p") != F.col("q")).select("p", "q").distinct())
    # a path a - b - c with a and c apart; any atom may be the head
    path = (edges.toDF("a", "b").join(edges.toDF("b", "c"), "b")
            .where(F.col("a") != F.col("c"))
            .join(edges.toDF("a", "c"), ["a", "c"], "leftanti"))
    return (path.select(F.col("b").alias("head"), F.col("a").alias("body1"), F.col("c").alias("body2"))
            .unionByName(path.select(F.col("a").alias("head"), F.col("b").alias("body1"),
                                     F.col("c").alias("body2")))
            .unionByName(path.select(F.col("a").alias("head"), F.col("c").alias("body1"),
                                     F.col("b").alias("body2")))
            .distinct())


def atom_pairs(candidates: DataFrame) -> DataFrame:
    """Distinct ordered 2-combinations ``(p, q)`` of the atoms of each candidate."""
    c = candidates
    out = (c.select(F.col("head").alias("p"), F.col("body1").alias("q"))
           .unionByName(c.where(F.col("body2").isNotNull())
                        .select(F.col("head").alias("p"), F.col("body2").alias("q")))
           .unionByName(c.where(F.col("body2").isNotNull())
                        .select(F.col("body1").alias("p"), F.col("body2").alias("q"))))
    return out.distinct()


def _first(c: Column) -> Column:
    return F.get(c, 0)


def classify(candidates: DataFrame, schema: DataFrame) -> DataFrame:
    """Attach class arrays, overlaps and both measures' pattern and classes.

    Join measure (``pattern_join``), three atoms:

    * ``S1``  c12 and c13 both two classes; pair(head, body1) against body2 on ran(head)
    * ``S2``  c12 two, c13 one; pair(head, body1) against body2 on c13
    * ``S3``  c13 two, c12 one; pair(head, body2) against body1 on c12
    * ``S4_star`` / ``S5a``  one class common to all three: product of degrees
    * ``S4_triangle``  each pair shares a different class: counted 3-way join
    * ``S5b`` bodies share two classes, the head one, body condition on the other
    * ``S6``  bodies share no class (confidence 0); ``S7`` head not connected
      (support 0); ``S8`` nothing shared (support 0).

    Two atoms: ``P2`` when head and body share both classes, else ``P2_none``.

    Binding measure (``pattern_binding``): ``M1``, ``M2``, ``M3a``-``M3d``, ``M4``,
    ``M4_none``.
    """
    s = broadcast_if_small(schema.select("property", F.array("dom", "ran").alias("d")))
    c = (candidates.select(*CANDIDATE_COLUMNS)
         .join(s.toDF("head", "d0"), "head")
         .join(s.toDF("body1", "d1"), "body1")
         .join(s.toDF("body2", "d2"), "body2", "left")
         .where(F.col("body2").isNull() | F.col("d2").isNotNull()))  # untyped atoms drop the rule in any position
    three = F.col("body2").isNotNull()
    c = c.select(
        *CANDIDATE_COLUMNS, "d0", "d1", "d2",
        F.array_intersect("d0", "d1").alias("c12"),
        F.when(three, F.array_intersect("d0", "d2")).alias("c13"),
        F.when(three, F.array_intersect("d1", "d2")).alias("c23"))
    c = c.select("*", F.size("c12").alias("n12"),
                 F.when(three, F.size("c13")).alias("n13"),
                 F.when(three, F.size("c23")).alias("n23"),
                 F.when(three, F.array_intersect(F.array_intersect("c12", "c23"), "c13"))
                 .alias("c123"))
    n12, n13, n23 = F.col("n12"), F.col("n13"), F.col("n23")
    c12, c13, c23 = _first(F.col("c12")), _first(F.col("c13")), _first(F.col("c23"))

    pj = (F.when(~three, F.when(n12 == 2, "P2").otherwise("P2_none"))
          .when((n12 == 2) & (n13 == 2), "S1")
          .when(n23 == 0, F.when((n12 == 0) & (n13 == 0), "S8").otherwise("S6"))
          .when((n12 == 0) | (n13 == 0), "S7")
          .when(n12 == 2, "S2")
          .when(n13 == 2, "S3")
          .when(n23 == 1, F.when(c12 == c13, "S4_star").otherwise("S4_triangle"))
          .otherwise(F.when(_first(F.col("d1")) == c12, "S5a").otherwise("S5b")))
    pb = (F.when(~three, F.when(n12 > 0, "M4").otherwise("M4_none"))
          .when((n12 == 1) & (n13 == 1) & (n23 == 1), "M1")
          .when((n12 == 2) & (n13 == 2) & (n23 == 2), "M2")
          .when(F.size("c123") == 0, "M3d")
          .when(n12 == 2, "M3a")
          .when(n23 == 2, "M3b")
          .otherwise("M3c"))
    return c.withColumn("pattern_join", pj).withColumn("pattern_binding", pb)
