"""Property schema from domain / range declarations.

A property is typed when its domain classes followed by its range classes form
an ordered set of exactly two classes with no union expression; the first is its
domain, the last its range. Several declared domains are put in sorted order so
the result does not depend on shuffle order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_name

UNION_MARK = "ObjectUnionOf"


def class_sets(decls: DataFrame) -> DataFrame:
    """``(property, classes)``, the sorted distinct classes declared per property."""
    return decls.groupBy("property").agg(F.array_sort(F.collect_set("cls")).alias("classes"))


def schema_report(dom_decls: DataFrame, ran_decls: DataFrame) -> DataFrame:
    """Every property with both kinds of declaration, with ``kept`` and the drop reason."""
    d = class_sets(dom_decls).withColumnRenamed("classes", "doms")
    r = class_sets(ran_decls).withColumnRenamed("classes", "rans")
    j = d.join(r, "property")                                     # C1
    both = F.array_distinct(F.concat("doms", "rans"))              # E2
    has_union = F.exists(both, lambda x: x.contains(UNION_MARK))  # B8
    reason = (F.when(F.size(both) != 2, F.lit("class_count"))     # B7
              .when(has_union, F.lit("union")))
    return j.select(
        "property",
        local_name("property").alias("name"),
        F.element_at(both, 1).alias("dom"),                        # B9
        F.element_at(both, -1).alias("ran"),
        F.size(both).alias("n_classes"),
        reason.isNull().alias("kept"),
        reason.alias("reason"))


def property_schema(dom_decls: DataFrame, ran_decls: DataFrame) -> DataFrame:
    """Typed properties ``(property, name, dom, ran)``.

    ``dom_decls`` / ``ran_decls`` are ``(property, cls)`` rows (B3 split).
    """
    return (schema_report(dom_decls, ran_decls).where("kept")
            .select("property", "name", "dom", "ran"))


def class_overlap(pairs: DataFrame, schema: DataFrame) -> DataFrame:
    """``(p, q, classes)``: shared classes of two properties, in ``p``'s order."""
    s = schema.select("property", F.array("dom", "ran").alias("d"))
    return (pairs.join(s.toDF("p", "dp"), "p").join(s.toDF("q", "dq"), "q")
            .select("p", "q", F.array_intersect("dp", "dq").alias("classes")))
