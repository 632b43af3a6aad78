"""Threshold, de-duplication and rendering of scored rules.

Three-atom rules that differ only by body order collapse when they also share
head, confidence and head coverage: the body is put in canonical order (larger
rendered atom first, the IRI breaking ties) and duplicates are dropped. Two-atom
rules are kept as they are. The result is a DataFrame; writing it is the
caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import MIN_CONF, MIN_HEAD_COVERAGE, passes
from ..functions.sizing import broadcast_if_small
from ..functions.text import double_text, render_atom

RULE_COLUMNS = ["head", "body1", "body2", "conf", "fitness", "rule"]


def apply_thresholds(scored: DataFrame, min_conf: float = MIN_CONF,
                     min_hc: float = MIN_HEAD_COVERAGE) -> DataFrame:
    """Keep rules with conf >= ``min_conf`` and head coverage >= ``min_hc`` (rounded values)."""
    return scored.where(passes(F.col("conf"), F.col("head_coverage"), min_conf, min_hc))


def with_atom_text(scored: DataFrame, schema: DataFrame) -> DataFrame:
    """Adds ``head_txt``, ``body1_txt``, ``body2_txt``: ``name(Dom,Ran)`` per atom."""
    s = broadcast_if_small(schema.select(
        "property", render_atom(F.col("name"), F.col("dom"), F.col("ran")).alias("txt")))
    return (scored.join(s.toDF("head", "head_txt"), "head", "left")
            .join(s.toDF("body1", "body1_txt"), "body1", "left")
            .join(s.toDF("body2", "body2_txt"), "body2", "left"))


def canonical_bodies(df: DataFrame) -> DataFrame:
    """put the larger body atom first (by rendered text, then IRI)."""
    swap = F.col("body2").isNotNull() & (
        (F.col("body1_txt") < F.col("body2_txt"))
        | ((F.col("body1_txt") == F.col("body2_txt")) & (F.col("body1") < F.col("body2"))))
    cols = []
    for a, b in (("body1", "body2"), ("body1_txt", "body2_txt")):
        cols += [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a),
                 F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b)]
    rest = [c for c in df.columns if c not in ("body1", "body2", "body1_txt", "body2_txt")]
    return df.select(*rest, *cols)


def dedupe(df: DataFrame) -> DataFrame:
    """Drop three-atom rules equal up to body order (same head, conf, fitness)."""
    c = canonical_bodies(df)
    return c.dropDuplicates(["head", "body1", "body2", "conf", "fitness"])


def render(df: DataFrame) -> DataFrame:
    """F8: ``h <= b1 ^ b2 conf fit`` (three atoms) or ``h <= b1 conf fit`` (two)."""
    scores = F.concat(F.lit(" "), double_text(F.col("conf")), F.lit(" "),
                      double_text(F.col("fitness")))
    text = F.when(F.col("body2").isNull(),
                  F.concat(F.col("head_txt"), F.lit(" <= "), F.col("body1_txt"), scores)) \
        .otherwise(F.concat(F.col("head_txt"), F.lit(" <= "), F.col("body1_txt"), F.lit(" ^ "),
                            F.col("body2_txt"), scores))
    return df.withColumn("rule", text)


def to_rules(scored: DataFrame, schema: DataFrame, min_conf: float = MIN_CONF,
             min_hc: float = MIN_HEAD_COVERAGE, drop_duplicates: bool = True) -> DataFrame:
    """Scored rules -> ``(head, body1, body2, conf, fitness, rule)``."""
    kept = apply_thresholds(scored, min_conf, min_hc).withColumnRenamed("head_coverage", "fitness")
    t = with_atom_text(kept, schema)
    t = dedupe(t) if drop_duplicates else canonical_bodies(t)
    return render(t).select(*RULE_COLUMNS)
