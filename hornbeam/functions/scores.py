"""Rule score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default thresholds on the rounded scores.
MIN_CONF = 0.1
MIN_HEAD_COVERAGE = 0.01
SCALE = 4


def ratio4(p: Column, q: Column, zero_as: float = 0.0) -> Column:
    """``p / q`` as a double rounded HALF_UP to 4 places; ``zero_as`` when ``q`` is 0.

    Spark's ``round`` on a double goes through the decimal text of the double,
    the same way a HALF_UP ``BigDecimal`` of the quotient does.
    """
    q = q.cast("double")
    return (F.when(q.isNull() | (q == 0), F.lit(zero_as))
            .otherwise(F.round(p.cast("double") / q, SCALE)))


def passes(conf: Column, hc: Column, min_conf: float = MIN_CONF,
           min_hc: float = MIN_HEAD_COVERAGE) -> Column:
    return (conf >= F.lit(min_conf)) & (hc >= F.lit(min_hc))
