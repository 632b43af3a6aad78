"""Column-expression helpers (pyspark.sql.functions compositions, no UDFs)."""

from .scores import MIN_CONF, MIN_HEAD_COVERAGE, passes, ratio4
from .sizing import broadcast_if_small
from .text import NAMESPACE, double_text, iri, iri_col, local_name, render_atom

__all__ = ["MIN_CONF", "MIN_HEAD_COVERAGE", "NAMESPACE", "broadcast_if_small", "double_text",
           "iri", "iri_col", "local_name", "passes", "ratio4", "render_atom"]
