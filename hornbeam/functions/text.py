"""Column expressions for IRIs, local names and rule text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of the knowledge graph built from the test tables.
NAMESPACE = "http://ex.org/kg#"


def iri(name: str) -> str:
    """Python-side IRI of a local name: ``<http://ex.org/kg#name>``."""
    return f"<{NAMESPACE}{name}>"


def iri_col(name: Column) -> Column:
    """Column-side IRI of a local-name column."""
    return F.concat(F.lit("<" + NAMESPACE), name, F.lit(">"))


def local_name(c: Column | str) -> Column:
    """Text after the first ``#`` up to the closing ``>`` (or the next ``#``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"#([^#>]*)", 1)


def render_atom(name: Column, dom: Column, ran: Column) -> Column:
    """``name(Dom,Ran)`` with class local names."""
    return F.concat(name, F.lit("("), local_name(dom), F.lit(","), local_name(ran), F.lit(")"))


def double_text(c: Column) -> Column:
    """Double as Java prints it (``0.4``, ``2.0``, ``1.0E-4``)."""
    return c.cast("string")
