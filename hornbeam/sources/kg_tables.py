"""Typed facts derived from ordinary tables (the test-data binding).

Each property is a projection of one table (or a join of two); each source table
is scanned once and fans out to all the properties it feeds, so adding a
property never adds a scan. Only the columns a property needs are read
(parquet column pruning), and row conditions become ``when`` guards inside the
same projection.

Individuals carry a class prefix (``c12`` customer, ``n3`` nation, ...), so keys
of different classes never collide. Properties and classes are full IRIs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iri

# The property schema of the knowledge graph built from the test
# tables, as (property local name, domain class, range class).
PROPERTIES = [
    ("did_view", "User", "Hour"),
    ("did_click", "User", "Hour"),
    ("did_purchase", "User", "Hour"),
    ("did_signup", "User", "Hour"),
    ("did_error", "User", "Hour"),
    ("customerIn", "Customer", "Nation"),
    ("richCustomerIn", "Customer", "Nation"),
    ("homeOf", "Nation", "Customer"),
    ("supplierIn", "Supplier", "Nation"),
    ("orderFrom", "Order", "Nation"),
    ("buysFrom", "Customer", "Supplier"),
    ("inSegment", "Customer", "Segment"),
    ("usesPriority", "Customer", "Priority"),
    ("openPriority", "Customer", "Priority"),
    ("hasStatus", "Customer", "Status"),
]

# Event types that become ``did_<type>`` properties.
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]

FACT_COLUMNS = ["property", "subject", "object"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _key(prefix: str, c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), c.cast("string"))


def _fan_out(df: DataFrame, specs: list[tuple[str, Column, Column, Column | None]]) -> DataFrame:
    """One pass over ``df`` emitting a (property, subject, object) row per matching spec."""
    items = []
    for name, subj, obj, cond in specs:
        s = F.struct(F.lit(iri(name)).alias("property"), subj.alias("subject"), obj.alias("object"))
        items.append(s if cond is None else F.when(cond, s))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull() & x["subject"].isNotNull()
                   & x["object"].isNotNull())
    return df.select(F.inline(arr))


def facts_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fact bag ``(property, subject, object)`` of the test-table knowledge graph."""
    events = _read(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    customer = _read(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lineitem = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")

    did = (events.where(F.col("event_type").isin(EVENT_TYPES))
           .select(F.concat(F.lit("<http://ex.org/kg#did_"), F.col("event_type"), F.lit(">"))
                   .alias("property"),
                   _key("u", "user_id").alias("subject"),
                   _key("h", F.hour("ts")).alias("object"))
           .where(F.col("subject").isNotNull() & F.col("object").isNotNull()))

    cust = _fan_out(customer, [
        ("customerIn", _key("c", "c_custkey"), _key("n", "c_nationkey"), None),
        ("richCustomerIn", _key("c", "c_custkey"), _key("n", "c_nationkey"),
         F.col("c_acctbal") > 0),
        ("homeOf", _key("n", "c_nationkey"), _key("c", "c_custkey"), F.col("c_acctbal") > 3000),
        ("inSegment", _key("c", "c_custkey"), F.col("c_mktsegment"), None),
    ])
    supp = _fan_out(supplier, [
        ("supplierIn", _key("s", "s_suppkey"), _key("n", "s_nationkey"), None)])
    priority = F.regexp_replace("o_orderpriority", " ", "_")
    ords = _fan_out(orders, [
        ("usesPriority", _key("c", "o_custkey"), priority, None),
        ("openPriority", _key("c", "o_custkey"), priority, F.col("o_orderstatus") == "O"),
        ("hasStatus", _key("c", "o_custkey"), F.col("o_orderstatus"), None),
    ])
    order_from = (orders.select("o_orderkey", "o_custkey")
                  .join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"),
                        "o_custkey")
                  .select(F.lit(iri("orderFrom")).alias("property"),
                          _key("o", "o_orderkey").alias("subject"),
                          _key("n", "c_nationkey").alias("object")))
    buys_from = (lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"),
                               "l_orderkey")
                 .select(F.lit(iri("buysFrom")).alias("property"),
                         _key("c", "o_custkey").alias("subject"),
                         _key("s", "l_suppkey").alias("object")))
    parts = [did, cust, supp, ords,
             order_from.where(F.col("subject").isNotNull() & F.col("object").isNotNull()),
             buys_from.where(F.col("subject").isNotNull() & F.col("object").isNotNull())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_rows() -> list[tuple[str, str, str, str]]:
    """``(property IRI, local name, domain IRI, range IRI)`` for every table-derived property."""
    return [(iri(n), n, iri(d), iri(r)) for n, d, r in PROPERTIES]


def schema_from_tables(spark: SparkSession) -> DataFrame:
    """Property schema ``(property, name, dom, ran)`` of the table-derived graph."""
    return spark.createDataFrame(schema_rows(), "property string, name string, dom string, ran string")


def knowledge_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(facts, schema)`` of the table-derived graph."""
    return facts_from_tables(spark, sf_dir), schema_from_tables(spark)


# Declarations with no facts that typing must reject, as
# (property local name, axiom kind, class text): equal domain and range, a
# union range, and three classes.
EXTRA_DECLARATIONS = [
    ("knowsUser", "ObjectPropertyDomain", "<http://ex.org/kg#User>"),
    ("knowsUser", "ObjectPropertyRange", "<http://ex.org/kg#User>"),
    ("ownsAsset", "ObjectPropertyDomain", "<http://ex.org/kg#Customer>"),
    ("ownsAsset", "ObjectPropertyRange",
     "ObjectUnionOf(<http://ex.org/kg#Order> <http://ex.org/kg#Supplier>)"),
    ("visits", "ObjectPropertyDomain", "<http://ex.org/kg#User>"),
    ("visits", "ObjectPropertyDomain", "<http://ex.org/kg#Customer>"),
    ("visits", "ObjectPropertyRange", "<http://ex.org/kg#Hour>"),
]


def declaration_rows() -> list[tuple[str, str, str]]:
    """``(axiom_type, property IRI, class text)`` of every domain / range declaration."""
    rows = []
    for n, d, r in PROPERTIES:
        rows.append(("ObjectPropertyDomain", iri(n), iri(d)))
        rows.append(("ObjectPropertyRange", iri(n), iri(r)))
    rows += [(k, iri(n), c) for n, k, c in EXTRA_DECLARATIONS]
    return rows


def declarations_from_tables(spark: SparkSession) -> DataFrame:
    """Domain / range declarations ``(axiom_type, property, cls)`` of the graph."""
    return spark.createDataFrame(declaration_rows(), "axiom_type string, property string, cls string")
