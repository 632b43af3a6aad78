"""Parquet fact store.

The store is one long table partitioned on disk by property, so reading a few
properties prunes every other directory. ``materialize`` is the reuse-or-create
step: with ``mode="ignore"`` an existing store is read as it is, with ``"reuse"`` after a
comparison of its content, otherwise it is (re)written. Paths must be on shared storage; ``store_path`` derives one from
the session's ``spark.checkpoint.dir``.

Beside the facts lies a **manifest** (``_manifest``, which Spark's readers of the store pass over): one row per property with
its number of facts and an order-free digest of them. It is written last, so a store is complete when its manifest is. Bag sizes
are read from it without a scan, and ``mode="reuse"`` refuses a store whose manifest differs from the facts at hand: two data
sets of one name cannot be taken for each other.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_name
from ..session import ensure_checkpoint_dir

MANIFEST = "_manifest"
MANIFEST_SCHEMA = "property string, n bigint, digest string"
FACT_SCHEMA = "subject string, object string, property string"  # stated, so an empty store reads and no property becomes a number
SHOWN = 5  # differing properties that an error names


def store_path(spark: SparkSession, name: str, unique: bool = False) -> str:
    """A path under the shared checkpoint folder (``unique`` adds a random suffix)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    suffix = f"-{uuid.uuid4().hex[:12]}" if unique else ""
    return f"{base}/hornbeam-store/{name}{suffix}"


def write_facts(facts: DataFrame, path: str, mode: str = "overwrite",
                max_records_per_file: int = 5_000_000) -> None:
    """A3: write ``facts`` partitioned by property.

    Rows are rebalanced by property first, so a property's rows lie in about as many files as their size asks for
    (not in one of every task); Spark splits the parts of a property that holds a third of all facts.
    """
    (facts.hint("rebalance", "property").sortWithinPartitions("property")
     .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("property").parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a store whose writes ended well (the success markers of the facts and of the manifest are there)."""
    base = path.rstrip("/")
    return _exists(spark, f"{base}/_SUCCESS") and _exists(spark, f"{base}/{MANIFEST}/_SUCCESS")


def manifest(facts: DataFrame) -> DataFrame:
    """``(property, n, digest)``: bag size and digest of each property's facts, whatever their order; one aggregation.

    The digest is a sum and an exclusive or of two 64-bit hashes of each fact. The sum counts repeated facts; nulls differ from
    empty names.
    """
    fact = [F.col("subject").isNull(), F.col("object").isNull(), F.col("subject"), F.col("object")]
    total = F.sum(F.xxhash64(*fact).cast("decimal(38,0)")).cast("string")
    odd = F.hex(F.bit_xor(F.xxhash64(F.lit(1), *fact)))
    return facts.groupBy("property").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("/", total, odd).alias("digest"))


def write_manifest(spark: SparkSession, path: str) -> None:
    """Write the manifest of the facts stored at ``path``, from these facts as they were stored."""
    manifest(read_facts(spark, path)).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(property, n, digest)`` of a complete store."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path.rstrip('/')}/{MANIFEST}")


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """D2 bag sizes ``(property, n)`` of a complete store, without a scan of its facts."""
    return read_manifest(spark, path).select("property", "n")


def differences(facts: DataFrame, path: str) -> DataFrame:
    """Properties whose facts differ between ``facts`` and the store: ``(property, n_here, n_stored)``, null where there are none."""
    here = manifest(facts).select(F.col("property").alias("_p"), F.col("n").alias("n_here"), F.col("digest").alias("_d"))
    kept = read_manifest(facts.sparkSession, path)
    both = here.join(kept, here["_p"].eqNullSafe(kept["property"]), "full").where(~F.col("_d").eqNullSafe(F.col("digest")))
    return both.select(F.coalesce("property", "_p").alias("property"), "n_here", F.col("n").alias("n_stored"))


def read_facts(spark: SparkSession, path: str, properties: list[str] | None = None) -> DataFrame:
    """A4: read the store; a property list becomes a partition filter (pruned directories)."""
    df = spark.read.schema(FACT_SCHEMA).parquet(path).select("property", "subject", "object")
    if properties is not None:
        df = df.where(F.col("property").isin(properties))
    return df


class StoreMismatch(ValueError):
    """A complete store holds other facts than those at hand."""


def materialize(facts: DataFrame, path: str, mode: str = "ignore") -> DataFrame:
    """A5: write unless a complete store exists (``mode`` "reuse" or "ignore"), then read it back.

    What a failed write left behind is no store: it is written again. "reuse" takes an existing store only if its manifest equals
    that of ``facts`` (one aggregation of them), else ``StoreMismatch`` is raised; "ignore" takes it unseen. Other modes are
    Spark's own and always write.
    """
    spark = facts.sparkSession
    if mode in ("ignore", "reuse") and is_complete(spark, path):
        other = differences(facts, path).orderBy("property").limit(SHOWN).collect() if mode == "reuse" else []
        if other:
            raise StoreMismatch(f"{path} holds other facts: " + ", ".join(
                f"{r['property']} {r['n_stored'] or 0} stored, {r['n_here'] or 0} here" for r in other))
        return read_facts(spark, path)
    write_facts(facts, path, mode="overwrite" if mode in ("ignore", "reuse") else mode)
    write_manifest(spark, path)
    return read_facts(spark, path)


def cache_facts(facts: DataFrame) -> DataFrame:
    """Keep the fact table in memory, spilling to disk; ``unpersist`` it when done."""
    return facts.persist(StorageLevel.MEMORY_AND_DISK)


def register_views(spark: SparkSession, facts: DataFrame, schema: DataFrame,
                   prefix: str = "") -> list[str]:
    """One temp view per typed property, columns named by class local name.

    The view list is schema-level (one row per property). Views are lazy
    projections of ``facts``; nothing is copied.
    """
    facts.createOrReplaceTempView(f"{prefix}facts")
    rows = schema.select("property", "name", local_name("dom").alias("d"),
                         local_name("ran").alias("r")).collect()
    names = []
    for row in rows:
        view = f"{prefix}{row['name']}"
        (facts.where(F.col("property") == row["property"])
         .select(F.col("subject").alias(row["d"]), F.col("object").alias(row["r"]))
         .createOrReplaceTempView(view))
        names.append(view)
    return names


def hash_partition(df: DataFrame, n: int | None, *cols: str) -> DataFrame:
    """H3: hash partitioning on ``cols`` (``n`` None leaves the count to AQE)."""
    return df.repartition(*cols) if n is None else df.repartition(n, *cols)


def range_partition(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """H1: range partitioning into ``n`` parts."""
    return df.repartitionByRange(n, *cols)
