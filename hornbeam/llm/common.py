"""Helpers shared by the operators of this subpackage.

Lineage is cut only with reliable ``checkpoint()`` or a Parquet table, both in the
shared folder that ``spark.checkpoint.dir`` names. Everything handed to the driver or to
all executors here has a size fixed by a parameter, never by the number of rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: Spark serves them a zip of its sources."""
    sc = spark.sparkContext
    if getattr(sc, "_hornbeam_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="hornbeam-"), "hornbeam_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._hornbeam_shipped = True


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps between tasks of one operator. Workers outlive a job, so the tables of other
    operators are dropped as soon as a task of this one starts."""
    others = [x for x in _CACHES if x != owner]
    for x in others:
        del _CACHES[x]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # hand freed memory back, where the C library can
            ctypes.CDLL(None).malloc_trim(0)
    return _CACHES.setdefault(owner, {})


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder (visible to every executor)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed Parquet table in the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more (only below the shared folder)."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(base + "/"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(seed: int, *cols: Column) -> Column:
    """Seeded 60-bit integer of the columns, the same in Spark and DuckDB (first 15 hex digits of MD5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def bitmap(keys: DataFrame, key: str, bits: int) -> Column:
    """A set of 64-bit keys as a bitmap of ``bits`` bits, for ``maybe_in``.

    The bitmap is one array of ``bits / 64`` longs whatever the number of keys, so handing
    it to all executors is bounded. It has no false negatives; false positives only let
    a row through to the next, exact step.
    """
    at = F.pmod(F.col(key), F.lit(bits))
    words = (keys.select(at.alias("at"))
             .select(F.floor(F.col("at") / 64).cast("bigint").alias("word"),
                     F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    dense = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    one = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x["bits"]).alias("bits"))
    return cut(one).scalar()


def maybe_in(bitmap_words: Column, key: Column, bits: int) -> Column:
    """True for every key of the bitmap (and for a few others)."""
    at = F.pmod(key, F.lit(bits))
    return F.getbit(F.get(bitmap_words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1


def numpy_bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """The same set for Python tasks: ``bits / 32`` words, collected word by word."""
    words = (keys.select(F.pmod(F.col(key), F.lit(bits)).alias("at"))
             .select(F.floor(F.col("at") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 32 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def numpy_maybe_in(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for every key (int64) of the bitmap, and for a few others."""
    at = keys % np.int64(len(words) * 32)
    return (words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star steps: each is a minimum per node (partial sums first) and a
    join back, and edges shrink towards one star per component in a logarithmic number of rounds.
    """
    e = cut(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m"))
        large = both.join(low, F.col("u") == F.col("at")).where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u"))
        e = cut(large.where("u <> v").distinct())
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m")
        small = e.join(low, F.col("u") == F.col("at")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
