"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Three narrow passes over the text column, each shuffling only fixed-size keys:

1. byte length of every text, counted per length;
2. for texts whose length occurs twice or more, a hash of the first characters, counted
   per (length, prefix hash);
3. for texts whose (length, prefix) occurs twice or more, the SHA-256 of the full text.
   Only these rows are grouped by content.

What survived a pass reaches the next scan as a fixed-size bitmap (``common.bitmap``), so
texts are never shuffled and the later, exact steps decide. All expressions are Spark
built-ins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, maybe_in

SALTS = 8  # parts of a group when rows look up their group


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     prefix_chars: int = 256, bits: int = 1 << 20, digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256``.

    Texts are equal when their UTF-8 bytes are; of equal texts the row with the largest id
    stays. A null text counts as empty. ``sha256`` is set for rows that reached the full hash
    (every row with ``digest_all``). Rows that repeat an id and its text count in
    ``group_size`` and share their ``kept``; a null id is kept only when its whole group has
    null ids. Other columns are ignored. An empty table gives an empty result.

    ``bits`` sizes the two bitmaps (128 KB at the default); raise it with the number of
    distinct (length, prefix) groups that repeat, results do not depend on it.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("len", F.octet_length("t").cast("bigint"))

    by_length = t.groupBy("len").count().where("count > 1")
    lengths = bitmap(by_length, "len", bits)
    t = t.withColumn("in1", maybe_in(lengths, F.col("len"), bits))

    prefix = F.xxhash64(F.col("len"), F.substring("t", 1, prefix_chars))
    by_prefix = t.where("in1").select(prefix.alias("p")).groupBy("p").count().where("count > 1")
    prefixes = bitmap(by_prefix, "p", bits)
    survives = F.col("in1") & maybe_in(prefixes, prefix, bits)

    digest = F.unhex(F.sha2("t", 256))
    rows = cut(t.withColumn("full", survives).select(
        "id", "full", (digest if digest_all else F.when(F.col("full"), digest)).alias("sha")))

    full = rows.where("full")
    groups = (full.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
              .where("n > 1")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    grouped = (full.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
               .join(groups, ["sha", "salt"], "left")
               .select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                       F.coalesce("n", F.lit(1).cast("bigint")).alias("n"), "sha"))
    lone = rows.where("NOT full").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"), "sha")
    return grouped.unionByName(lone).select(
        "id", "keep_id", F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("sha256"))
