"""A training-corpus pipeline over ``documents``: five stages, each one operator of ``hornbeam.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
``run`` writes as Parquet in the shared folder and reads again as the next stage's ``docs``. All but the last return the
columns of ``documents``. Decisions are made per ``doc_id``: a row whose id is null cannot be named by one and stays; if rows
share an id and any of them is to stay, all do. Extra columns of ``docs`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.bpe import encode
from hornbeam.llm.common import bitmap, cut, maybe_in, stored
from hornbeam.llm.exact_dedup import exact_duplicates
from hornbeam.llm.mixing import mix
from hornbeam.llm.ngram_join import jaccard_components
from hornbeam.llm.quality import resample

MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS = [3, 1, 2], 1.5, 2.0
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


DROP_BITS = 1 << 22


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` less the ids of which no row of ``decided (id, kept)`` is kept.

    A bitmap of the dropped ids (512 KB) lets most rows through in the scan; only rows it may hold, the dropped and
    a few others, are joined with the exact ids.
    """
    dropped = cut(decided.groupBy("id").agg(F.bool_or("kept").alias("kept")).where("NOT kept AND id IS NOT NULL")
                  .select("id", F.xxhash64("id").alias("h")))
    key = F.xxhash64(docs["doc_id"])
    maybe = F.coalesce(maybe_in(bitmap(dropped, "h", DROP_BITS), key, DROP_BITS), F.lit(False))
    asked = docs.where(maybe)
    return docs.where(~maybe).unionByName(asked.join(dropped.select("id"), asked["doc_id"] == dropped["id"], "left_anti"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled good; what it rejects goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    bad = labels.where("quality = 0").select(F.col("doc_id").alias("id"))
    return without(docs, resample(docs, good, bad_ids=bad).select("id", "kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; a row said again with its id and text goes too."""
    decided = exact_duplicates(docs)
    out = without(docs, decided.select("id", "kept"))
    again = cut(decided.groupBy("id").count().where("count > 1 AND id IS NOT NULL").select("id"))
    if again.isEmpty():
        return out
    here = F.col("doc_id") == again["id"]
    return out.join(again, here, "left_anti").unionByName(out.join(again, here, "left_semi").dropDuplicates(["doc_id", "text"]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, Jaccard 0.8) stays."""
    c = jaccard_components(docs, NEAR_SHINGLE, NEAR_PERCENT)
    return without(docs, c.select("id", F.col("id").eqNullSafe(F.col("component")).alias("kept")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it, or not at all."""
    taken = mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS).groupBy("id").agg(F.max("repeats").alias("repeats")).where("repeats > 0")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), taken["repeats"])).alias("__time")
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["id"])).select(*[docs[c] for c in docs.columns], each).drop("__time")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    import public_tokenizers
    e = encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return e.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                    F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing to target weights", mixing), ("BPE encoding", bpe)]

# trained models, near copies and tokenisers are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
