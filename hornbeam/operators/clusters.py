"""Property clusters.

Properties are similar when their class sets for one *kind* are equal:

* ``domain_range``: the unordered set {domain, range},
* ``domain``: {domain},
* ``range``: {range}.

A similarity threshold of 0.5 on the Jaccard distance of sets of one or two
classes admits only distance 0, i.e. equal sets, so the default ``exact`` method
groups properties by their sorted class array: one aggregation, deterministic.
``minhash`` runs Spark ML's ``HashingTF`` + ``MinHashLSH.approxSimilarityJoin``
with the same parameters (20 features, 2 tables, threshold 0.5 by default); with
few features, bucket collisions merge unrelated class sets, as hashing does.
``signature`` gives the clusters of ``minhash`` without a pair table: by the same argument its pairs are
those with equal bucket sets (which share every MinHash value, so none is missed), so properties are grouped by the
bucket set of ``HashingTF``. One aggregation, at any number of features.

A cluster keeps only members that have facts and needs more than two of them
(``min_size`` = 3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("domain_range", "domain", "range")
METHODS = ("exact", "minhash", "signature")

# Similarity parameters of the hashing method.
NUM_FEATURES = 20
NUM_HASH_TABLES = 2
SIM_THRESHOLD = 0.5
MIN_CLUSTER_SIZE = 3


def class_key(schema: DataFrame, kind: str) -> DataFrame:
    """``(property, key)``: the sorted class array compared for this kind."""
    if kind == "domain_range":
        key = F.array_sort(F.array("dom", "ran"))
    elif kind == "domain":
        key = F.array("dom")
    elif kind == "range":
        key = F.array("ran")
    else:
        raise ValueError(f"unknown cluster kind {kind!r}; expected one of {KINDS}")
    return schema.select("property", key.alias("key"))


def bucket_key(schema: DataFrame, kind: str, num_features: int = NUM_FEATURES) -> DataFrame:
    """G1: ``(property, key)``: the sorted slots that ``HashingTF`` gives the classes compared for this kind.

    The vectors stay sparse: a key has at most two slots whatever ``num_features`` is.
    """
    from pyspark.ml.feature import HashingTF

    data = class_key(schema, kind).toDF("property", "values")
    feats = HashingTF(inputCol="values", outputCol="features", numFeatures=num_features).transform(data)
    vector = F.from_json(F.to_json(F.struct("features")), "features struct<indices:array<int>>")
    return feats.select("property", F.array_sort(vector["features"]["indices"]).alias("key"))


def properties_with_facts(facts_or_sizes: DataFrame) -> DataFrame:
    """``(property)`` of every property holding at least one fact."""
    return facts_or_sizes.select("property").distinct()


def similar_pairs(schema: DataFrame, kind: str, method: str = "exact",
                  num_features: int = NUM_FEATURES, num_tables: int = NUM_HASH_TABLES,
                  threshold: float = SIM_THRESHOLD, seed: int = 42) -> DataFrame:
    """Ordered pairs ``(kind, id1, id2)`` of distinct similar properties."""
    keys = class_key(schema, kind)
    if method == "exact":
        a = keys.toDF("id1", "key")
        b = keys.toDF("id2", "key")
        pairs = a.join(b, "key").where(F.col("id1") != F.col("id2")).select("id1", "id2")
    elif method == "minhash":
        pairs = _minhash_pairs(keys, num_features, num_tables, threshold, seed)
    else:
        raise ValueError(f"pairs come from method 'exact' or 'minhash', not {method!r}")
    return pairs.select(F.lit(kind).alias("kind"), "id1", "id2")


def _minhash_pairs(keys: DataFrame, num_features: int, num_tables: int, threshold: float,
                   seed: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF, MinHashLSH

    data = keys.toDF("id", "values")
    feats = HashingTF(inputCol="values", outputCol="features",
                      numFeatures=num_features).transform(data)                   # G1
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=num_tables,
                       seed=seed).fit(feats)                                       # G2
    joined = model.approxSimilarityJoin(feats, feats, threshold, distCol="dist")  # C3
    return (joined.where(F.col("datasetA.id").isNotNull() & F.col("datasetB.id").isNotNull()
                         & (F.col("datasetA.id") != F.col("datasetB.id")))        # B10
            .select(F.col("datasetA.id").alias("id1"), F.col("datasetB.id").alias("id2")))


def _signatures(schema: DataFrame, kind: str, num_features: int = NUM_FEATURES,
                threshold: float = SIM_THRESHOLD) -> DataFrame:
    if not 0 < threshold <= 0.5:
        raise ValueError("sets of one or two slots group by equality only for thresholds up to 0.5; use method 'minhash'")
    return bucket_key(schema, kind, num_features)


def cluster_properties(schema: DataFrame, with_facts: DataFrame, kind: str,
                       method: str = "exact", min_size: int = MIN_CLUSTER_SIZE,
                       **hash_params) -> DataFrame:
    """``(kind, cluster_id, properties)`` for one kind; members sorted, only with facts."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; expected one of {METHODS}")
    if method != "minhash":
        keys = class_key(schema, kind) if method == "exact" else _signatures(schema, kind, **hash_params)
        keyed = keys.join(with_facts, "property", "leftsemi")                      # C4
        grouped = (keyed.groupBy("key")
                   .agg(F.array_sort(F.collect_set("property")).alias("properties"))
                   .withColumn("cluster_id", F.concat_ws("|", F.col("key").cast("array<string>"))))
    else:
        pairs = similar_pairs(schema, kind, method, **hash_params)
        nb = (pairs.groupBy("id1")                                                  # D5
              .agg(F.array_sort(F.array_union(F.collect_set("id2"), F.array(F.col("id1"))))
                   .alias("nb")))
        grouped = (nb.join(with_facts.withColumnRenamed("property", "id1"), "id1", "leftsemi")
                   .groupBy("nb")                                                   # D6
                   .agg(F.array_sort(F.collect_set("id1")).alias("properties"))
                   .withColumn("cluster_id", F.concat_ws("|", "nb")))
    return (grouped.where(F.size("properties") >= min_size)                         # B11
            .select(F.lit(kind).alias("kind"), "cluster_id", "properties"))


def all_clusters(schema: DataFrame, with_facts: DataFrame, method: str = "exact",
                 kinds: tuple[str, ...] = KINDS, min_size: int = MIN_CLUSTER_SIZE,
                 **hash_params) -> DataFrame:
    """Union of the clusters of every kind."""
    out = None
    for k in kinds:
        c = cluster_properties(schema, with_facts, k, method, min_size, **hash_params)
        out = c if out is None else out.unionByName(c)
    return out
