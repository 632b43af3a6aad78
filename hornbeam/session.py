"""SparkSession helpers.

The library never creates its own session inside operators; callers pass one in.
``get_spark`` is only a convenience for tests, ``bench.py`` and local runs.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (broadcast
# conversion, partition coalescing, skew-join splitting). They are defaults in
# Spark 4, set explicitly so that a cluster profile cannot silently drop them.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small request tables are checkpointed; drop their files once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


LOCAL_SCRATCH = "/tmp/hornbeam-local"  # of local sessions without spark.checkpoint.dir


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "hornbeam") -> SparkSession:
    """Local session for tests / bench. On a cluster, build the session yourself."""
    master = master or os.environ.get("HORNBEAM_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("HORNBEAM_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in ADAPTIVE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    ``spark.checkpoint.dir`` names shared storage on a cluster and is respected as it is. Only a local
    session (tests, a laptop) may go without: its driver and executors are one process, and a folder below
    its warehouse serves them. Without a setting on a cluster this is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"{LOCAL_SCRATCH}/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
