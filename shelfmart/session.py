"""Session settings and the shared folder used for written tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles, picks broadcast joins from measured sizes and splits skewed join
# partitions; the forced form keeps splitting them even where that costs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Stored rows carry JSON text, which takes about half the room in this form.
    "spark.sql.parquet.compression.codec": "zstd",
    # Stored ids and repeated values take a few bytes a row in a file and some hundred in a broadcast, so that a join
    # is planned by the size its rows have in memory; a side that is shuffled is measured anyway.
    "spark.sql.sources.fileCompressionFactor": "32",
    # Every reading of a table lists its own folders, so that a listing kept for later on the driver is never asked for.
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Recursive queries end when a level adds nothing, after any number of rows.
    "spark.sql.cteRecursionRowLimit": "-1",
}


def build_session(app_name: str = "shelfmart", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a local session may fall back to a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="shelfmart-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
