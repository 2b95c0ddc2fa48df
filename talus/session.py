"""Session defaults: UTC, ANSI, adaptive plans, Arrow; sizes follow the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "talus", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Rows hold whole texts and images: Spark's 10,000 a batch is meant for narrow ones.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | conf
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    Where it is unset, a local session, whose driver is its only executor, gets one of its own; on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-talus-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")
