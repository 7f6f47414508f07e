"""Session for local runs and tests; on a cluster pass the session the platform gives you."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "wickspark", memory: str = "12g") -> SparkSession:
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, which driver and executors share. Only a local session may have a new one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
