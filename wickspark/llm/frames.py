"""Small helpers on frames."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only where none is named, as in tests, a new local one."""
    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there: computed once however often it is used."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Spark removes the shuffle files of frames that the driver holds no more when the JVM collects its garbage: now."""
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long rows: from here on the session sends at most so many of them to Python at once. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def small_or_not(ids: DataFrame) -> DataFrame:
    """ids (a cut frame of narrow rows), broadcast if they are counted to be no more than SMALL_ROWS; else joined as Spark would."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The first bits of each `hash` (64-bit), as a bitmap of 2 ** bits bits whatever the number of rows; null ones are left out."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    words = hashes.filter("hash IS NOT NULL").select(F.shiftrightunsigned(at, 6).alias("at"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - bits}) & 63))").alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["at"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return out


def in_bitmap(hashes: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be one that the bitmap was made of."""
    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
