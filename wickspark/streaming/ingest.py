"""Structured Streaming forms of the two incremental jobs (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickspark.functions.pick import pick_row
from wickspark.model import BAR_SCHEMA
from wickspark.sources.bars import _Files, load_rank, upsert_bars


def ingest_bars_stream(spark: SparkSession, landing: str, store: str, checkpoint: str,
                       schema: T.StructType = BAR_SCHEMA, fmt: str = "parquet", max_files: int = 1000):
    """ST1: new bar files -> quality gate per file -> keep-last upsert; the newest file wins, by its time and then its name.

    max_files sets how much one micro-batch holds and not what is stored: the gate is per file, and stored rows keep the rank of
    their file. Each micro-batch rewrites only the months it touches, and writing the same batch twice gives the
    same store, so a replay after a failure does no harm.  The checkpoint is the resume point.  What is refused goes to
    `store`_rejected: load, code, reason, rows."""
    stream = (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(landing)
              .withColumn("_load", F.col("_metadata.file_path"))
              .withColumn("load_seq", load_rank(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"))))

    def merge(batch: DataFrame, batch_id: int) -> None:
        refused = upsert_bars(batch.sparkSession, store, batch, "load_seq", "_load")
        refused.withColumnRenamed("_load", "load").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store + "_rejected")

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_quotes(ticks: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """ST2: newest quote per code and window (of equal ts the one that `pick_row` says); state is dropped once the
    watermark passes the window.

    ticks: (code, ts, price, ...); works on a stream and on a table. Columns other than texts are picked into fixed-width buffers; a stream
    with texts besides code picks whole rows, the largest of equal ts, and sorts each batch for it."""
    source = (ticks.withWatermark("ts", late) if ticks.isStreaming else ticks).withColumn("_w", F.window("ts", every))
    rest = [c for c in ticks.columns if c != "code"]
    if ticks.isStreaming and any(c != "code" and kind in ("string", "binary") for c, kind in ticks.dtypes):
        newest = source.groupBy("code", "_w").agg(F.max(F.struct("ts", *[c for c in rest if c != "ts"])).alias("_r")).select("code", "_w", "_r.*")
    else:
        newest = pick_row(source, ("code", "_w"), F.unix_micros(F.col("ts").cast("timestamp")), F.max_by)
    return newest.select("code", F.col("_w.start").alias("window_start"), *rest)


def _versions(files: _Files, path: str) -> dict[int, str]:
    """Finished versions of a latest table, by batch."""
    found = (f for f in files.folders(path) if "/batch=" in f and files.exists(f"{f}/_SUCCESS"))
    return {int(f.rsplit("=", 1)[1]): f for f in found}


def newest_of(ticks: DataFrame) -> DataFrame:
    """ST2: the newest tick of each code (code, ts, ...), of equal ts the one that `pick_row` says. Ticks without ts are older than any."""
    return pick_row(ticks, ("code",), F.unix_micros(F.col("ts").cast("timestamp")), F.max_by)


def latest_table_stream(ticks: DataFrame, path: str, checkpoint: str):
    """ST2: keeps a table with the newest tick of each code ever seen, read by `read_latest`.

    Each micro-batch is picked down to a row per code, met with the table as the batch before left it, and written as a version of its own.
    The stream holds no state, so nothing is too late, and the table is what `newest_of` makes of all ticks however they are dealt
    to batches. A batch that is repeated after a failure starts from the same version and writes the same rows; a version counts once
    it is finished. The table has a row for each code, whatever the number of ticks; the last two versions are kept."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = _Files(spark, path)
        done = _versions(files, path)
        earlier = sorted(b for b in done if b < batch_id)
        rows = spark.read.schema(batch.schema).parquet(done[earlier[-1]]).unionByName(batch) if earlier else batch
        newest_of(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
        for b in earlier[:-1]:
            files.remove(done[b])

    return ticks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """ST2: the newest finished version of a table that `latest_table_stream` keeps."""
    done = _versions(_Files(spark, path), path)
    if not done:
        raise ValueError(f"no finished version in {path}")
    return spark.read.parquet(done[max(done)])


def ticks_to_bars(ticks: DataFrame, every: str = "1 day") -> DataFrame:
    """Tumbling bars from ticks (code, ts, price, seq), the first and last price by seq."""
    source = ticks.withWatermark("ts", "1 hour") if ticks.isStreaming else ticks
    return source.groupBy("code", F.window("ts", every).alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.count("*").alias("ticks")).select(
        "code", F.to_date("w.start").alias("trade_date"), "open", "high", "low", "close", "ticks")
