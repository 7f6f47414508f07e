"""File jobs: CSV to Parquet with verification, performance tables, daily summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickspark.operators.metrics import keep_last


BAD_LINE = "bad_line"


def csv_to_parquet(spark: SparkSession, csv_paths: list[str] | str, out: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Convert, re-read and compare; one report row per input file: its lines, rows that were written, lines that don't parse.

    The files are parsed once. A line with a value that isn't of its column's type, or with more or fewer fields than the schema, is
    kept whole in `bad_line`, in a part of its own: `converted` reads the good rows, `refused_lines` the others. The source file travels as
    a column, so the check is one grouped count of what was written, against the lines of the files as plain text (blank lines and
    the header aside); a file is verified where both agree and the columns are those asked for. Folders are read with all below them;
    a file without any line has no report row. `bad_line`, `source_file` and `parsed` can't be columns of the files."""
    taken = {BAD_LINE, "source_file", "parsed"} & set(schema.names)
    if taken:
        raise ValueError(f"names taken by the report: {sorted(taken)}")
    source = F.col("_metadata.file_path").alias("source_file")
    whole = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    parsed = (spark.read.schema(whole).options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_LINE, recursiveFileLookup=True)
              .csv(csv_paths).select("*", source, F.col(BAD_LINE).isNull().alias("parsed")))
    parsed.write.mode("overwrite").partitionBy("parsed").parquet(out)
    back = spark.read.schema(parsed.schema).parquet(out)
    same_columns = set(spark.read.parquet(out).columns) == {*whole.names, "source_file", "parsed"}
    written = back.groupBy("source_file").agg(F.count_if("parsed").alias("parquet_rows"), F.count_if(~F.col("parsed")).alias("bad_lines"))
    text = spark.read.option("recursiveFileLookup", True).text(csv_paths).select("value", source)
    lines = text.groupBy("source_file").agg((F.count_if(F.col("value").rlike(r"[^\x00-\x20]")) - F.lit(int(header))).alias("csv_rows"))
    return lines.join(written, "source_file", "full").select(
        "source_file", F.coalesce("csv_rows", F.lit(0)).alias("csv_rows"), F.coalesce("parquet_rows", F.lit(0)).alias("parquet_rows"),
        F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"),
        (F.coalesce("csv_rows", F.lit(0)) == F.coalesce("parquet_rows", F.lit(0)) + F.coalesce("bad_lines", F.lit(0))).alias("_all"),
    ).select("source_file", "csv_rows", "parquet_rows", "bad_lines", (F.col("_all") & F.lit(same_columns)).alias("verified"))


def converted(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the files that parse, with their file."""
    return spark.read.parquet(out).filter(F.col("parsed").cast("boolean")).drop("parsed", BAD_LINE)


def refused_lines(spark: SparkSession, out: str) -> DataFrame:
    """The lines that don't parse, whole, with their file."""
    return spark.read.parquet(out).filter(~F.col("parsed").cast("boolean")).select("source_file", BAD_LINE)


def merged_performance(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows keyed (code, side, pattern); the new row wins."""
    both = new.withColumn("_s", F.lit(1))
    if stored is not None:
        both = stored.withColumn("_s", F.lit(0)).unionByName(both, allowMissingColumns=True)
    return keep_last(both, ["code", "side", "pattern"], "_s").drop("_s")


def write_performance(df: DataFrame, path: str) -> None:
    """One folder per side.  `df` must not read from `path` itself."""
    df.repartition("side", "code").write.mode("overwrite").partitionBy("side").parquet(path)


def read_performance(spark: SparkSession, path: str) -> DataFrame:
    """The stored tables, each row with the time at which its file was written, `loaded_at`."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_modification_time").alias("loaded_at"))


def daily_summary(signals: DataFrame) -> DataFrame:
    """One nested row per day and security; a day's document is the sorted rows of its folder.

    Nesting stops at the security (at most 118 signals a day), so no market-wide list is ever built."""
    item = F.struct("pattern", "side", *[c for c in ("close", "pct_chg", "win_rate", "return_pct", "trades", "tier")
                                         if c in signals.columns])
    return signals.groupBy("trade_date", "code").agg(
        F.count_if(F.col("side") == "buy").alias("buy_count"), F.count_if(F.col("side") == "sell").alias("sell_count"),
        F.sort_array(F.collect_list(item)).alias("signals"))


def write_summary(summary: DataFrame, path: str) -> None:
    """JSON lines, one folder per day; a day that is written again is replaced."""
    (summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("trade_date").json(path))
