"""Given TPC-H-like tables -> bars, universe, positions and the other model tables.

A security is a supplier, its ticks are line items (unit price on the ship date), its bar is a
week.  Raw ticks are brought together by (supplier, week) with a rebalance hint before they are
combined: a supplier and week has few ticks in each part of the file, so a combine there holds nearly
a group per tick, as many as the part is large, and drops few.  AQE keeps the tasks after it at one
size and splits a large one, so a supplier or a week with a third of all ticks still arrives at the
aggregate's shuffle as one row per week and task.  The first and last price are picked by one packed
decimal key, so the aggregate stays a hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickspark.functions.codes import classify_board
from wickspark.functions.pick import computed_once
from wickspark.model import OVERSEAS_INDEXES

# Prefix and suffix of a made code by supplier number, so that every code class occurs.
PREFIXES = ("600", "601", "603", "605", "000", "001", "002", "003", "300", "301", "688", "000",
            "880", "399", "510", "511", "588", "159", "430", "830", "501", "160", "900", "200")
SUFFIXES = (".SH", ".SH", ".SH", ".SH", ".SZ", ".SZ", ".SZ", ".SZ", ".SZ", ".SZ", ".SH", ".SH",
            ".SH", ".SZ", ".SH", ".SH", ".SH", ".SZ", ".BJ", ".BJ", ".SH", ".SZ", ".SH", ".SZ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key: Column) -> Column:
    slot = (key % len(PREFIXES)).cast("int") + 1
    digits = key.cast("string")
    digits = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    made = F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), slot), digits,
                    F.element_at(F.array(*map(F.lit, SUFFIXES)), slot))
    overseas = F.array(*map(F.lit, OVERSEAS_INDEXES))
    return F.when(key < len(OVERSEAS_INDEXES), F.element_at(overseas, F.least(key, F.lit(4)).cast("int") + 1)
                  ).otherwise(made)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01"))
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(18,0)")
    seq = (day.cast("decimal(6,0)") * F.lit("1000000000000000000").cast("decimal(19,0)") + order)
    seq = seq * F.lit("1000000000000").cast("decimal(13,0)") + F.col("l_partkey").cast("decimal(12,0)")
    return li.select(
        "l_suppkey", "l_returnflag",
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"),
        # unit price folded into 100..110, so that consecutive bars move like a market's
        (F.lit(100.0) + F.col("l_extendedprice") / F.col("l_quantity") % 10).alias("price"),
        F.col("l_quantity").alias("qty"),
        seq.cast("decimal(38,0)").alias("seq"),
    )


def _ohlc(raw: DataFrame, *keys: str) -> DataFrame:
    # a column of its own: ticks dealt by the keys themselves would count as grouped, and a key with most of them could not be split
    dealt = raw.withColumn("_deal", F.pmod(F.xxhash64("l_suppkey", "trade_date", *keys), F.lit(1 << 16)).cast("int")).hint("rebalance", "_deal")
    return dealt.groupBy("l_suppkey", "trade_date", *keys).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("vol"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = computed_once(_ohlc(ticks(spark, sf_dir)), code=code_of(F.col("l_suppkey")))
    return rolled.select("code", "trade_date", "open", "high", "low", "close", "vol")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars as three overlapping sources (by return flag) with a priority."""
    rolled = computed_once(_ohlc(ticks(spark, sf_dir), "l_returnflag"), code=code_of(F.col("l_suppkey")))
    rank = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return rolled.select("code", "trade_date", "open", "high", "low", "close", "vol", F.col("l_returnflag").alias("source"), rank.alias("priority"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, area, board, total_mv; nation and region are fixed-size lookups (25 and 5 rows)."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    s = computed_once(s, code=code_of(F.col("s_suppkey")))
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
            .join(r, n.n_regionkey == r.r_regionkey, "left")
            .select("code", F.col("s_name").alias("name"), F.col("n_name").alias("area"),
                    F.col("r_name").alias("region"), classify_board(F.col("code")).alias("board"),
                    F.col("s_acctbal").alias("total_mv"), F.col("s_suppkey").alias("key")))
