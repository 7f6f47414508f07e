"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickspark.llm import decontamination, langid, mixing, neardup, secrets
from wickspark.llm.frames import checkpoint_dir, cut, small_or_not

SHINGLE, PERCENT = 5, 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own_names(stage: Stage) -> Stage:
    """The stage over documents whose further columns have names that no operator uses; they get their own back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"_user_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.select(*names).toDF(*docs.columns)

    return run


@_own_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and those without a letter go. Short and odd texts with letters stay.
    Where no language could be learned, all with a letter stay."""
    model = langid.learned(docs)
    if not model.languages:
        return docs.filter(langid.has_letters(F.col("text")))
    return langid.languages(docs, model=model).filter(F.col("lid_pred") != "und").select(*docs.columns)


@_own_names
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Rows without id all stay. An id with several rows is
    judged as one if they have one text, and one row stays then; with different texts one row of each stays, whatever they are alike to. What goes
    is decided on ids; the texts meet these in a broadcast join while there are no more than SMALL_ROWS."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"), SHINGLE, PERCENT).filter("doc_id IS NOT NULL")
    odd = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("stays")).filter("n > 1 OR NOT stays"))
    several = cut(odd.filter("n > 1").select("doc_id", "stays"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("kind"), F.struct(*docs.columns).alias("row")).join(small_or_not(several), "doc_id")
    texts = rows.groupBy("doc_id", "kind", "stays").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    chosen = texts.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("doc_id"))).filter("stays OR n > 1").select("row.*")
    return docs.join(small_or_not(odd.select("doc_id")), "doc_id", "left_anti").select(*docs.columns).unionByName(chosen)


@_own_names
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated. Rows without id are told apart by their text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63))))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs.select(key.alias("doc_id"), "text"), items)
    bad = cut(found.filter("contaminated").select(F.col("doc_id").alias("_row_key")).distinct())
    return docs.withColumn("_row_key", key).join(bad, "_row_key", "left_anti").select(*docs.columns)


@_own_names
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else F.lit(None)).select(*docs.columns)


@_own_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("mix", mix),
]

#: Trained models stand between documents and the rows: SQL can't say them. tests/llm compares with plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
