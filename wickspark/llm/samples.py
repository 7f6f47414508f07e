"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fitting(text: Column, longest: int) -> Column:
    """Whether a text can be learned from."""
    return F.coalesce(F.length(text) <= longest, F.lit(False))


def sample(rows: DataFrame, texts: DataFrame, label: str, per_label: int, longest: int) -> pd.DataFrame:
    """rows: doc_id and label. texts: doc_id, text. At most per_label rows of each label value, those whose ids have the
    smallest hashes, with their texts: text, label, by label and hash. rows should hold only ids that have a text of longest
    characters at most (see fitting): others take a place and give nothing."""
    hashed = rows.select("doc_id", label, F.xxhash64("doc_id").alias("_hash"))
    # what has a small hash: 4 x per_label rows of a label or all, give or take, so what is shuffled and meets in one task is bounded.
    # The driver sees a count for each label.
    counts = {r[0]: r[1] for r in hashed.groupBy(label).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "label": []})
    least = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (4.0 * per_label + 100) / n)])
    share = F.col("_hash").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    few = hashed.withColumn("_share", share).filter(F.col("_share") <= F.element_at(least, F.col(label)))
    order = W.partitionBy(label).orderBy("_share", "_hash", "doc_id")
    chosen = few.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= per_label)
    got = chosen.toPandas()
    ids = got["doc_id"].drop_duplicates().astype("int64").tolist()
    if not ids:
        return pd.DataFrame({"text": [], "label": []})
    found = texts.filter(F.col("doc_id").isin(ids) & fitting(F.col("text"), longest)).select("doc_id", "text").dropDuplicates(["doc_id"]).toPandas()
    both = got.drop_duplicates("doc_id").merge(found, on="doc_id").sort_values([label, "_hash", "doc_id"])
    return both.rename(columns={label: "label"})[["text", "label"]].reset_index(drop=True)
