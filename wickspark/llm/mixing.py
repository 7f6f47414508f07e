"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected to be taken target / size times. The expected copies are summed up along the source,
one offset per source is added, and a document is taken once for each integer that its step of the running sum passes. So
a document is taken floor or ceil of its expected copies, and a source's total follows the expectation everywhere along
the order. The order is by size, which makes the taken words (not only the number of documents) follow it.

Scale: the running sum is made of two parts, the rows before a block of a source and the row's place in its block. Blocks
are (source, size class, hash bucket), counted with map-side combine; only narrow rows (id, source, size) are shuffled, by
block, so a source with a third of all rows is spread over classes x buckets. What is ordered in one task is the list of
sources, and per source its list of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 64


def n_words(text: Column) -> Column:
    """Number of runs of anything but space, tab, LF, VT, FF and CR; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target.

    Sources in code point order, null last, get the weights in turn. Together they are to have share x all sizes, by
    weight; none gets more than cap x its size, and what it would have had above goes to the others by weight. That is:
    target = min(cap, level x weight) with one level for all. With sources ordered by cap / weight, the level is found at
    the first one that needs no cap. cap >= share, so there is one.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    full = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    choice = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("_weight", F.element_at(choice, F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_no", F.row_number().over(full))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(full.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()) - F.col("_capped")) / F.col("_rest"))
        .withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_no", "_level"))).over(W.partitionBy()))
        .withColumn("target", F.when(F.col("_no") < F.col("_first._no"), F.col("_cap")).otherwise(F.least("_cap", F.col("_first._level") * F.col("_weight"))))
        .select("source", "source_size", "target")
    )


def offset_of(source: Column, seed: str) -> Column:
    """The source's offset, from 0 to below 1: a hash of its name and the seed, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """All columns of docs (doc_id, text, source and others) with mix_size, mix_source_size, mix_target and mix_copies, a
    row for each row of docs.

    Null or empty texts have size 0; they get copies like others and no words. A null source is a source. Repeated rows
    are rows of their own; of fully equal rows it isn't said which is taken twice. A source of size 0 has target 0 and no copies. No rows: no rows.
    """
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int")
    bits = F.length(F.bin("mix_size"))
    rows = (
        docs.withColumn("mix_size", n_words(F.col("text")))
        # numbers up to 63, then 32 classes for each power of two
        .withColumn("_class", F.when(F.col("mix_size") < 64, F.col("mix_size")).otherwise(bits * 64 + F.expr("mix_size >> (length(bin(mix_size)) - 6)")))
        .withColumn("_bucket", F.pmod(digest, F.lit(buckets)))
    )
    blocks = rows.groupBy("source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("mix_size").alias("_words"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    order = W.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    known = placed.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("_source"), F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), "_before",
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        offset_of(F.col("b.source"), seed).alias("_offset"))
    place = F.row_number().over(W.partitionBy("source", "_class", "_bucket").orderBy("mix_size", "doc_id"))
    met = rows.withColumn("_place", place).join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    upto = F.floor((F.col("_before") + F.col("_place")) * rate + F.col("_offset"))
    below = F.floor((F.col("_before") + F.col("_place") - 1) * rate + F.col("_offset"))
    return met.withColumn("mix_copies", upto - below).select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return mix(docs, **how).filter("mix_copies > 0").withColumn("_copy", copies).select(*docs.columns)


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, size, CASE WHEN size < 64 THEN size ELSE length(bin(size)) * 64 + (size >> (length(bin(size)) - 6)) END AS class,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS BIGINT) % 64 AS bucket
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes),
levels AS (
  SELECT source, source_size, cap, weight, cap / weight AS ratio,
    row_number() OVER w AS no,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
cut AS (SELECT no AS first_no, level AS first_level FROM levels WHERE level <= ratio ORDER BY no LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN no < first_no THEN cap ELSE least(cap, first_level * weight) END AS target FROM levels, cut),
placed AS (
  SELECT r.doc_id, r.source, r.size, row_number() OVER (PARTITION BY r.source ORDER BY class, bucket, size, doc_id) AS place FROM rows r),
stepped AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.place, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce('s' || p.source, 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (floor(place * rate + shift) - floor((place - 1) * rate + shift))::BIGINT * size AS taken
FROM stepped
"""
