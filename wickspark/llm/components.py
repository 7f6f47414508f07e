"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.llm.frames import cut, released


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the least of u and all its v. The join's key is -u, which neither side is dealt by yet: so both sides are
    exchanged, and Spark's skew join can split the edges of a hub."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select((-F.col("u")).alias("k"), F.least("u", "m").alias("m"))
    return edges.withColumn("k", -F.col("u")).join(least, "k").select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). Returns node, component for each node of a link between two nodes: the smallest node it reaches.

    Each round: every node joins its larger neighbours to the least node it sees, then its smaller ones. It ends when the
    edges stay the same; each is then (node, least node). What the driver sees is a count and a checksum for each round. The files of a round
    aren't kept longer than the next one needs them.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        met = _with_least(large)
        edges = cut(met.select("u", F.col("m").alias("v")).union(met.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        del both, large, met
        released(edges.sparkSession)
