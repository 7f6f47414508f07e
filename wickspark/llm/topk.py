"""Exact top-k search by inner product, exhaustive and term at a time.

Vectors are rows of integer weights; a term is a dimension, its postings the rows of a chunk of candidates with a weight there.
For each query row, the postings of each of its terms, times the query's weight, are added into a dense array of scores, one
place for each candidate of the chunk. A partition around the k-th score selects the best of the chunk; what chunks
select is merged by query.

Scale: every query meets every candidate, as the operator says; it does so in blocks. Queries are dealt into blocks and
candidates into chunks by hash, a block meets a chunk in one task, and a task holds one of each at a time. A pair sends k rows
for each query at most. Numbers of blocks and chunks follow the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, CHUNK, SCALE = 1024, 4096, 64


def weights_of(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale x component), component as double; null where the vector is null or has a component that is null, infinite or no number."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.when(~bad, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def select_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores (all if fewer), ties to the smaller id; in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    rest = k - len(above)
    return np.append(above, level if rest == len(level) else level[np.argsort(ids[level], kind="stable")[:rest]])


def accumulate(queries: list[np.ndarray], rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Scores of all rows for each query in turn; vectors of other lengths than each other count as padded by zeros."""
    width = max((len(r) for r in rows), default=0)
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    table = np.zeros((width, len(rows)), np.int64)
    for j, r in enumerate(rows):
        table[: len(r), j] = r
    for term in table:
        at = np.flatnonzero(term)
        # a list that most rows are on is kept with its gaps, so that it is added without an index
        postings.append((None, term) if 2 * len(at) > len(rows) else (at, term[at]))
    scores, added = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for query in queries:
        scores[:] = 0
        for t in np.flatnonzero(query[:width]).tolist():
            at, given = postings[t]
            if at is None:
                np.multiply(given, query[t], out=added)
                scores += added
            else:
                scores[at] += given * query[t]
        yield scores


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _pair(k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        asked, given = queries.combine_chunks(), rows.combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asked) and len(given):
            ids, names = given["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            vectors = lambda t: [v for c in t["weights"].chunks for v in _lists(c)]
            for name, scores in zip(names, accumulate(vectors(asked), vectors(given)), strict=True):
                at = select_best(scores, ids, k + 1)
                at = at[ids[at] != name] if name in ids[at] else at
                # a query that is among the candidates may stand several times among the best (repeated rows): then all others are looked at
                if len(at) < min(k, int((ids != name).sum())):
                    others = np.flatnonzero(ids != name)
                    at = others[select_best(scores[others], ids[others], k)]
                out.append((np.full(len(at), name), ids[at], scores[at].copy()))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by every; candidates all rows but those with the query's own id.
    Returns query_id, rank (from 1), vec_id, score: the k highest inner products (all, if fewer), ties to the smaller vec_id.

    Null vectors, vectors with a null, infinite or not-a-number component, and rows without vec_id take no part. Repeated rows of an id
    with equal vectors count once; with others, each counts as candidate, and as query they share their k places. No rows: no rows.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), weights_of(F.col("embedding")).alias("weights")).filter("vec_id IS NOT NULL AND weights IS NOT NULL").distinct()
    asked = usable.filter(F.col("vec_id") % every == 0)
    blocks, chunks = (max(1, -(-df.count() // size)) for df, size in ((asked, block), (usable, chunk)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("c", numbers(chunks))
    right = usable.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("b", numbers(blocks))
    best = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(_pair(k), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
