"""Ranked lexical search by branch and bound over a document FP-tree.

Documents are seen through the terms of the query items only (their restricted term vectors), most frequent term first. Sorted so,
vectors that begin alike share a path of a trie; the documents below a node are one range, in depth-first order. Each node
knows the largest tf of every term below it and the least m and doc_id: with these no document below can score more than
the node's bound. An item walks down the tree depth first, the child with the highest bound first, and leaves out nodes whose bound
can't reach its present 20th score. What is left are leaves of some documents, which are scored exactly.

Scale: a first pass over the texts makes the restricted vectors, which are cut (checkpointed), and counts df, N and L with
map-side sums. Trees are made of at most SHARD documents in the task that holds them, whatever the size of the table, and a
task keeps its best so far from tree to tree. It returns no more than k rows an item, merged by Spark. Items are taken in blocks of
some ITEM_WORDS words, by their number of words: only a block's terms and their df are ever on the driver or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickspark.llm.frames import cut, small_batches
from wickspark.llm.words import ALNUM, words_of

SHARD, LEAF, ITEM_WORDS = 8192, 64, 1_000_000
_VECTORS = "docs bigint, terms bigint, ids binary, sizes binary, counts binary, term binary, tf binary, df_term array<int>, df array<bigint>"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, n_words, hashes of the terms and how often each occurs. Of rows with one item_id the least text counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), ALNUM):
                found = [np.unique(words.hash[words.text(t)], return_counts=True) for t in range(words.count)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(words.first, words.count), pa.array(np.diff(words.bounds)),
                    pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))],
                    ["item_id", "n_words", "hash", "times"])

    one = items.filter("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "item_id bigint, n_words bigint, hash array<bigint>, times array<bigint>").filter("n_words > 0")


def _restricted(vocabulary):
    """Restricted vectors of a slice of documents; at the end of a task a row with its df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df = np.zeros(len(known), np.int64)
        kind = pa.schema([("docs", pa.int64()), ("terms", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "counts", "term", "tf")), ("df_term", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))])
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for words in words_of(batch.column(1), ALNUM):
                size = np.diff(words.bounds)
                at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
                hit = np.flatnonzero(known[at] == words.hash)
                pair, tf = np.unique(words.owner()[hit] * len(known) + at[hit], return_counts=True)
                doc, term = pair // len(known), pair % len(known)
                df += np.bincount(term, minlength=len(known))
                count = np.bincount(doc, minlength=words.count)
                some = np.flatnonzero(count)
                blobs = [x.tobytes() for x in (ids[words.first + some].astype(np.int64), size[some].astype(np.int64), count[some].astype(np.int32), term.astype(np.int32), tf.astype(np.int32))]
                yield pa.RecordBatch.from_pylist([{"docs": int((size > 0).sum()), "terms": int(size.sum())} | dict(zip(kind.names[2:7], blobs, strict=True))], kind)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pylist([{"docs": 0, "terms": 0, "df_term": held.tolist(), "df": df[held].tolist()}], kind)

    return run


@dataclass
class Tree:
    """Of node v: documents lo[v] ... hi[v] - 1 in the tree's order, children kids[v], least m and id below.

    Document p has terms at[p] ... at[p + 1] - 1 of term and tf. above has, by term, the nodes below which it occurs and its bound there."""

    order: np.ndarray
    lo: list[int]
    hi: list[int]
    kids: list[list[int]]
    depth: list[int]


def grown(at: np.ndarray, term: np.ndarray, leaf: int = LEAF) -> Tree:
    """The trie of vectors at[i] ... at[i + 1] - 1 of term, each in ascending order. Ranges of up to leaf documents aren't divided;
    neighbours that small share a node. A path that all documents below share is passed in one node."""
    n = len(at) - 1
    order, length = np.arange(n), np.diff(at)
    tree = Tree(order, [0], [n], [[]], [0])
    todo = [(0, 0)]
    while todo:
        node, level = todo.pop()
        a, b = tree.lo[node], tree.hi[node]
        if b - a <= leaf:
            continue
        docs = order[a:b]
        while True:
            more = length[docs] > level
            if not more.any():
                break
            follow = np.where(more, term[np.minimum(at[docs] + level, len(term) - 1)], -1)
            if follow.min() < follow.max():
                break
            level += 1
        if not more.any():
            continue  # equal vectors
        by = np.argsort(follow, kind="stable")
        order[a:b] = docs[by]
        edges = [0, *(np.flatnonzero(np.diff(follow[by])) + 1).tolist(), b - a]
        x = 0
        for y, after in zip(edges[1:], [*edges[2:], None], strict=True):
            if after is not None and after - x <= leaf:
                continue
            tree.lo.append(a + x)
            tree.hi.append(a + y)
            tree.kids.append([])
            tree.depth.append(tree.depth[node] + 1)
            tree.kids[node].append(len(tree.lo) - 1)
            todo.append((len(tree.lo) - 1, level + 1))
            x = y
    return tree


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _highest(node: np.ndarray, term: np.ndarray, tf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest tf of each pair of node and term."""
    key = node * width + term
    by = np.argsort(key, kind="stable")
    key = key[by]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[head] // width, key[head] % width, np.maximum.reduceat(tf[by], head) if len(head) else tf


class Shard:
    """Documents of one tree: ids, m, vectors by term number, where 0 is the most frequent term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, count: np.ndarray, term: np.ndarray, tf: np.ndarray, width: int, leaf: int = LEAF) -> None:
        owner = np.repeat(np.arange(len(ids)), count)
        by = np.argsort(owner * width + term, kind="stable")
        term, tf, at = term[by], tf[by].astype(np.int64), np.append(0, np.cumsum(count))
        self.tree = tree = grown(at, term, leaf)
        order, length = tree.order, np.diff(at)[tree.order]
        self.at = np.append(0, np.cumsum(length))
        take = np.repeat(at[order] - self.at[:-1], length) + np.arange(self.at[-1])
        self.ids, m, self.term, tf = ids[order], m[order], term[take], tf[take]
        self.gain = saturated(tf, np.repeat(m, length))
        self._bound(tf, m, width)

    def _bound(self, tf: np.ndarray, m: np.ndarray, width: int) -> None:
        tree = self.tree
        lo, hi, depth = np.array(tree.lo), np.array(tree.hi), np.array(tree.depth)
        parent = np.zeros(len(lo), np.int64)
        for v, kids in enumerate(tree.kids):
            parent[kids] = v
        leaves = np.array([v for v, kids in enumerate(tree.kids) if not kids])
        leaves = leaves[np.argsort(lo[leaves])]
        leaf_of = np.repeat(leaves, hi[leaves] - lo[leaves])
        found = [_highest(np.repeat(leaf_of, np.diff(self.at)), self.term, tf, width)]
        low_m, low_id = (np.full(len(lo), np.iinfo(np.int64).max) for _ in range(2))
        if len(lo):
            low_m[leaves], low_id[leaves] = np.minimum.reduceat(m, lo[leaves]), np.minimum.reduceat(self.ids, lo[leaves])
        rows, done = found[0], []
        for level in range(int(depth.max()), 0, -1):  # what holds below a node holds below its parent
            here = depth[rows[0]] == level
            done.append([x[here] for x in rows])
            up = [np.concatenate((x[~here], y[here])) for x, y in zip(rows, (parent[rows[0]], rows[1], rows[2]), strict=True)]
            rows = _highest(*up, width)
            v = np.flatnonzero(depth == level)
            np.minimum.at(low_m, parent[v], low_m[v])
            np.minimum.at(low_id, parent[v], low_id[v])
        node, term, most = (np.concatenate(x) for x in zip(*done, rows, strict=True))
        by = np.argsort(term, kind="stable")
        self.low_id = low_id
        self.above_node, self.above = node[by], saturated(most[by], low_m[node[by]])
        self.above_at = np.searchsorted(term[by], np.arange(width + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """best: scores and ids of the k best so far, best first; returned with the tree's documents in. dense: weight of every term."""
        a, b = self.above_at[terms], self.above_at[terms + 1]
        take = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange((b - a).sum())
        bound = np.zeros(len(self.tree.lo), np.int64)
        np.add.at(bound, self.above_node[take], self.above[take] * np.repeat(weights, b - a))
        score, ids = best
        todo = [0] if len(self.ids) else []
        while todo:
            v = todo.pop()
            if bound[v] <= 0 or (len(ids) == k and (bound[v] < score[-1] or (bound[v] == score[-1] and self.low_id[v] > ids[-1]))):
                continue
            kids = self.tree.kids[v]
            if kids:
                todo += sorted(kids, key=bound.__getitem__)
                continue
            x, y = self.tree.lo[v], self.tree.hi[v]
            e = slice(self.at[x], self.at[y])
            new = np.add.reduceat(dense[self.term[e]] * self.gain[e], self.at[x:y] - self.at[x])
            good = np.flatnonzero(new > 0) if len(ids) < k else np.flatnonzero((new > 0) & (new >= score[-1]))
            if len(good):
                score, ids = np.append(score, new[good]), np.append(ids, self.ids[x:y][good])
                first = np.lexsort((ids, -score))[:k]
                score, ids = score[first], ids[first]
        return score, ids


def _search(queries, shard: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        width = len(q["weight"])
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q["items"]]
        held: list[list[np.ndarray]] = []

        def meet() -> None:
            ids, size, count, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            m = 75 + (25 * size * q["docs"]) // q["terms"]
            docs = Shard(ids, m, count, q["number"][term].astype(np.int64), tf, width)
            dense = np.zeros(width, np.int64)
            for i, (terms, times) in enumerate(q["vectors"]):
                weights = q["weight"][terms] * times
                dense[terms] = weights
                best[i] = docs.search(terms, weights, dense, best[i], k)
                dense[terms] = 0

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("ids", "sizes", "counts", "term", "tf")), strict=True):
                part = [np.frombuffer(x.as_py(), t) for x, t in zip(row, ("i8", "i8", "i4", "i4", "i4"), strict=True)]
                cuts = np.append(0, np.cumsum(part[2]))
                for x in range(0, len(part[0]), shard):
                    y = min(x + shard, len(part[0]))
                    piece = [*(p[x:y] for p in part[:3]), *(p[cuts[x] : cuts[y]] for p in part[3:])]
                    if sum(len(h[0]) for h in held) + y - x > shard:
                        meet()
                    held.append(piece)
        if held:
            meet()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(q["items"], np.int64), [len(s) for s, _ in best])), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))],
            ["item_id", "doc_id", "score"])

    return run


def _ranked_block(docs: DataFrame, items: list, k: int, shard: int) -> DataFrame:
    """Best documents of some items: rows of item_terms()."""
    sc = docs.sparkSession.sparkContext
    known = np.unique(np.concatenate([np.array(r.hash, np.int64).view(np.uint64) for r in items]))
    scanned = cut(docs.mapInArrow(_restricted(sc.broadcast(known)), _VECTORS))
    total = scanned.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    df = np.zeros(len(known), np.int64)
    for row in scanned.select(F.explode(F.arrays_zip("df_term", "df")).alias("t")).groupBy("t.df_term").agg(F.sum("t.df").alias("df")).collect():
        df[row.df_term] = row.df
    frequent = np.argsort(-df, kind="stable")
    number = np.empty(len(known), np.int64)
    number[frequent] = np.arange(len(known))
    n = total.docs or 0
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df[frequent].tolist()], np.int64)
    vectors = [(number[np.searchsorted(known, np.array(r.hash, np.int64).view(np.uint64))], np.array(r.times, np.int64)) for r in items]
    queries = {"items": [r.item_id for r in items], "vectors": vectors, "weight": weight, "number": number, "docs": n, "terms": max(total.terms or 0, 1)}
    return scanned.filter("ids IS NOT NULL").select("ids", "sizes", "counts", "term", "tf").mapInArrow(_search(sc.broadcast(queries), shard, k), "item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, shard: int = SHARD, item_words: int = ITEM_WORDS) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. Each item's k best documents with a score above 0: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters (A-Z as a-z), digits and everything beyond ASCII, compared by a 64-bit hash. The score is a saturated tf
    times an integer weight of the term, summed over the item's terms with repeats; equal scores go by doc_id. Documents and items without id take
    no part, and null or empty texts have no terms. Repeated documents are documents of their own and have ranks of their own; of several
    rows of an item the one with the least text counts. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = cut(item_terms(items))
    blocks = math.ceil((wanted.agg(F.sum("n_words")).first()[0] or 0) / item_words)
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        if rows:
            found = found.union(_ranked_block(plain, rows, k, shard))
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS gain FROM tf JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, sum(times * gain)::BIGINT AS score FROM q JOIN gains USING (term) GROUP BY item_id, doc_id HAVING sum(times * gain) > 0),
ranks AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20
"""
