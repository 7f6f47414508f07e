"""Near duplicates by MinHash: signatures, banding, verification on signatures and then on full sets, components.

A document is the set of its distinct SHINGLE-word shingles. Documents with equal sets are one node, with the smallest doc_id.
The signature holds HASHES minima under universal hash functions; nodes that agree in all ROWS minima of a band are in
one bucket. At a similarity of 0.8 a pair misses all 32 bands with probability 3e-6; that is the only approximation.

First, in every bucket, all nodes are paired with the node that meets most others in all buckets (a star, not all pairs): links are confirmed, components
formed. What may be missing are links between nodes of a bucket that are still in different components. So, second, buckets
with several components compare all their nodes, block by block, across components: pairs that agree in enough minima are
then confirmed on their sets, unless a link found before connects them, and the components are formed again. No pair of a bucket goes unseen, unless its nodes are already connected.

Scale: signatures are fixed-size. Buckets are counted with map-side combine. Stars make one pair for each node and band. Large
groups of near copies become one component at once and cost nothing in the second step. Blocks bound memory there. Full
sets are made only for nodes of pairs whose signatures are alike: a bitmap of their ids (2 ** BITS bits, however many) lets each task pick them
from the texts it scans, which are never shuffled; a full bitmap means more sets made, and the same result. Joins on hot keys have both sides exchanged, so Spark's skew join splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.llm.components import components
from wickspark.llm.frames import bitmap, cut, in_bitmap, released, small_batches
from wickspark.llm.words import LOWER_SPACED, Words, grams, mixed, signed, words_of

BANDS, ROWS, BLOCK, BITS = 32, 5, 2048, 27
HASHES = BANDS * ROWS
#: Pairs below this share of equal minima aren't confirmed: 5 standard deviations below 0.8.
LEAST_EQUAL = 0.8 - 5 * (0.8 * 0.2 / HASHES) ** 0.5
_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 40))
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in order, one text after the other, and where each text's begin. A text of
    fewer words, but not none, has one shingle: all of them."""
    hashes, whole = grams(words, size)
    lengths = np.diff(words.bounds)
    few = {int(n) for n in np.unique(lengths) if 0 < n < size}
    for n in few:
        at = words.bounds[:-1][lengths == n]
        hashes[at] = grams(words, n)[0][at]
        whole[at] = True
    parts = [np.unique(hashes[a:b][whole[a:b]]) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)


def signatures(sets: np.ndarray, bounds: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """A row for each set with the low 16 bits of its minima; bounds as from shingles(). Sets that are empty have rows that mean
    nothing. Different minima agree in them once in 65536."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(bounds[full], bounds[full[a]] + step)))
        lo, hi = bounds[full[a]], bounds[full[b - 1] + 1]
        part, starts = sets[lo:hi], bounds[full[a:b]] - lo
        for k in range(HASHES):
            out[full[a:b], k] = np.minimum.reduceat((part * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(16), starts) & np.uint64(0xFFFF)
        a = b
    return out


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(values))
    return total[bounds[1:]] - total[bounds[:-1]]


def _digests(sets: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two hashes of each whole set."""
    return pa.array(signed(_sum(mixed(sets), bounds))), pa.array(signed(_sum(mixed(sets ^ _OTHER), bounds)))


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), LOWER_SPACED):
                sets, bounds = shingles(words, size)
                rows = signatures(sets, bounds)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(words.first, words.count), pa.array(np.diff(bounds)), *_digests(sets, bounds), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "n", "d1", "d2", "minima"])

    return run


def _sets(size: int, asked):
    """Sets of the documents whose hashed id is in the bitmap asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = asked.value
        for batch in batches:
            some = batch.filter(pa.array(in_bitmap(batch.column("hash").to_numpy(), held, BITS)))
            for words in words_of(some.column(1), LOWER_SPACED):
                sets, bounds = shingles(words, size)
                blobs = [sets[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                digests = _digests(sets, bounds)
                yield pa.RecordBatch.from_arrays([some.column(0).slice(words.first, words.count), *digests, pa.array(blobs, pa.binary())], ["node", "d1", "d2", "members"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in enough minima."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in ("x", "y"))
        keep = (a == b).mean(axis=1) >= LEAST_EQUAL if len(a) else np.zeros(0, bool)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = _common(p, q)
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(p: np.ndarray, q: np.ndarray) -> int:
    return len(np.intersect1d(p, q, assume_unique=True))


class _Group:
    """Nodes of a bucket's block, or of two blocks."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        self.table = t = pa.Table.from_batches(rows)
        self.node, self.side, self.band, self.sizes = t["node"].to_numpy(), t["side"].to_numpy(), t["band"][0].as_py(), t["n"].to_numpy()
        self.two = t["i"][0].as_py() != t["j"][0].as_py()
        self.minima = np.frombuffer(b"".join(t["minima"].to_pylist()), np.uint16).reshape(-1, HASHES)
        _, self.group = np.unique(t["component"].to_numpy(), return_inverse=True)
        self.small: dict[int, frozenset] = {}

    def _near(self, r: int, percent: int) -> np.ndarray:
        """Later rows of other components that may be linked with row r, likeliest first. A pair that several bands bring together
        is looked at in the first of them."""
        rest = slice(r + 1, None)
        low, high = np.minimum(self.sizes[rest], self.sizes[r]), np.maximum(self.sizes[rest], self.sizes[r])
        other = np.flatnonzero((self.group[rest] != self.group[r]) & ((self.side[rest] != self.side[r]) | (not self.two)) & (100 * low >= percent * high)) + r + 1
        if not len(other):
            return other
        equal = self.minima[other] == self.minima[r]
        first = equal.reshape(len(other), BANDS, ROWS).all(axis=2).argmax(axis=1)
        alike = equal.mean(axis=1)
        chosen = np.flatnonzero((alike >= LEAST_EQUAL) & (first == self.band))
        return other[chosen[np.argsort(-alike[chosen], kind="stable")]]

    def near(self, percent: int) -> list[pa.RecordBatch]:
        """The rows that may be linked with any, without their minima."""
        found = np.zeros(len(self.node), bool)
        for r in range(len(self.node) - 1):
            near = self._near(r, percent)
            found[near] = True
            found[r] |= len(near) > 0
        return self.table.drop_columns(["minima"]).filter(pa.array(found)).combine_chunks().to_batches()

    def _held(self, k: int) -> frozenset:
        if k not in self.small:
            self.small[k] = frozenset(self.sets[k].tolist())
        return self.small[k]

    def _confirmed(self, r: int, k: int, percent: int) -> bool:
        few = max(self.sizes[r], self.sizes[k]) <= 2000
        common = len(self._held(r) & self._held(k)) if few else _common(self.sets[r], self.sets[k])
        return 100 * common >= percent * (self.sizes[r] + self.sizes[k] - common)

    def links(self, percent: int) -> list[pa.RecordBatch]:
        """Pairs confirmed on the full sets; pairs that links found so far connect aren't asked for."""
        self.sets = [np.frombuffer(x, np.uint64) for x in self.table["members"].to_pylist()]
        out: list[tuple[int, int]] = []
        for r in range(len(self.node) - 1):
            for k in self._near(r, percent).tolist():
                if self.group[k] != self.group[r] and self._confirmed(r, k, percent):
                    out.append((int(self.node[r]), int(self.node[k])))
                    self.group[self.group == self.group[k]] = self.group[r]
        return [pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])]


def _each_group(work):
    """Rows by key, i, j, sorted so: what work makes of each group, which is all that is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.append(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, len(batch)).tolist()
            if held and any(held[0].column(c)[0] != batch.column(c)[0] for c in ("key", "i", "j")):
                yield from work(_Group(held))
                held = []
            at = 0
            for stop in cuts:
                held.append(batch.slice(at, stop - at))
                at = stop
                if stop < len(batch):
                    yield from work(_Group(held))
                    held = []
        if held:
            yield from work(_Group(held))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as alike as is asked for."""
    side = lambda one, other: sets.select(F.col("node").alias(one), F.col("members").alias(other))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """docs: doc_id, text. A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but white space, A-Z as a-z. Linked: 100 x intersection >= percent x union of the sets of
    hashed shingles (64 bits). component_id: the smallest doc_id reachable. Null, empty and blank texts have no shingle and no link.
    Rows that repeat a doc_id are one document; if their texts differ, the one whose set has the smallest hash is linked for
    all, and kept doesn't tell them apart. Rows without doc_id are linked with nothing, have no component_id and are kept.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = cut(plain.mapInArrow(_scan(shingle), "doc_id bigint, n bigint, d1 bigint, d2 bigint, minima binary")).withColumn("_row", F.monotonically_increasing_id())
    full = scanned.filter("n > 0 AND doc_id IS NOT NULL")
    one = full.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "_row")).alias("s")).select("doc_id", "s.*")
    first = one.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    # of a third of all rows that are copies, the join's side with the rows can be split: neither side is dealt by the key yet
    key = F.col("d1").bitwiseXOR(F.col("d2"))
    member = cut(one.withColumn("k", key).join(first.withColumn("k", key), ["k", "d1", "d2"]).select("doc_id", "node", "_row"))
    nodes = cut(full.join(member.filter("doc_id = node").select("_row"), "_row", "left_semi").select(F.col("doc_id").alias("node"), "n", "d1", "d2", "minima"))
    width = 2 * ROWS
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring("minima", 1 + k * width, width)).alias("key")) for k in range(BANDS)])
    rows = nodes.select("node", F.explode(keys).alias("b")).select("node", "b.band", "b.key")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.bitwise_not("key").alias("k"), "size")
    bucketed = cut(rows.withColumn("k", F.bitwise_not("key")).join(sizes, "k").select("key", "band", "node", "size"))
    # what all of a group are copies of meets more of them than they meet each other
    central = bucketed.groupBy("node").agg(F.sum("size").alias("weight"))
    heads = bucketed.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("head")).select(F.bitwise_not("key").alias("k"), "head")
    star = bucketed.withColumn("k", F.bitwise_not("key")).join(heads, "k").filter("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    minima = lambda one, other: nodes.select(F.col("node").alias(one), F.col("minima").alias(other))
    likely = cut(star.join(minima("a", "x"), "a").join(minima("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_alike, "a bigint, b bigint"))

    def sets_of(asked: DataFrame) -> DataFrame:
        """Full sets of the nodes asked for; of an id with several texts or rows the one that its node stands for."""
        held = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select(F.xxhash64("node").alias("hash")), BITS))
        texts = plain.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
        made = texts.mapInArrow(_sets(shingle, held), "node bigint, d1 bigint, d2 bigint, members binary")
        wanted = nodes.select("node", "d1", "d2").join(asked, "node", "left_semi")
        return cut(made.join(wanted, ["node", "d1", "d2"], "left_semi").dropDuplicates(["node"]).select("node", "members"))

    sets = sets_of(cut(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()))
    links = cut(_links(likely, sets, percent))
    found = cut(components(links))
    released(docs.sparkSession)

    placed = bucketed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(F.bitwise_not("key").alias("k"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = (
        placed.withColumn("k", F.bitwise_not("key")).join(open_keys, "k")
        .withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", "band", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "node", "component")
    )
    grouped = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    place = "key bigint, band int, i int, j int, side int, node bigint, component bigint"
    own = nodes.select("node", "n", "minima")
    released(docs.sparkSession)
    near = cut(grouped(spread.join(own, "node").select("key", "band", "i", "j", "side", "node", "component", "n", "minima")).mapInArrow(_each_group(lambda g: g.near(percent)), place + ", n bigint").drop("n"))
    more = sets_of(cut(near.select("node").distinct().join(sets, "node", "left_anti"))).union(sets)
    full_rows = near.join(own, "node").join(more, "node").select("key", "band", "i", "j", "side", "node", "component", "n", "minima", "members")
    across = cut(grouped(full_rows).mapInArrow(_each_group(lambda g: g.links(percent)), "a bigint, b bigint"))
    joined = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across))
    answer = scanned.select("doc_id", "n").join(member.select("doc_id", "node"), "doc_id", "left").join(joined, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return answer.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words),
kinds AS (SELECT min(doc_id) AS node, s FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, len(s) AS n, unnest(s) AS x FROM kinds),
pairs AS (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT node AS origin, node AS stop FROM kinds UNION SELECT r.origin, b.b FROM reach r JOIN ways b ON r.stop = b.a),
least_of AS (SELECT origin AS node, min(stop) AS component FROM reach GROUP BY origin)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN kinds k ON d.s = k.s LEFT JOIN least_of l ON l.node = k.node
"""
