"""Benchmark decontamination by winnowing.

A window of WINDOW words holds WINDOW - GRAM + 1 grams of GRAM words; winnowing keeps the smallest of their hashes, the leftmost of
equal ones. Neighbouring windows mostly keep the same gram, so a text has about 2 fingerprints for 7 windows. Equal windows keep
the same gram at the same place, so no shared span of WINDOW words or more is missed. Documents meet the benchmark on fingerprints;
those that do are extended to the windows that kept them, and these are compared word for word. An item with fewer words than
WINDOW is one window; its gram is the whole item.

Scale: a bitmap of the benchmark's fingerprints (2 ** BITS bits, however large the benchmark) lets each task drop the fingerprints
of its documents that can't meet any; only the rest leaves the task, one row for each, with the words of its windows. Where a huge
benchmark fills the bitmap, more does and the result is the same. Joins are left to Spark: a small benchmark is broadcast
after Spark has seen its size, a large one is shuffled. Windows meet on all their words, so a gram that very many texts
share multiplies nothing; the benchmark's sides are written tables, which lets Spark split a passage that very many documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.llm.frames import cut, small_batches
from wickspark.llm.words import ALNUM, Words, grams, signed, words_of

WINDOW, GRAM, BITS = 13, 8, 27
_SPANS = "array<struct<start:int,n:int,windows:int,hash:bigint,words:binary>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("windows", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each gram that a window keeps: the first window that does, how many do (they follow each other), and the gram's hash."""
    hashes, _ = grams(words, gram)
    _, whole = grams(words, window)
    low, kept = hashes.copy(), np.arange(len(hashes))
    for k in range(1, window - gram + 1):
        less = np.flatnonzero(hashes[k:] < low[:-k])
        low[less], kept[less] = hashes[less + k], less + k
    at = np.flatnonzero(whole)
    first = np.flatnonzero(np.append(True, np.diff(kept[at]) != 0)) if len(at) else at
    return at[first], np.diff(np.append(first, len(at))), low[at[first]]


def _bits(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _spans(words: Words, window: int, gram: int, short: list[int], bitmap: np.ndarray | None, bits: int) -> tuple[np.ndarray, ...]:
    """First window, words of a window, number of windows and hash of each fingerprint that may be in the benchmark. Without a
    bitmap: all of an item's own."""
    found = []
    lengths = np.diff(words.bounds)
    if len(words.hash) >= window and lengths.max(initial=0) >= window:
        at, windows, low = fingerprints(words, window, gram)
        if bitmap is not None:
            met = _bits(low, bitmap, bits)
            at, windows, low = at[met], windows[met], low[met]
        found.append((at, np.full(len(at), window), windows, low))
    for n in short if bitmap is not None else sorted({int(x) for x in lengths if 0 < x < window}):
        hashes, whole = grams(words, n)
        at = np.flatnonzero(whole) if bitmap is not None else words.bounds[:-1][lengths == n]
        if bitmap is not None:
            at = at[_bits(hashes[at], bitmap, bits)]
        found.append((at, np.full(len(at), n), np.ones(len(at), int), hashes[at]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(column: pa.Array, window: int, gram: int, short: list[int], bitmap: np.ndarray | None, bits: int) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    for words in words_of(column, ALNUM):
        start, n, windows, low = _spans(words, window, gram, short, bitmap, bits)
        owner = np.searchsorted(words.bounds, start, side="right") - 1
        order = np.argsort(owner, kind="stable")
        start, n, windows, low, owner = (x[order] for x in (start, n, windows, low, owner))
        texts = [words.joined(a, b) for a, b in zip(start.tolist(), (start + n + windows - 1).tolist(), strict=True)]
        numbers = [pa.array(x.astype(np.int32)) for x in (start - words.bounds[owner], n, windows)]
        values = pa.StructArray.from_arrays([*numbers, pa.array(signed(low)), pa.array(texts, pa.binary())], ["start", "n", "windows", "hash", "words"])
        offsets = np.searchsorted(owner, np.arange(words.count + 1)).astype(np.int32)
        yield words.first, words.count, np.diff(words.bounds), pa.ListArray.from_arrays(pa.array(offsets), values, type=_SPAN_TYPE)


def with_spans(df: DataFrame, key: str, window: int, gram: int, short: list[int], bitmap, bits: int) -> DataFrame:
    """key, n_words and the fingerprints of each row of df. bitmap: a broadcast, or None for items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value if bitmap is not None else None
        for batch in batches:
            keys = batch.column(0)
            for first, count, n, spans in _scan(batch.column(1), window, gram, short, held, bits):
                yield pa.RecordBatch.from_arrays([keys.slice(first, count), pa.array(n.astype(np.int64)), spans], [key, "n_words", "spans"])

    return df.select(F.col(key).cast("long").alias(key), F.col("text")).mapInArrow(run, f"{key} bigint, n_words bigint, spans {_SPANS}")


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """2 ** (bits - 6) numbers; what is collected is one row for each that isn't 0, whatever the number of fingerprints."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    rows = prints.select(F.shiftrightunsigned(at, 6).alias("at"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - bits}) & 63))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = rows.toArrow()
    out[got["at"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return out


def _windows(prints: DataFrame, *names: str) -> DataFrame:
    """The names and start, n and words of each window of fingerprints."""
    words = F.split(F.col("words").cast("string"), " ")
    each = F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda k: F.struct((F.col("start") + k).alias("start"), F.array_join(F.slice("_words", k + 1, F.col("n")), " ").alias("words")))
    return prints.withColumn("_words", words).select(*names, "n", F.explode(each).alias("w")).select(*names, "n", "w.start", "w.words")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS, percent: int = 5) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. A row for each row of docs: doc_id, n_words, n_hit, items (ids, ascending),
    contaminated.

    Words are runs of ASCII letters (A-Z count as a-z), digits and everything beyond ASCII. A word is hit if it is within an
    occurrence of a span of the benchmark. contaminated: some are hit, and they are percent of the words at least. Null and
    empty texts have no words; items without words or id have no spans. Repeated rows each get their row, repeated items
    count once. No items: nothing is hit. No documents: no rows.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    kept = cut(with_spans(items.filter("item_id IS NOT NULL"), "item_id", window, gram, [], None, bits).select("item_id", F.explode("spans").alias("s")).select("item_id", "s.*"))
    short = sorted(r.n for r in kept.filter(F.col("n") < window).select("n").distinct().collect())
    prints = cut(kept.select("hash").distinct())
    bitmap = sc.broadcast(_bitmap(prints, bits))
    held = cut(_windows(kept, "item_id").select("item_id", "n", "words").distinct())
    spans = cut(held.select("n", "words").distinct().withColumn("span", F.monotonically_increasing_id()))
    owners = held.join(spans, ["n", "words"]).select("span", "item_id")
    scanned = cut(with_spans(docs, "doc_id", window, gram, short, bitmap, bits)).withColumn("_row", F.monotonically_increasing_id())
    hit = scanned.select("_row", F.explode("spans").alias("s")).select("_row", "s.*").join(prints, "hash", "left_semi")
    met = cut(_windows(hit, "_row").join(spans, ["n", "words"]).select("_row", "start", "n", "span"))
    ordered = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = F.aggregate(
        ordered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(s["end"], acc["upto"]).alias("upto")),
    )["n"]
    hits = met.groupBy("_row").agg(covered.cast("long").alias("n_hit"))
    listed = (
        met.select("_row", "span").distinct().join(owners, "span")
        .groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        scanned.select("_row", "doc_id", "n_words").join(hits, "_row", "left").join(listed, "_row", "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"))
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
met AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, span)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM met)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
