"""Substring dedup by difference-cover anchors.

The positions p of a text with p mod 13 in {0, 1, 3, 9} are its anchors: every difference mod 13 is one of two of these, so
two equal windows of WINDOW words, wherever they start, have an anchor at the same place within their first 13 words. Only
the ANCHOR words from each anchor on are hashed and shuffled, 4 of 13 positions; any window that occurs twice holds an
anchor that does (13 - 1 + ANCHOR <= WINDOW). From anchors that occur twice the windows around are made, and those are met on
128-bit hashes: the first stays, the words of the others go. A text that as a whole equals an earlier one goes without its windows.

Scale. Hashes travel in blobs, one for each slice of a few MB of text and each bucket of hashes, and only once per slice: what
repeats within a slice is settled there. So a passage that a third of all documents hold is no more than one number per slice
in its bucket. Marks travel back in blobs by bucket of documents. Buckets follow spark.sql.shuffle.partitions, as memory of a
task does with any shuffle. Texts are shuffled once (both later steps use the same exchange). Nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickspark.llm.frames import small_batches
from wickspark.llm.words import SPACED, Words, grams, second, whole_hash, words_of

WINDOW, ANCHOR, PERIOD = 20, 8, 13
COVER = np.isin(np.arange(PERIOD), (0, 1, 3, 9))
_PRIME, _FACTOR = 1000003, 48271
_SENT = "bucket int, anchors binary, firsts binary, known binary"
_MARKS = "place int, marks binary"


def place_of(doc_id: Column, text: Column, n: int) -> Column:
    """Bucket of a document; rows without id are spread by text."""
    key = F.pmod(F.coalesce(doc_id, F.xxhash64(text)), F.lit(_PRIME))
    return F.pmod(F.pmod(key * _FACTOR, F.lit(_PRIME)), F.lit(n)).cast("int")


def _places(doc: np.ndarray, n: int) -> np.ndarray:
    return np.mod(np.mod(np.mod(doc, _PRIME) * _FACTOR, _PRIME), n)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


def _split(bucket: np.ndarray, *columns: np.ndarray) -> dict[int, bytes]:
    """Blob of each bucket's rows, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    keys, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(order))[: len(keys)]
    return {int(k): _pack(*(c[order[a:b]] for c in columns)) for k, a, b in zip(keys, at, ends, strict=True)}


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] ... hi[0] - 1, lo[1] ... and so on."""
    n = hi - lo
    return np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each of the sorted rows belongs to."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _later(h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each 128-bit hash: the row of the first (doc, pos); and the rows that come after it. A row equal to the first isn't later."""
    order = np.lexsort((pos, doc, g, h))
    run = _runs(h[order], g[order])
    head = order[np.searchsorted(run, np.arange(run[-1] + 1 if len(run) else 0))]
    own = head[run] if len(run) else head
    later = (doc[order] != doc[own]) | (pos[order] != pos[own])
    return head, order[later]


def _message(n: int, number: int, anchors: dict, firsts: dict, known: bytes) -> pa.RecordBatch:
    """A row for each bucket; known marks are passed on by any one of them."""
    keys = sorted(anchors.keys() | firsts.keys() | ({number % n} if known else set()))
    return pa.RecordBatch.from_arrays([
        pa.array(keys, pa.int32()), pa.array([anchors.get(k, b"") for k in keys], pa.binary()), pa.array([firsts.get(k, b"") for k in keys], pa.binary()),
        pa.array([known if k == number % n else b"" for k in keys], pa.binary())], ["bucket", "anchors", "firsts", "known"])


def _anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for words in words_of(batch.column(1), SPACED):
                doc = ids[words.first : words.first + words.count]
                length = np.diff(words.bounds)
                owner = words.owner()
                pos = np.arange(len(owner)) - words.bounds[owner]
                at = np.flatnonzero(COVER[pos % PERIOD] & (pos + ANCHOR <= length[owner]) & (length[owner] >= WINDOW))
                h = grams(words, ANCHOR)[0][at]
                order = np.argsort(h, kind="stable")
                run_no = _runs(h[order]) if len(order) else order
                heads = np.searchsorted(run_no, np.arange(run_no[-1] + 1 if len(run_no) else 0))
                many = np.bincount(run_no)[run_no] > 1 if len(run_no) else run_no > 0
                rep = np.sort(order[heads])
                twice = at[np.sort(order[many])]
                long = np.flatnonzero(length >= WINDOW)
                th, tg = whole_hash(words)[long], whole_hash(second(words))[long]
                zero = np.full(len(long), -1, np.int32)
                head, later = _later(th, tg, doc[long], zero)
                firsts = _split((th[head] >> np.uint64(32)) % np.uint64(n), th[head], tg[head], doc[long][head], zero[head])
                spots = at[rep]
                anchors = _split((h[rep] >> np.uint64(32)) % np.uint64(n), h[rep], doc[owner[spots]], pos[spots].astype(np.int32))
                known = _pack(np.append(doc[owner[twice]], doc[long][later]), np.append(pos[twice].astype(np.int32), zero[later]))
                number += 1
                yield _message(n, number + int(doc[0] if len(doc) else 0), anchors, firsts, known)

    return run


def _settle(n: int):
    """Marks of a bucket: anchors that occur twice, of windows and texts all but the first."""

    def run(table: pa.Table) -> pa.Table:
        h, doc, pos = _unpack(table["anchors"].to_pylist(), "u8", "i8", "i4")
        order = np.argsort(h, kind="stable")
        run_no = _runs(h[order]) if len(order) else order
        many = order[np.bincount(run_no)[run_no] > 1] if len(order) else order
        wh, wg, wdoc, wpos = _unpack(table["firsts"].to_pylist(), "u8", "u8", "i8", "i4")
        later = _later(wh, wg, wdoc, wpos)[1]
        kdoc, kpos = _unpack(table["known"].to_pylist(), "i8", "i4")
        doc, pos = np.concatenate((doc[many], wdoc[later], kdoc)), np.concatenate((pos[many], wpos[later], kpos))
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        out = _split(_places(doc, n), doc, pos)
        return pa.table({"place": pa.array(out.keys(), pa.int32()), "marks": pa.array(out.values(), pa.binary())})

    return run


def _marked(words: Words, doc: np.ndarray, has_id: np.ndarray, mdoc: np.ndarray, mpos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: the words that are marked, their texts, and which texts are marked as a whole."""
    lo, hi = np.searchsorted(mdoc, doc, "left"), np.searchsorted(mdoc, doc, "right")
    lo = np.where(has_id, lo, hi)
    at = _ranges(lo, hi)
    text = np.repeat(np.arange(len(doc)), hi - lo)
    whole = np.zeros(len(doc), bool)
    whole[text[mpos[at] < 0]] = True
    fits = (mpos[at] >= 0) & (mpos[at] < np.diff(words.bounds)[text])
    return words.bounds[text[fits]] + mpos[at[fits]], text[fits], whole


def _group(docs: pa.Table, marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    column = docs["doc_id"].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    has_id = ~np.asarray(column.is_null())
    mdoc, mpos = _unpack(marks["marks"].to_pylist(), "i8", "i4")
    order = np.lexsort((mpos, mdoc))
    return column.fill_null(0).to_numpy(), has_id, mdoc[order], mpos[order]


def _windows(n: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        ids, has_id, mdoc, mpos = _group(docs, marks)
        out = []
        if len(mdoc):
            for number, words in enumerate(words_of(docs["text"], SPACED)):
                span = slice(words.first, words.first + words.count)
                doc = ids[span]
                at, text, whole = _marked(words, doc, has_id[span], mdoc, mpos)
                at, text = at[~whole[text]], text[~whole[text]]
                step = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(step, np.maximum(at - (PERIOD - 1), words.bounds[text]), 1)
                np.add.at(step, at + 1, -1)
                h, fits = grams(words, WINDOW)
                w = np.flatnonzero((np.cumsum(step[:-1]) > 0) & fits)
                h, g = h[w], grams(second(words), WINDOW)[0][w]
                owner = np.searchsorted(words.bounds, w, side="right") - 1
                wdoc, wpos = doc[owner], (w - words.bounds[owner]).astype(np.int32)
                head, later = _later(h, g, wdoc, wpos)
                head = np.sort(head)
                firsts = _split((h[head] >> np.uint64(32)) % np.uint64(n), h[head], g[head], wdoc[head], wpos[head])
                gone = doc[whole & has_id[span]]
                known = _pack(np.append(wdoc[later], gone), np.append(wpos[later], np.full(len(gone), -1, np.int32)))
                out.append(_message(n, number + int(doc[0]), {}, firsts, known))
        return pa.Table.from_batches(out, schema=pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("firsts", pa.binary()), ("known", pa.binary())]))

    return run


def _kept(docs: pa.Table, marks: pa.Table) -> pa.Table:
    ids, has_id, mdoc, mpos = _group(docs, marks)
    lengths, removed, texts = [], [], []
    for words in words_of(docs["text"], SPACED):
        span = slice(words.first, words.first + words.count)
        at, _, whole = _marked(words, ids[span], has_id[span], mdoc, mpos)
        step = np.zeros(len(words.hash) + 1 + WINDOW, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + WINDOW, -1)
        owner = words.owner()
        keep = (np.cumsum(step)[: len(words.hash)] == 0) & ~whole[owner]
        kept = np.bincount(owner[keep], minlength=words.count)
        lengths.append(np.diff(words.bounds))
        removed.append(np.diff(words.bounds) - kept)
        # the bytes of kept words, and the byte before each but a text's first, as a space
        edges = np.zeros(len(words.data) + 1, np.int8)
        edges[words.start[keep]] += 1
        edges[words.end[keep]] -= 1
        mask = np.cumsum(edges[:-1], dtype=np.int8) > 0
        first = np.flatnonzero(keep)
        first = first[np.append(False, owner[first][1:] == owner[first][:-1])] if len(first) else first
        before = words.start[first] - 1
        data = words.data.copy()
        data[before] = 0x20
        mask[before] = True
        size = np.append(0, np.cumsum(np.add.reduceat(np.append(mask, False).astype(np.int64), words.at[:-1]) * (np.diff(words.at) > 0)))
        texts.append(pa.Array.from_buffers(pa.string(), words.count, [None, pa.py_buffer(size.astype(np.int32).tobytes()), pa.py_buffer(data[mask].tobytes())]))
    return pa.table({
        "doc_id": docs["doc_id"], "n_words": np.concatenate(lengths).astype(np.int64), "n_removed": np.concatenate(removed).astype(np.int64),
        "kept": pa.chunked_array(texts, pa.string())}) if lengths else _EMPTY


_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row for each row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by a space).

    Words are runs of anything but space, tab, LF, VT, FF and CR, as they stand. A word goes if a window of WINDOW words
    covers it whose words also start earlier: in a smaller doc_id, or in the same document before. Windows are those of the
    input. Texts of fewer words, empty and null ones keep what they have. Rows without doc_id take no part and keep
    all. If a doc_id has several rows they are one place: equal windows at equal positions of it are no repeat, and what goes
    from one goes at the same positions from the others. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = plain.withColumn("place", place_of(F.col("doc_id"), F.col("text"), n))
    settle = _settle(n)
    sent = plain.filter("doc_id IS NOT NULL").mapInArrow(_anchors(n), _SENT)
    marks = sent.groupBy("bucket").applyInArrow(settle, _MARKS)
    by_place = placed.groupBy("place")
    windows = by_place.cogroup(marks.groupBy("place")).applyInArrow(_windows(n), _SENT)
    gone = windows.groupBy("bucket").applyInArrow(settle, _MARKS)
    return by_place.cogroup(gone.groupBy("place")).applyInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, hash(w[p:p + 19]) AS h, array_to_string(w[p:p + 19], ' ') AS span FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY span ORDER BY doc_id, p) AS no FROM win WHERE h IN (SELECT h FROM twice)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM ranked WHERE no > 1),
lost AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id),
left_over AS (SELECT d.doc_id, w, qs, CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END AS kept FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over
"""
