"""Substring dedup on bytes by suffix arrays: what LENGTH bytes long stands in two places goes from both.

Texts are taken in shards of about SHARD bytes. A shard's suffix array is refined as Larsson and Sadakane do: groups of suffixes that
agree in their first h bytes are sorted by the group of the suffix h bytes on, h doubles, and only groups of several members are
looked at again. Common prefixes of neighbours come from Kasai's rule, that the one of a suffix without its first byte is
shorter by no more than one: only positions where the neighbour changes are compared, the rest follow. Windows (of LENGTH
bytes) that meet in the suffix array are settled in the shard; one of each kind, its head, stands for them outside.

Shards are merged by windows that stand for many. The window's anchor is the least of its GRAM-byte hashes, so equal windows
have it at the same place, and windows around one anchor come in runs of up to STEP starts. A run sends the hash of the bytes
common to all windows that may be in such a run (core) and of all its bytes (hull), sorted. A bucket merges the sorted lists of all
shards by binary search: runs with a core of their own have no partner, those with equal hulls are repeated from end to end, and only
of the rest are single windows sent, hashed, and merged in the same way.

Scale: about 0.5 bytes a byte of text are sent for runs; windows only where a repeat begins or ends. Rows are dealt by a hash of id and
text, runs by core, windows by their own hash, so a passage that a third of all documents share, with different surroundings, is spread. The
number of buckets follows the measured size of the texts. Texts longer than a shard are taken in pieces that overlap by LENGTH - 1
bytes. Texts are shuffled once. Nothing but that size goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.llm.frames import cut, small_batches
from wickspark.llm.substrings import _pack, _ranges, _runs, _split, _unpack
from wickspark.llm.words import MULTIPLIER, buffers, mixed, slices

LENGTH, GRAM, STEP, SHARD, PLACE_BYTES, FLUSH = 400, 32, 100, 1_000_000, 32_000_000, 8_000_000
_RUN = ("u8", "u8", "i8", "i4", "i4")  # core, hull, row, start, windows
_WINDOW = ("u8", "u8", "i8", "i4")  # window, core, row, start
_MARK = ("i8", "i4", "i4")  # row, start, windows
_ASK = ("u8", "i8", "i4", "i4")  # core, row, start, windows


def _eights(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros behind the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), ">u8" if big else "<u8", padded.data, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of data in the order of its suffixes; and for each, whether it agrees with the one before in the first h bytes, for an h
    (returned too) below length, and of half of it at least where any do."""
    n = len(data)
    key = _eights(data, big=True)
    order = np.argsort(key)
    rank = np.zeros(n + 1, np.int64)
    slots, found, h = np.arange(n), key[order], 8
    joined, known = np.zeros(n, bool), 0
    while True:
        head = np.append(True, found[1:] != found[:-1])
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(found)))
        if h < length:
            joined[:], known = False, h
            joined[slots] = ~head
        # a group's number is its first slot and 1, so that 0 is what lies behind the end
        rank[order[slots]] = np.repeat(slots[begin] + 1, size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order, joined, known
        own = order[slots]
        found = (rank[own] << 32) | rank[np.minimum(own + h, n)]
        by = np.argsort(found)
        order[slots], found = own[by], found[by]
        h *= 2


def _agree(data: np.ndarray, a: int, b: int) -> int:
    """How many bytes from a on are those from b on."""
    length, step, most = 0, 512, len(data) - max(a, b)
    while length < most:
        x, y = data[a + length : a + min(length + step, most)], data[b + length : b + min(length + step, most)]
        other = np.flatnonzero(x != y)
        if len(other):
            return length + int(other[0])
        length, step = length + len(x), step * 2
    return length


def _extended(data: np.ndarray, key: np.ndarray, spot: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many bytes from spot on are those from other on, where length of them are known to be."""
    n, most, length = len(data), len(data) - np.maximum(spot, other), length.copy()
    open_ = np.flatnonzero(length < most)
    for _ in range(32):
        if not len(open_):
            break
        at = length[open_]
        differ = key[np.minimum(spot[open_] + at, n)] ^ key[np.minimum(other[open_] + at, n)]
        rest = differ & (~differ + np.uint64(1))
        same = differ == 0
        length[open_] += np.where(same, 8, np.log2(np.maximum(rest, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        open_ = open_[same & (most[open_] > at + 8)]
    for k in open_.tolist():
        length[k] += _agree(data, int(spot[k] + length[k]), int(other[k] + length[k]))
    return np.minimum(length, most)


def common_prefixes(data: np.ndarray, order: np.ndarray, joined: np.ndarray | None = None, known: int = 0) -> np.ndarray:
    """For each suffix but the first in the order, how many bytes it shares with the one before. joined: where that is to be told, the
    first known bytes agree there; elsewhere it is 0.

    Kasai's rule: where p bytes are shared from a place on, p - k at least are from k places on. So places some hundred bytes apart are compared first, then
    those between with what is left to compare, and so on; and nothing is compared where the neighbour moves on with the place."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    if joined is not None:
        before[order[~joined]] = -1
    key = np.append(_eights(data), np.zeros(8, np.uint64))
    shared = np.zeros(n, np.int64)
    # where the neighbour of the next place is the next place's, the common prefix is one shorter
    follows = np.append(False, (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (before[1:] > 0))
    follows[1:] &= data[:-1] == data[before[1:] - 1]
    place = np.flatnonzero(before >= 0)
    for wide, step in ((n + 1, 512), (512, 64), (64, 8), (8, 1)):
        spot = place[(place % step == 0) & (place % wide != 0 if wide <= n else True)]
        if step == 1:
            spot = spot[~follows[spot]]
        least = np.maximum(shared[spot // wide * wide] - spot % wide, known) if wide <= n else np.full(len(spot), known)
        shared[spot] = _extended(data, key, spot, before[spot], np.minimum(least, n - np.maximum(spot, before[spot])))
    last = np.maximum.accumulate(np.where(follows & (np.arange(n) % 8 != 0), 0, np.arange(n)))
    shared = np.where(before >= 0, np.maximum(shared[last] - (np.arange(n) - last), 0), 0)
    return shared[order[1:]]


def repeated(data: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which windows stand in data twice or more, and which are heads: one of each kind, those that stand once among them.
    valid: where a window may start."""
    if not len(data):
        return np.zeros(0, bool), np.zeros(0, bool)
    order, joined, known = suffix_array(data, length)
    kind = np.append(0, np.cumsum(common_prefixes(data, order, joined, known) < length))
    usable = valid[order]
    order, kind = order[usable], kind[usable]
    twice, head = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(order):
        run = _runs(kind)
        twice[order] = np.bincount(run)[run] > 1
        head[order[np.append(True, run[1:] != run[:-1])]] = True
    return twice, head


class Prints:
    """Hashes of the bytes from each place on; of any length from 256 to 512 by two that overlap."""

    def __init__(self, data: np.ndarray) -> None:
        h, n, self.n = mixed(_eights(data) + MULTIPLIER), 8, len(data)
        while n < 256:
            if n == GRAM:
                self.gram = h
            h = self._joined(h, np.append(h[n:], np.zeros(min(n, len(h)), np.uint64)), n)
            n *= 2
        self.long = h

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        return mixed(a * MULTIPLIER + b + np.asarray(salt).astype(np.uint64))

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._joined(self.long[start], self.long[start + length - 256], length)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each width numbers in a row, from each place on."""
    low, n = key, 1
    shift = lambda x, k: np.append(x[k:], np.full(min(k, len(x)), np.iinfo(np.uint64).max, np.uint64))
    while 2 * n <= width:
        low, n = np.minimum(low, shift(low, n)), 2 * n
    return np.minimum(low, shift(low, width - n))


def runs(prints: Prints, valid: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, core and hull of each run."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place = np.arange(prints.n, dtype=np.uint64)
    anchor = (_least(((prints.gram >> np.uint64(32)) << np.uint64(32)) | place, length - GRAM + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    part = (anchor - at) // STEP
    new = np.append(True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    first, core = at[begin], anchor[begin] - part[begin] * STEP
    return first, count, prints.of(core, np.full(len(core), length - STEP + 1)), prints.of(first, length + count - 1)


def _pieces(data: np.ndarray, offsets: np.ndarray, shard: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First text, its bytes, where its texts begin and end, and how far into the text the piece begins."""
    for a, b in slices(offsets, shard):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) <= 2 * shard:
            yield a, part, at, 0
        else:  # one text; more than one are no longer than shard together
            for x in range(0, max(len(part) - length + 1, 1), shard):
                piece = part[x : x + shard + length - 1]
                yield a, piece, np.array([0, len(piece)]), x


def _intervals(twice: np.ndarray, owner: np.ndarray, rows: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked windows as (row, start, windows)."""
    at = np.flatnonzero(twice)
    begin = np.flatnonzero(np.append(True, (np.diff(at) > 1) | np.diff(owner[at]).astype(bool))) if len(at) else at
    count = np.diff(np.append(begin, len(at)))
    first = at[begin]
    return rows[owner[first]], (first - origin[owner[first]]).astype(np.int32), count.astype(np.int32)


def _sent(lists: list[list[np.ndarray]], marks: list[list[np.ndarray]], n: int, number: int) -> pa.RecordBatch:
    """A row for each bucket, with its sorted list; and one with the marks so far."""
    columns = [np.concatenate(x) for x in zip(*lists, strict=True)] if lists else [np.zeros(0, k) for k in _RUN]
    by = np.argsort(columns[0], kind="stable")
    columns = [c[by] for c in columns]
    blobs = _split((columns[0] >> np.uint64(32)) % np.uint64(n), *columns)
    known = _pack(*(np.concatenate(x) for x in zip(*marks, strict=True))) if marks else b""
    keys = sorted(blobs.keys() | ({number % n} if known else set()))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([blobs.get(k, b"") for k in keys], pa.binary()), pa.array([known if k == number % n else b"" for k in keys], pa.binary())], ["bucket", "sent", "known"])


def _scan(n: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[list[np.ndarray]] = []
        marks: list[list[np.ndarray]] = []
        held = number = 0
        for batch in batches:
            rows = batch.column("row").to_numpy()
            data, offsets = buffers(batch.column("text"))
            for a, part, at, skipped in _pieces(data, offsets, shard, LENGTH):
                size = np.diff(at)
                owner = np.repeat(np.arange(len(size)), size)
                valid = np.arange(len(part)) + LENGTH <= at[1:][owner]
                if not valid.any():
                    continue
                own, origin = rows[a : a + len(size)], at[:-1] - skipped
                twice, head = repeated(part, valid)
                first, count, core, hull = runs(Prints(part), valid)
                total = np.append(0, np.cumsum(head))
                some = np.flatnonzero(total[first + count] > total[first])
                first, count, core, hull = first[some], count[some], core[some], hull[some]
                lists.append([core, hull, own[owner[first]], (first - origin[owner[first]]).astype(np.int32), count.astype(np.int32)])
                marks.append(list(_intervals(twice, owner, own, origin)))
                held += 28 * len(first) + 16 * len(marks[-1][0])
                number += 1
                if held > FLUSH:
                    yield _sent(lists, marks, n, number + int(own[0]))
                    lists, marks, held = [], [], 0
        if lists:
            yield _sent(lists, marks, n, number)

    return run


def merged(lists: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Lists sorted by their first column as one: two and two are merged, the place of each row found by binary search in the other list."""
    while len(lists) > 1:
        out = list(lists[len(lists) // 2 * 2 :])
        for x, y in zip(lists[::2], lists[1::2], strict=False):
            at = np.arange(len(y[0])) + np.searchsorted(x[0], y[0], side="right")
            from_y = np.zeros(len(x[0]) + len(y[0]), bool)
            from_y[at] = True
            both = []
            for p, q in zip(x, y, strict=True):
                column = np.empty(len(from_y), p.dtype)
                column[from_y], column[~from_y] = q, p
                both.append(column)
            out.append(tuple(both))
        lists = sorted(out, key=lambda c: len(c[0]))
    return lists[0]


def _lists(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    found = [tuple(_unpack([b], *kinds)) for b in blobs if b]
    return merged(found) if found else tuple(np.zeros(0, k) for k in kinds)


def _by_place(n: int, kinds: dict[str, list[np.ndarray]]) -> pa.Table:
    """Blobs of each kind's rows by the place of their row. The row is the third last column."""
    blobs = {name: _split(columns[-3] % n, *columns) for name, columns in kinds.items()}
    places = sorted(set().union(*blobs.values()))
    return pa.table({"place": pa.array(places, pa.int32()), **{name: pa.array([b.get(p, b"") for p in places], pa.binary()) for name, b in blobs.items()}})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by keys and the number of each row's group in that order."""
    order = np.lexsort(keys[::-1])
    return order, _runs(*(k[order] for k in keys))


def _settle_runs(n: int):
    def run(table: pa.Table) -> pa.Table:
        columns = _lists(table["sent"].to_pylist(), _RUN)
        known = _unpack(table["known"].to_pylist(), *_MARK)
        run_no = _runs(columns[0])
        core, hull, row, start, count = (c[np.bincount(run_no)[run_no] > 1] if len(run_no) else c for c in columns)
        order, same = _groups(core, hull)
        core, row, start, count = core[order], row[order], start[order], count[order]
        whole = np.bincount(same)[same] > 1 if len(same) else np.zeros(0, bool)
        heads = np.flatnonzero(np.append(True, same[1:] != same[:-1])) if len(same) else np.zeros(0, np.int64)
        run_no = _runs(core[heads])
        asked = heads[np.bincount(run_no)[run_no] > 1] if len(heads) else heads
        return _by_place(n, {
            "marks": [np.append(k, x[whole]) for k, x in zip(known, (row, start, count), strict=True)],
            "asks": [x[asked] for x in (core, row, start, count)]})

    return run


def _settle_windows(n: int):
    def run(table: pa.Table) -> pa.Table:
        window, core, row, start = _lists(table["sent"].to_pylist(), _WINDOW)
        order, same = _groups(window, core)
        many = order[np.bincount(same)[same] > 1] if len(same) else order
        return _by_place(n, {"marks": [row[many], start[many], np.ones(len(many), np.int32)], "asks": [np.zeros(0, k) for k in _ASK]})

    return run


def _windows(n: int):
    """Hashes of the windows asked for."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        core, row, start, count = _unpack(marks["asks"].to_pylist(), *_ASK)
        lists: list[list[np.ndarray]] = []
        out = []
        if len(row):
            order = np.argsort(row, kind="stable")
            core, row, start, count = core[order], row[order], start[order].astype(np.int64), count[order].astype(np.int64)
            rows = docs["row"].to_numpy()
            data, offsets = buffers(docs["text"])
            lo, hi = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
            ask, text = _ranges(lo, hi), np.repeat(np.arange(len(rows)), hi - lo)
            size = count[ask] + LENGTH - 1
            begin = offsets[text] + start[ask]
            fits = begin + size <= offsets[text + 1]  # else a row of another text with an equal key
            ask, text, size, begin = ask[fits], text[fits], size[fits], begin[fits]
            held = 0
            for x, y in slices(np.append(0, np.cumsum(size)), SHARD):
                prints = Prints(data[_ranges(begin[x:y], begin[x:y] + size[x:y])])
                at = np.append(0, np.cumsum(size[x:y]))[:-1]
                some = ask[x:y]
                spot = _ranges(at, at + count[some])
                of = np.repeat(some, count[some])
                lists.append([prints.of(spot, np.full(len(spot), LENGTH)), core[of], row[of], (start[of] + spot - np.repeat(at, count[some])).astype(np.int32)])
                held += 28 * len(spot)
                if held > FLUSH:
                    out.append(_sent(lists, [], n, 0))
                    lists, held = [], 0
            if lists:
                out.append(_sent(lists, [], n, 0))
        return pa.Table.from_batches(out, schema=pa.schema([("bucket", pa.int32()), ("sent", pa.binary()), ("known", pa.binary())]))

    return run


def _kept(docs: pa.Table, marks: pa.Table) -> pa.Table:
    row, start, count = _unpack(marks["marks"].to_pylist(), *_MARK)
    order = np.argsort(row, kind="stable")
    row, start, count = row[order], start[order].astype(np.int64), count[order].astype(np.int64)
    rows = docs["row"].to_numpy()
    data, offsets = buffers(docs["text"])
    removed, spans, texts = [], [], []
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        lo, hi = np.searchsorted(row, rows[a:b], "left"), np.searchsorted(row, rows[a:b], "right")
        mark, text = _ranges(lo, hi), np.repeat(np.arange(b - a), hi - lo)
        end = at[text] + start[mark] + count[mark] + LENGTH - 1
        mark, text, end = (x[end <= at[text + 1]] for x in (mark, text, end))
        step = np.zeros(len(part) + 1, np.int64)
        np.add.at(step, at[text] + start[mark], 1)
        np.add.at(step, end, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        begins = gone & (edge[:-1] | ~np.append(False, gone)[:-1])
        total, runs_ = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
        removed.append(total[at[1:]] - total[at[:-1]])
        spans.append(runs_[at[1:]] - runs_[at[:-1]])
        size = at - total[at]
        texts.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(size.astype(np.int32).tobytes()), pa.py_buffer(part[~gone].tobytes())]))
    lengths = np.diff(offsets)
    flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": lengths.astype(np.int64), "n_removed": flat(removed), "n_spans": flat(spans), "kept": pa.chunked_array(texts, pa.binary())})


def without_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """docs: doc_id, text. A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, which need not be
    whole characters).

    A byte goes if it is in a string of LENGTH bytes of its text's UTF-8 that also starts elsewhere, in this text or another; all places lose it. Judged on
    the input. n_spans: runs of bytes that go. Shorter texts, empty and null ones keep what they have. Every row is a text of its own, without doc_id
    too; repeated rows are copies of each other. Windows that meet across shards are compared by pairs of 64-bit hashes. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1)).alias("row"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PLACE_BYTES))
    placed = plain.withColumn("place", F.pmod("row", F.lit(n)).cast("int")).groupBy("place")
    marks = "place int, marks binary, asks binary"
    sent = plain.select("row", "text").mapInArrow(_scan(n, shard), "bucket int, sent binary, known binary")
    first = cut(sent.groupBy("bucket").applyInArrow(_settle_runs(n), marks))
    windows = placed.cogroup(first.groupBy("place")).applyInArrow(_windows(n), "bucket int, sent binary, known binary")
    second = windows.groupBy("bucket").applyInArrow(_settle_windows(n), marks)
    return placed.cogroup(first.union(second).groupBy("place")).applyInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS p FROM d)),
many AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM win WHERE h IN (SELECT h FROM many)),
numbered AS (SELECT doc_id, p, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS no FROM gone),
spans AS (SELECT doc_id, no, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY doc_id, no),
listed AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id),
parts AS (SELECT d.doc_id, n, x, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, list_prepend(0, coalesce(ends, [])) AS froms, list_append(coalesce(starts, []), n) AS upto FROM d LEFT JOIN listed USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i: substr(x, 2 * froms[i] + 1, 2 * (upto[i] - froms[i]))), ''))) AS kept_sha256
FROM parts
"""
