"""Fill-in-the-middle: texts cut at two unit boundaries and written as prefix, suffix and middle in another order.

A text is looked at in blocks of BLOCK bytes. A Fenwick tree over its blocks holds how many units end in them and how many
code points begin in them. Where the k-th unit ends is found by binary lifting down the tree, which also sums the code points
on the way; only the one block that it ends in is then looked at byte by byte. The trees of all texts of a slice stand one
behind the other and are built and descended together in numpy.

Scale: rows are independent, nothing is shuffled. Texts are taken in slices of a few MB, a text is never cut for memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickspark.llm.frames import small_batches
from wickspark.llm.words import buffers, slices

BLOCK = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_FORMS = np.array(["plain", "psm", "spm"])


def unit_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a unit ends with each byte: white space with the word behind it, or what white space is left at the end of a text.
    at: where the texts in data begin, and the end of the last."""
    space = _SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[at[1:][np.diff(at) > 0] - 1] = True
    return ends


@dataclass
class Trees:
    """Fenwick trees of several texts. Of text t: nodes first[t] ... first[t] + size[t] - 1, the i-th (from 1) at first[t] + i - 1."""

    first: np.ndarray
    size: np.ndarray
    units: np.ndarray
    points: np.ndarray


def grown(ends: np.ndarray, starts: np.ndarray, at: np.ndarray, block: int = BLOCK) -> Trees:
    """ends, starts: for each byte, whether a unit ends and whether a code point begins there."""
    size = -(-np.diff(at) // block)
    first = np.cumsum(size) - size
    number = np.arange(size.sum()) - np.repeat(first, size) + 1
    begin = np.repeat(at[:-1], size) + (number - 1) * block
    units, points = (np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64) for x in (ends, starts))
    step = 1
    while step < size.max(initial=0):
        node = np.flatnonzero(number % (2 * step) == 0)
        for tree in (units, points):
            tree[node] += tree[node - step]
        step *= 2
    return Trees(first, size, units, points)


def boundaries(trees: Trees, ends: np.ndarray, starts: np.ndarray, at: np.ndarray, text: np.ndarray, k: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a text and a number k of its units: the byte behind its k-th unit, and the code points before that."""
    place, rest, points = np.zeros(len(k), np.int64), k.astype(np.int64), np.zeros(len(k), np.int64)
    first, size = trees.first[text], trees.size[text]
    step = 1 << int(size.max(initial=0)).bit_length()
    while step:
        node = first + np.minimum(place + step, size) - 1
        down = (place + step <= size) & (k > 0)
        down[down] = trees.units[node[down]] < rest[down]
        rest[down] -= trees.units[node[down]]
        points[down] += trees.points[node[down]]
        place[down] += step
        step >>= 1
    byte = at[:-1][text].copy()
    some = np.flatnonzero(k > 0)
    begin = byte[some] + place[some] * block
    window = begin[:, None] + np.arange(block)
    inside = window < at[1:][text[some]][:, None]
    window = np.where(inside, window, begin[:, None])
    seen = np.cumsum(ends[window] & inside, axis=1)
    last = (seen < rest[some][:, None]).sum(axis=1)
    byte[some] = begin + last + 1
    points[some] += (starts[window] & inside & (np.arange(block) <= last[:, None])).sum(axis=1)
    return byte, points


def _marked(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the three marks."""
    found = np.zeros(len(data), bool)
    if len(data) > 2:
        found[:-2] = (data[:-2] == ord("<")) & np.isin(data[1:-1], [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]) & (data[2:] == ord(">"))
    spot = np.flatnonzero(found)
    text = np.searchsorted(at, spot, side="right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[text[spot + 3 <= at[1:][text]]] = True
    return out


def _forms(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ends, starts = unit_ends(part, at), part & 0xC0 != 0x80
                trees = grown(ends, starts, at)
                total = np.append(0, np.cumsum(ends))
                n = total[at[1:]] - total[at[:-1]]
                one, two = h[0][a:b] % (n + 1), h[1][a:b] % (n + 1)
                plain = (n == 0) | _marked(part, at) | (h[2][a:b] % 100 >= rate)
                form = np.where(plain, 0, np.where(h[3][a:b] % 100 < spm, 2, 1))
                text = np.flatnonzero(form)
                low, before = boundaries(trees, ends, starts, at, text, np.minimum(one, two)[text])
                high, upto = boundaries(trees, ends, starts, at, text, np.maximum(one, two)[text])
                out = [part[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for t, f, x, y in zip(text.tolist(), form[text].tolist(), (low - at[text]).tolist(), (high - at[text]).tolist(), strict=True):
                    p, m, s = out[t][:x], out[t][x:y], out[t][y:]
                    out[t] = b"<P>%b<S>%b<M>%b" % (p, s, m) if f == 1 else b"<S>%b<P>%b<M>%b" % (s, p, m)
                chars = np.zeros((2, b - a), np.int64)
                chars[:, text] = before, upto - before
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(_FORMS[form].tolist(), pa.string()),
                    *(pa.array(c, mask=form == 0) for c in chars), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: str = "42", rate: int = 50, spm: int = 80) -> DataFrame:
    """docs: doc_id, text. A row for each row of docs: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Units are white space ([\\x20\\x09-\\x0D]) with the word behind it, and white space at the end. Cuts, and whether and how a
    text is cut, follow from a sha256 of seed and doc_id: rate percent are cut, of these spm percent are suffix first. Texts
    that hold a mark, empty and null ones stay plain; prefix_chars and middle_chars are null then, the output of a null
    text is empty. A null doc_id counts as an empty one. Repeated rows give the same; other columns are not looked at. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(1, 5)]
    kind = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *parts).mapInArrow(_forms(rate, spm), kind)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    at = {m: F.instr(output, m) for m in (PREFIX, SUFFIX, MIDDLE)}
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    last = F.substring(output, at[MIDDLE] + 3, F.length(output))
    psm = F.concat(between(at[PREFIX], at[SUFFIX]), last, between(at[SUFFIX], at[MIDDLE]))
    spm = F.concat(between(at[PREFIX], at[MIDDLE]), last, between(at[SUFFIX], at[PREFIX]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS s, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
