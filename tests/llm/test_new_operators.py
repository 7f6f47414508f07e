"""Suffix-array dedup, fill-in-the-middle and ranked search against plain loops; word hashes."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import lowered, near_by_loop, said

from wickspark.llm import fim, fptree, neardup, substrings, suffixes
from wickspark.llm.words import SPACED, second, whole_hash, words_of

TEXT = "doc_id long, text string"


# --- word hashes ---------------------------------------------------------------------------------

def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_that_collide_under_a_polynomial_do_not(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    hashes = [next(iter(words_of(pa.array([t]), SPACED))) for t in (one, two)]
    assert hashes[0].hash[0] != hashes[1].hash[0] and second(hashes[0]).hash[0] != second(hashes[1]).hash[0]
    texts = [" ".join(t) for t in (one, two)]
    whole = [whole_hash(w) for t in texts for x in words_of(pa.array([t]), SPACED) for w in (x, second(x))]
    assert len({int(w[0]) for w in whole}) == 4
    tail = " ".join(f"w{i}" for i in range(19))
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}")], TEXT)).collect()}
    assert got == {1: 0, 2: 0}
    rows = [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, texts[0]), (4, texts[1])]
    assert {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(spark.createDataFrame(rows, TEXT)).collect()} == near_by_loop(rows, 4)


# --- suffix arrays -------------------------------------------------------------------------------

@pytest.mark.parametrize("letters,n", [(1, 40), (2, 3000), (26, 3000), (3, 1)])
def test_suffix_array_and_common_prefixes(letters, n):
    rng = np.random.default_rng(n + letters)
    data = rng.integers(97, 97 + letters, n).astype(np.uint8)
    if n > 1000:
        data[1500:2500] = data[200:1200]
    data = np.append(data, data[: n // 3])
    raw = data.tobytes()
    order, joined, known = suffixes.suffix_array(data, len(data))
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    want = []
    for a, b in zip(order.tolist(), order[1:].tolist(), strict=False):
        k = 0
        while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        want.append(k)
    assert suffixes.common_prefixes(data, order).tolist() == want
    assert [k >= known for k in want] == joined[1:].tolist() and known < len(data)
    assert suffixes.common_prefixes(data, order, joined, known).tolist() == [k if k >= known else 0 for k in want]


def test_lists_are_merged():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)) for _ in range(7)]
    keys, owner = suffixes.merged([(x, np.full(len(x), k)) for k, x in enumerate(lists)])
    assert keys.tolist() == sorted(np.concatenate(lists).tolist()) and sorted(zip(keys.tolist(), owner.tolist(), strict=True)) == sorted((v, k) for k, x in enumerate(lists) for v in x.tolist())


def removed_by_loop(rows: list[tuple]) -> list[tuple]:
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - 399):
            seen[t[p : p + 400]] = seen.get(t[p : p + 400], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = b"\x01" * 400
        out.append((d, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.fixture(scope="module")
def repeats() -> list[tuple]:
    """Copies, near copies, passages around the limit in other surroundings, periodic texts, bytes beyond ASCII, blanks, a long text."""
    rng = random.Random(11)
    base = [said(rng, rng.randint(60, 500)) for _ in range(14)]
    passage = said(rng, 300)
    texts = [*base, base[0], base[1], None, None, "", " ", "short", "ab" * 700, "ab" * 330 + said(rng, 40), "é" * 500, "ü" + "é" * 230, "z" * 399, "z" * 400]
    texts += [said(rng, 50) + passage[:n] + said(rng, 70) for n in (395, 399, 400, 401, 405, 460, 520, 900)]
    for t in base[2:8]:
        for _ in range(2):
            at = rng.randrange(len(t))
            texts.append(t[:at] + rng.choice(["Q", "QQ", ""]) + t[at + 1 :])
    texts += [passage + passage, said(rng, 3000) + base[9] + said(rng, 900), base[10] + base[11], base[12][300:] + base[13][:700]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base[9]), (7, "other text " + base[10][100:800]), (3, base[3])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1_000_000, 2_000])
def test_without_repeats(spark, repeats, shard):
    want = sorted(removed_by_loop(repeats), key=repr)
    df = spark.createDataFrame(repeats, TEXT).selectExpr("*", "1 AS row", "'x' AS place", "0 AS n_bytes").repartition(5)
    got = sorted((tuple(r[:4]) + (bytes(r.kept),) for r in suffixes.without_repeats(df, shard).collect()), key=repr)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 20 and any(0 < r[2] < r[1] for r in want)


def test_without_repeats_of_nothing(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], TEXT)).count() == 0
    assert [tuple(r) for r in suffixes.without_repeats(spark.createDataFrame([(1, None)], TEXT)).collect()] == [(1, 0, 0, 0, bytearray())]


def test_hot_passage_and_many_copies(spark):
    """A passage in every document and one large group of copies, over more tasks than one."""
    rng = random.Random(5)
    passage, copy = said(rng, 110), said(rng, 200)
    rows = [(i, f"{said(rng, 30)} {passage} {said(rng, 30)}" if i % 2 else copy) for i in range(120)]
    got = sorted((tuple(r[:4]) + (bytes(r.kept),) for r in suffixes.without_repeats(spark.createDataFrame(rows, TEXT).repartition(7), 3_000).collect()), key=repr)
    assert got == sorted(removed_by_loop(rows), key=repr)


# --- fill in the middle --------------------------------------------------------------------------

def filled_by_loop(d: int | None, t: str | None) -> tuple:
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
    h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (d, n, "plain", None, None, t)
    return (d, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (d, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rng = random.Random(3)
    odd = [None, "", " ", "\t\n", "x", " x", "x ", "<P>", "a <S> b", "<M", "a<P", "S>", "<x>", "é ü", "日本 語 x\x00y  ", "  a  b  ", "a" * 700, " " * 700, "é" * 600 + " b", "\x0b\x0c", "a b c", "𝄞 𝄞𝄞 " * 90]
    texts = [*odd, *odd, *(said(rng, rng.randint(1, 400)).replace("a", rng.choice(["a", "é", "語"])) + rng.choice(["", " ", "\n\n"]) for _ in range(200)), said(rng, 30000)]
    rows = [*((i, t) for i, t in enumerate(texts)), (None, "a b c d"), (5, "again x y"), (5, "again x y"), (-3, "one two three"), (10**15, said(rng, 9))]
    df = spark.createDataFrame(rows, TEXT).selectExpr("*", "'x' AS form", "1 AS n", "2 AS h1").repartition(4)
    found = fim.fill_in_middle(df).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted((filled_by_loop(*r) for r in rows), key=repr)
    assert sorted((r.back for r in found)) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"} and fim.fill_in_middle(df.limit(0)).count() == 0
    assert {r.form for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}


def test_descent_finds_every_boundary():
    rng = random.Random(8)
    texts = ["", "a", said(rng, 400), " ", "  x y  ", "é " * 300, said(rng, 33)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    ends, starts = fim.unit_ends(data, at), data & 0xC0 != 0x80
    for block in (1, 2, 7, 256):
        trees = fim.grown(ends, starts, at, block)
        for t, text in enumerate(texts):
            units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
            k = np.arange(len(units) + 1)
            byte, points = fim.boundaries(trees, ends, starts, at, np.full(len(k), t), k, block)
            heads = ["".join(units[:i]) for i in k]
            assert (byte - at[t]).tolist() == [len(h.encode()) for h in heads] and points.tolist() == [len(h) for h in heads]


# --- ranked search -------------------------------------------------------------------------------

def ranked_by_loop(docs: list[tuple], items: list[tuple], k: int = 20) -> set:
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    rows = [(d, terms(t)) for d, t in docs if d is not None and terms(t)]
    n_docs, length = len(rows), sum(len(w) for _, w in rows)
    df: dict[str, int] = {}
    for _, w in rows:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    least: dict[int, str] = {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(least.get(i, t), t)
    out = set()
    for i, t in least.items():
        scores = []
        for d, w in rows:
            m = 100 - 25 + (25 * len(w) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * w.count(x)) // (1000 * w.count(x) + 12 * m)) for x in terms(t) if x in df)
            if score > 0:
                scores.append((-score, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("shard,leaf", [(8192, 64), (64, 4), (40, 1)])
def test_ranked_search(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(fptree.Shard.__init__, "__defaults__", (leaf,))
    rng = random.Random(17)
    rare = [f"term{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(rare) if rng.random() < 0.1 else w for w in said(rng, rng.randint(1, 60)).split())) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(90)]  # ties beyond the limit
    docs += [(2000, None), (2001, ""), (2002, "... --"), (None, docs[5][1]), (2003, "TERM1 Term1 É é term1"), (2004, " ".join(rare) * 3), (2005, said(rng, 5000))]
    items = [(i, " ".join([*rng.sample(rare, 4), *said(rng, 6).split()])) for i in range(12)]
    items += [(50, docs[5][1]), (51, "unknown words"), (52, None), (53, ""), (None, "term1"), (54, "term1 TERM1 é"), (55, "term2"), (55, "term1"), (56, "ba " * 30)]
    df = spark.createDataFrame(docs, TEXT).selectExpr("*", "1 AS score", "'x' AS ids").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank")
    want = ranked_by_loop(docs, items)
    assert {tuple(r) for r in fptree.ranked(df, it, shard=shard).collect()} == want
    if shard == 64:
        assert {tuple(r) for r in fptree.ranked(df, it, shard=shard, item_words=40).collect()} == want
        assert {tuple(r) for r in fptree.ranked(df, it, k=3).collect()} == {r for r in want if r[1] <= 3}
        assert fptree.ranked(df.limit(0), it).count() == 0 and fptree.ranked(df, it.limit(0)).count() == 0


def test_repeated_documents_have_their_own_ranks(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c d e")], TEXT)
    got = [tuple(r)[:3] for r in fptree.ranked(docs, spark.createDataFrame([(9, "a")], "item_id long, text string")).orderBy("rank").collect()]
    assert got == [(9, 1, 1), (9, 2, 1)]
