"""Each operator on small inputs, against plain loops where those can say what is right."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wickspark.llm import components, decontamination, langid, mixing, neardup, pages, quality, secrets, substrings, topk, urls
from wickspark.llm.markup import FEATURES
from wickspark.llm.words import ALNUM, LOWER_SPACED, SPACED, grams, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a, b in itertools.product("bcdfg", ["a", "e", "io", "u"])]


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def said(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, a repeated line, nulls, blanks, odd white space, one long text."""
    rng = random.Random(4)
    base = [said(rng, rng.randint(1, 90)) for _ in range(40)]
    passage, texts = said(rng, 30), list(base)
    texts += base[:6] + [f"{t} {passage} {said(rng, 5)}" for t in base[6:14]] + [f"{passage}\n{passage}"]
    for t in base[14:24]:
        words = t.split()
        words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    texts += [None, "", " \t\n\x0b\r ", "x", "Ba be\x00x bE", "é ü ba be", "no " * 60, said(rng, 4000), base[0].upper()]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_words_are_those_of_the_patterns(corpus):
    texts = [r[1] for r in corpus]
    for kind, pattern, change in ((SPACED, r"[^\x20\x09-\x0D]+", str), (LOWER_SPACED, r"[^\x20\x09-\x0D]+", lowered), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)):
        got, hashes = [], {}
        for words in words_of(pa.array(texts, pa.string()), kind, size=200):
            for t in range(words.count):
                a, b = words.bounds[t], words.bounds[t + 1]
                got.append(words.joined(a, b).decode().split(" ") if b > a else [])
                for w, h in zip(got[-1], words.hash[a:b].tolist(), strict=True):
                    assert hashes.setdefault(w, h) == h
        assert got == [re.findall(pattern, change(t or "")) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_grams_depend_on_the_words_only():
    a, b = (next(iter(words_of(pa.array([t]), SPACED))) for t in ("q q a b c d", "a b c d"))
    assert grams(a, 3)[0][2:4].tolist() == grams(b, 3)[0][:2].tolist()
    assert grams(b, 3)[1].tolist() == [True, True, False, False] and not grams(b, 5)[1].any()


def test_fingerprints_are_the_least_grams_of_windows():
    words = next(iter(words_of(pa.array([said(random.Random(2), 300), "ba be bio", "ba " * 40, said(random.Random(3), 13)]), ALNUM)))
    hashes, (_, whole) = grams(words, 8)[0], grams(words, 13)
    want = {}
    for w in np.flatnonzero(whole):
        want.setdefault(min(range(w, w + 6), key=lambda p: (hashes[p], p)), []).append(w)
    got = decontamination.fingerprints(words, 13, 8)
    assert [(a, m, h) for a, m, h in zip(*(x.tolist() for x in got), strict=True)] == [(w[0], len(w), hashes[p]) for p, w in sorted(want.items(), key=lambda x: x[1])]
    assert sum(got[1]) == whole.sum() > 1.5 * len(got[0]) and all(w == list(range(w[0], w[0] + len(w))) for w in want.values())


def test_contamination(spark, corpus):
    rng = random.Random(8)
    docs = [(r[0], r[1]) for r in corpus]
    items = [(1, said(rng, 40)), (2, docs[3][1]), (3, "ba be"), (10, said(rng, 13)), (4, None), (5, "..."), (None, "ba"), (2, docs[3][1])]
    docs += [(500, f"{said(rng, 20)}, {items[0][1].upper()[40:130]} {said(rng, 9)}"), (501, items[3][1]), (502, f"{said(rng, 900)} {items[3][1]}"), (500, "ba BE"), (None, items[3][1])]
    pattern, spans = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", {}
    for i, t in items:
        w = re.findall(pattern, lowered(t))
        for p in range(max(1, len(w) - 12)) if w and i is not None else []:
            spans.setdefault(tuple(w[p : p + 13]), set()).add(i)
    want = []
    for d, t in docs:
        w, hit, found = re.findall(pattern, lowered(t)), set(), set()
        for n in {len(s) for s in spans}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in spans:
                    hit |= set(range(p, p + n))
                    found |= spans[tuple(w[p : p + n])]
        want.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("x"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in decontamination.contamination(df, it).collect()), key=key) == sorted(want, key=key)
    assert sorted((tuple(r) for r in decontamination.contamination(df, it, bits=8).collect()), key=key) == sorted(want, key=key)
    assert decontamination.contamination(df.limit(0), it).count() == 0
    assert not decontamination.contamination(df, it.limit(0)).filter("n_hit > 0 OR contaminated").count()


def test_substring_dedup(spark, corpus):
    docs = [(r[0], r[1]) for r in corpus] + [(None, corpus[0][1]), (None, None)]
    first, split = {}, {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs if d is not None}
    for d in sorted(split):
        for p in range(len(split[d]) - 19):
            first.setdefault(tuple(split[d][p : p + 20]), (d, p))
    want = {}
    for d, w in split.items():
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (d, p) for q in range(p, p + 20)}
        want[d] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    got = substrings.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.lit("x"))).collect()
    assert len(got) == len(docs) and {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id is None) == sorted([(0, 0), (len((corpus[0][1] or "").split()), 0)])
    twice = substrings.substring_dedup(spark.createDataFrame([(7, corpus[-1][1] or said(random.Random(1), 50))] * 2, "doc_id long, text string")).collect()
    assert [r.n_removed for r in twice] == [twice[0].n_removed] * 2
    assert substrings.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_meets_every_difference():
    cover = np.flatnonzero(substrings.COVER)
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))
    assert substrings.PERIOD - 1 + substrings.ANCHOR <= substrings.WINDOW


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(5, 5)]
    rng.shuffle(links)
    root = {n: n for link in links for n in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in root.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_by_loop(rows: list[tuple], size: int) -> dict:
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {d: (len(s), root[d], root[d] == d) for d, s in sets.items()}


def test_near_duplicates(spark, corpus):
    rng, rows = random.Random(12), [(r[0], r[1]) for r in corpus]
    base = said(rng, 120).split()
    for k in range(60):  # from close copies to far ones, some linked only through others
        words = list(base)
        for _ in range(rng.randint(1, 12)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        rows.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame([*rows, (None, rows[0][1]), rows[0]], "doc_id long, text string").withColumn("node", F.lit("x"))
    got = neardup.near_duplicates(df).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == near_by_loop(rows, 4)
    assert len(got) == len(rows) + 2 and [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_a_bucket_meet_each_other(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rows = [(r[0], r[1]) for r in corpus]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == near_by_loop(rows, 4)


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-2, 2)]) for _ in range(8)]) for i in range(130)]
    rows += [(200, None), (201, [1.0, None] + [0.0] * 6), (220, [float("nan")] * 8), (240, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), rows[5], (260, [])]
    usable = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in usable if i % 20 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=False)), i) for i, v in usable.items() if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    for sizes in ({}, {"block": 2, "chunk": 9}):
        assert {tuple(r) for r in topk.top_k(df, **sizes).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).collect() == [(0, 1, 1, 64 * 128)]


def test_url_rules(spark):
    given = ["http://A.Example.ORG/es/x?q", "https://example.org/en/12", "http://example.org", "http://x.com/de/", "http://com/fr/a", "http://fr.org/a#/es/", "nothing", None, "", "://", "http://notexample.org/es/", "http://u.example.org:80/es/", "http://.org/a", "http://x.com/de/", "http://a.net/"]
    rows = [(i, u) for i, u in enumerate(given)]

    def by_loop(url: str | None) -> tuple:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = lowered(host)
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[3:] if fit else (None, "allow")))

    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x"))
    rules = spark.createDataFrame(urls.RULES, urls.RULE_COLUMNS)
    assert {r[0]: tuple(r)[1:] for r in urls.url_verdicts(df, rules).collect()} == {i: by_loop(u) for i, u in rows}
    assert {r.verdict for r in urls.url_verdicts(df, rules.limit(0)).collect()} == {"allow"}
    assert urls.url_verdicts(df.limit(0), rules).count() == 0
    tie = spark.createDataFrame([("b.org", "/", "allow"), ("b.org", "/", "block"), (None, "/", "block")], urls.RULE_COLUMNS)
    assert urls.url_verdicts(spark.createDataFrame([(1, "http://b.org/")], "page_id long, url string"), tie).first().verdict == "block"


def test_targets_fill_up(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 500), (None, 50), ("e", 0)]
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    total, size = 1.5 * sum(n for _, n in sizes), dict(sizes)
    target, open_ = {}, set(size)
    while True:  # give by weight; who is above the limit stops there, the rest is shared again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * size[s]}
        if not above:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in above}
        open_ -= above
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(total)


def test_mix_takes_what_it_should(spark):
    rng = random.Random(9)
    rows = [(i, said(rng, rng.randint(0, 60)), "en", "big" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c"]), 0) for i in range(900)] + [(None, None, None, None, None), (3, "x", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and 0 <= r.mix_copies <= 2
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        taken = sum(r.mix_copies * r.mix_size for r in rs)
        assert rs[0].mix_source_size == sum(r.mix_size for r in rs) and taken == pytest.approx(rs[0].mix_target, rel=0.03)
    again = {r.doc_id: r.mix_copies for r in mixing.mix(df.repartition(5)).collect() if r.doc_id != 3}
    assert again == {r.doc_id: r.mix_copies for r in got if r.doc_id != 3}
    assert mixing.mixed_documents(df).count() == sum(r.mix_copies for r in got) and mixing.mix(df.limit(0)).count() == 0


def test_languages(spark):
    rng = random.Random(2)
    word = {"xx": lambda: rng.choice(["ma", "lo", "ki", "ranu"]) + rng.choice(["ta", "no"]), "yy": lambda: rng.choice(["sch", "gr", "pf"]) + rng.choice(["ü", "ö", "ein"]) + "t"}
    rows = [(i, " ".join(word[l]() for _ in range(rng.randint(3, 40))), None if i % 11 == 0 else l, l, 0) for i in range(240) for l in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx", "xx", 0), (901, "123 ... 4", "xx", "xx", 0), (902, "", None, "xx", 0), (None, "mata", "xx", "xx", 0)]
    got = langid.languages(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        held = r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.lid_held_out == held and 0 <= r.lid_score <= 1
        assert r.lid_pred == ("und" if r.doc_id in (900, 901, 902) else r.source)
    nothing = langid.languages(spark.createDataFrame([(1, "abc", None, "s", 3)], DOCS)).first()
    assert (nothing.lid_pred, nothing.lid_score) == ("und", 0.0)
    assert langid.languages(spark.createDataFrame([], DOCS)).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    rows = [(i, said(rng, rng.randint(3, 60)) if i % 3 else "".join(w + rng.choice(["%%%", "###"]) + " " for w in said(rng, rng.randint(3, 60)).split())) for i in range(400)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(380)] + [(5000, 1, 0), (1, None, 0), (None, 1, 0)]
    got = {r.doc_id: r for r in quality.qualities(spark.createDataFrame([*rows, (600, None), (601, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    right = [got[i].predicted == int(i % 3 > 0) for i in range(400) if got[i].held_out]
    assert len(got) == 402 and np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values()) and got[600].score == got[601].score
    blank = quality.qualities(spark.createDataFrame(rows[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in blank} == {0.5}


def test_labels_whose_first_rows_are_long(spark, monkeypatch):
    monkeypatch.setattr(langid, "LONGEST", 200)
    monkeypatch.setattr(quality, "LONGEST", 200)
    pieces = {"xx": "mata loki ranu", "yy": "schüt gröt pfeint"}
    short = [(i, pieces[l], l, "s", 0) for i in range(400) for l in [("xx", "yy")[i % 2]]]
    order = [r.doc_id for r in spark.range(400).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))).collect()]
    long = {i for i in order if i % 2 == 0} - {i for i in order if i % 2 == 0 and i in order[-100:]}
    docs = spark.createDataFrame([(i, t * 20 if i in long else t, *rest) for i, t, *rest in short], DOCS)
    got = langid.languages(docs, per_language=10).collect()
    assert {(r.lang, r.lid_pred) for r in got} == {("xx", "xx"), ("yy", "yy")}
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    assert all(r.predicted == r.doc_id % 2 for r in quality.qualities(docs.select("doc_id", "text"), labels, per_label=10).collect())


def test_dual_descent_finds_the_margin():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0])), (np.array([0]), np.array([2.0])), (np.array([1]), np.array([2.0]))]
    w, b = quality.dual_descent(rows, np.array([1, -1, 1, -1]), 2, cost=10.0, rounds=500)
    assert w[0] + b >= 0.99 and w[1] + b <= -0.99 and w == pytest.approx([1, -1], abs=0.02)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy this now!</div><article><h1>A   title &amp; more</h1><p>First one,\n with\tspace &lt;b&gt;.<br>Second &quot;line&quot; of it.<p><b>Unclosed paragraph of text, it goes on.</article>
<section class="comments"><h3>Comments</h3><p>I disagree with all of this.</p></section><footer>&copy; 2020 someone &middot; all rights</footer></body></html>"""


def test_html(spark):
    want = 'A title & more\nFirst one, with space <b>. Second "line" of it.\nUnclosed paragraph of text, it goes on.'
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", PAGE[: PAGE.index("</article>")]), (5, "x", "<p"), (6, "y", "<nav>" * 3000 + "a"), (1, "u", PAGE)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id, r.text) for r in got if r.page_id < 5) == sorted([(1, want), (1, want), (2, ""), (3, ""), (4, want)]) and len(got) == 7
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_inline_elements_keep_their_text():
    model = pages.trained()
    for tag in ("math", "svg", "object", "canvas"):
        texts, features = pages.blocks(PAGE.replace("First one", f"First <{tag} class='x'><mi>E = mc</mi></{tag}> one"))
        kept = [t for t, label in zip(texts, model.viterbi(model.emissions(features)), strict=True) if label]
        assert kept == ["A title & more", 'First E = mc one, with space <b>. Second "line" of it.', "Unclosed paragraph of text, it goes on."], tag
        texts, features = pages.blocks(PAGE.replace("<article>", f"<{tag}><article>"))
        kept = [t for t, label in zip(texts, model.viterbi(model.emissions(features)), strict=True) if label]
        assert kept == ["A title & more", 'First one, with space <b>. Second "line" of it.', "Unclosed paragraph of text, it goes on."], tag
    for tag in ("script", "style", "template", "textarea", "title", "iframe", "noscript"):
        assert pages.blocks(f"<p>a <{tag}>gone</{tag}> b</p>")[0] == ["a b"]
    named = lambda text: {FEATURES[k] for k in pages.blocks(f"<p>{text}</p>")[1][0]}
    assert "rights" in named("some words " * 30 + "all rights reserved") and "no letters" not in named("12 " * 100 + "a") and "no letters" in named("12 " * 100)


def test_hostile_pages_take_linear_time():
    size = 1_000_000
    shapes = [
        "<div>x" * (size // 6), "<b>" * (size // 12) + "<p>x</p>" * (size // 12), "<b>" * (size // 7) + "</i>" * (size // 7), "<nav class='menu side'>x" * (size // 25), "<li>x" * (size // 5),
        "<table>" * (size // 14) + "<td>x" * (size // 10), "<a '" * (size // 4), "<!--" * (size // 4), "<a " + "b" * size + ">", "<a " + "b=" * (size // 2) + ">", "<title>" * (size // 7), "&" * size,
    ]
    for page in shapes:
        start = time.process_time()
        pages.blocks(page)
        assert time.process_time() - start < 8, page[:20]  # seconds; a walk of all open elements for each tag takes minutes
    assert pages.blocks("<p>a&#" + "9" * 5000 + ";b&#" + "0" * 5000 + "65;c &#65 &#x41; &#; &amp;")[0] == ["a\ufffdbAc A A &#; &"]


def test_field_on_pages_it_has_not_seen():
    model, wrong, n = pages.trained(), 0, 0
    for page, marks in pages.labelled_pages(60, seed=123):
        texts, features = pages.blocks(page)
        labels = [max(marks[m] for m in re.findall(r"q\d+q", t)) for t in texts]
        wrong, n = wrong + sum(a != b for a, b in zip(model.viterbi(model.emissions(features)), labels, strict=True)), n + len(labels)
    assert wrong <= 0.02 * n


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    model = pages.Model(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))
    features = [[int(k)] for k in rng.integers(0, 4, 7)]
    scores = model.emissions(features)
    value = lambda s: sum(scores[t, k] for t, k in enumerate(s)) + sum(model.step[a, b] for a, b in itertools.pairwise(s))
    assert value(model.viterbi(scores)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=7))))


def test_secrets(spark):
    key, hexes = "AKIA" + "Q7" * 9, "0123456789abcdef" * 2
    texts = [f"é token: '{hexes}', {key} {key[:10]}", "Password=short secret= abcdef api-key: x", f"{hexes[:23]} {hexes[:24]}{hexes[:2]}z", f"apikey=\"{key}\" TOKEN : a.b/c+d=", None, "", "plain words only, nothing else", "pasſword=abcdefgh toKen=abcdefgh", "x" * 50000 + hexes, "AKIA"]
    rng, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = ["see ghp_" + "".join(rng.choice(letters) for _ in range(36)) + " ok" for _ in range(12)]
    texts += ["an-ordinary-page-name-2020 here", *made]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secret_x", F.lit(1))).collect()}
    for i, text in enumerate(texts):
        want = []
        for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
            want += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in got[i].secret_base] == sorted(want), text
        assert all(s in got[i].secret_spans for s in got[i].secret_base)
    caught = [i for i in range(11, 23) if [(s.kind, s.start, s.end) for s in got[i].secret_spans] == [("network", 4, 44)]]
    assert len(caught) >= 11 and not got[10].secret_spans
    clean = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert clean[6] == texts[6] and clean[4] is None and hexes not in clean[0] and clean[0].startswith("é [secret]") and clean[caught[0]] == "see [secret] ok"
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_far_into_a_run(spark):
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    paths = [("org/customers/documents/archive/reports/backup/" * 5)[-n:] for n in (45, 200)]
    keys = ["ghp_" + "".join(rng.choice(letters) for _ in range(36)) for _ in range(6)]
    texts = [f"see {path}{key}{tail} ok" for path in paths for tail in ("", "/readme") for key in keys] + [f"see {path}readme2 ok" for path in paths]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for number, text in enumerate(texts):
        assert got[number] == ([("network", 4, len(text) - 3)] if number < 24 else []), text
    for a, b in ((0, 40), (3, 44), (7, 90), (0, 201)):
        reached = {k for s in secrets.window_starts(a, b) for k in range(s, min(b, s + secrets.OWN))}
        assert reached == set(range(a, b)) and secrets.window_starts(a, b)[-1] in (a, b - secrets.OWN)


def test_candidates_beside_base_spans(spark):
    hexes, access, rest = "0123456789abcdef" * 2, "AKIA" + "Q7" * 8, "Zk9Qw7RtY2LmNp8XsVb3"
    texts = [f"see {hexes}-{rest} ok", f"see {access}/{rest}{rest[::-1]} ok", f"see {rest[:9]}{hexes}{rest[9:]} ok", f"see {hexes} ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for number, text in enumerate(texts):
        assert len(got[number].secret_base) == 1
        network = [(s.start, s.end) for s in got[number].secret_spans if s.kind == "network"]
        assert network == ([(4, len(text) - 3)] if number < 3 else []), text
    assert {r.text for r in secrets.redacted(docs).collect()} == {"see [secret] ok"}


def test_gradients_of_the_network():
    net, rng = secrets.Net.new(3, 4), np.random.default_rng(0)
    x, y = rng.integers(0, secrets.CLASSES, (3, secrets.WIDTH)), np.array([1.0, 0.0, 1.0])
    loss = lambda: np.mean(np.logaddexp(0, net.forward(x)[0]) - y * net.forward(x)[0])
    margin, cache = net.forward(x)
    slopes = net.slopes(cache, (1 / (1 + np.exp(-margin)) - y) / 3)
    for value, slope in zip((net.embed, net.conv, net.conv_bias, net.dense, net.bias), slopes, strict=True):
        for at in rng.integers(0, value.size, 6):
            held = value.flat[at]
            value.flat[at] = held + 1e-5
            up = loss()
            value.flat[at] = held - 1e-5
            down = loss()
            value.flat[at] = held
            assert slope.flat[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_digest_columns(spark, corpus, tmp_path):
    from wickspark.llm import queries

    spark.createDataFrame(corpus, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, corpus[0][1]), (2, "ba be")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = {x.doc_id: x for x in queries.op2_substring_dedup(spark, str(tmp_path)).collect()}
    kept = {x.doc_id: x.kept for x in substrings.substring_dedup(spark.createDataFrame(corpus, DOCS)).collect()}
    assert all(r[d].kept_sha256 == hashlib.sha256(k.encode()).hexdigest() for d, k in kept.items())
    one = {x.doc_id: x for x in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    assert all((x.items_sha256 == hashlib.sha256(b"").hexdigest()) == (x.n_items == 0) for x in one.values())
