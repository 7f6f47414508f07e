"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each leaf block of the page is main text or not. Features are its ancestors' tags, what their class, id and role say, and
how its text looks; neighbouring blocks depend on each other through transition weights. The field is trained by gradient
ascent on labelled pages and decoded by Viterbi.

The labelled pages are laid out here: templates of many layouts whose blocks are labelled by hand, filled with invented words in
the way the texts of any language look to the features. The given tables have no such labels.

Scale: a map without shuffle over whole pages; the model is some dozen numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wickspark.llm.frames import small_batches
from wickspark.llm.markup import FEATURES, blocks

PAGES, ROUNDS, DECAY = 300, 120, 1e-3


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray

    def emissions(self, features: list[list[int]]) -> np.ndarray:
        """Score of each block being main text or not: (blocks, 2)."""
        starts = np.append(0, np.cumsum([len(f) for f in features])[:-1])
        return np.add.reduceat(self.weights[np.concatenate([np.array(f) for f in features])], starts, axis=0)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Labels of the likeliest sequence."""
        (a, b), (c, d) = self.step.tolist()
        rows = scores.tolist()
        x, y = rows[0]
        back = []
        for p, q in rows[1:]:
            back.append((int(y + c > x + a), int(y + d > x + b)))
            x, y = max(x + a, y + c) + p, max(x + b, y + d) + q
        label = int(y > x)
        out = [label]
        for both in reversed(back):
            label = both[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, decay: float = DECAY) -> Model:
    """Gradient ascent on the pages' mean log-likelihood; all pages at once, padded to the longest."""
    n, longest, size = len(pages), max(len(y) for _, y in pages), len(FEATURES)
    x, y, real = np.zeros((n, longest, size), np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (features, labels) in enumerate(pages):
        for t, own in enumerate(features):
            x[i, t, own] = 1
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    w, s = np.zeros((size, 2)), np.zeros((2, 2))
    given = np.eye(2)[y] * real[:, :, None]
    pairs = real[:, 1:] & real[:, :-1]
    seen = np.einsum("nta,ntb,nt->ab", given[:, :-1], given[:, 1:], pairs.astype(float))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    for round_no in range(1, rounds + 1):
        score = x @ w
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            nxt = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + s, axis=1)
            ahead[:, t] = np.where(real[:, t, None], nxt, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(s[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], nxt, 0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - whole[:, None, None]) * real[:, :, None]
        joint = np.exp(ahead[:, :-1, :, None] + s + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * pairs[:, :, None, None]
        for k, (value, slope) in enumerate(((w, np.einsum("ntf,ntk->fk", x, given - share) / n - decay * w), (s, (seen - joint.sum(axis=(0, 1))) / n - decay * s))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += 0.1 * (m / (1 - 0.9**round_no)) / (np.sqrt(v / (1 - 0.99**round_no)) + 1e-8)
    return Model(w, s)


#: Layouts of the labelled pages: + before a block that is main text, - before one that isn't. Kinds of text: S some sentences, s
#: a short sentence, w a few words, l a link list item, L some words with links.
_TOP = ("-<nav><ul>{l}{l}{l}{l}</ul></nav>", "-<header><h1>{w}</h1><p>{s}</p></header>", '-<div class="menu"><a href="/">{w}</a> <a href="/x">{w}</a></div>', '-<div id="topbar"><span>{w}</span></div>',
        '-<div role="navigation"><ul>{l}{l}{l}</ul></div>', "-<header><nav><ul>{l}{l}{l}</ul></nav></header>", '-<div class="breadcrumbs">{L}</div>', '-<div class="cookie-notice"><p>{s}</p><button>{w}</button></div>')
_AROUND = ('-<div class="ad">{s}</div>', '-<div class="ads sponsored"><p>{S}</p></div>', '-<aside><h3>{w}</h3><p>{S}</p></aside>', '-<div id="sidebar"><h3>{w}</h3><ul>{l}{l}{l}</ul><p>{s}</p></div>', "-<form><label>{w}</label><button>{w}</button></form>",
           '-<div class="newsletter"><p>{s}</p></div>', '-<div class="related"><h4>{w}</h4><ul>{l}{l}</ul></div>', '-<div class="share-buttons">{L}</div>', '-<div class="promo"><p>{S}</p></div>')
_BOTTOM = ("-<footer><p>&copy; {w} &middot; {s}</p></footer>", '-<div id="footer"><p>{s}</p><ul>{l}{l}</ul></div>', "-<footer>{s}</footer>", '-<div class="copyright">&copy; {w}</div>')
_REPLIES = ('-<section class="comments"><h3>{w}</h3><div class="comment"><p>{S}</p></div><div class="comment"><p>{s}</p></div></section>', '-<div id="comments"><ol><li><p>{S}</p></li><li><p>{s}</p></li></ol><form><label>{w}</label></form></div>')
_OPEN = (("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"), ('<div class="entry-content">', "</div>"), ("<article><section>", "</section></article>"), ("<div>", "</div>"))
_BODY = ("+<p>{S}</p>", "+<p>{S}</p>", "+<p>{S}</p>", "+<p>{s}</p>", "+<p>{w}.</p>", "+<h2>{w}</h2>", "+<p><b>{S}<br>", "+<blockquote><p>{S}</p></blockquote>", "+<ul><li>{s}</li><li>{w}</li></ul>", "+<table><tr><td>{w}</td><td>{s}</td></tr></table>", "+<pre>{s}</pre>", "+<p>{S} {L} {s}</p>", "+<div>{S}</div>")


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, dict[str, int]]]:
    """Pages, and for each the label of every marker word in them (a block holds one at least)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    out = []
    for _ in range(n):
        marks: dict[str, int] = {}

        def words(low: int, high: int, label: int, marks: dict[str, int] = marks) -> str:
            said = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(rng.integers(low, high + 1))]
            said[rng.integers(len(said))] = mark = f"q{len(marks)}q"
            marks[mark] = label
            return " ".join(said)

        def filled(piece: str) -> str:
            label = int(piece[0] == "+")
            kinds = {
                "S": lambda: ". ".join(words(6, 30, label) for _ in range(rng.integers(1, 6))) + ".",
                "s": lambda: words(3, 12, label) + (". " if rng.random() < 0.8 else ""),
                "w": lambda: words(1, 4, label),
                "l": lambda: f'<li><a href="/x">{words(1, 3, label)}</a></li>',
                "L": lambda: f'<a href="/x">{words(1, 3, label)}</a> <a href="/y">{words(1, 3, label)}</a>',
            }
            return re.sub(r"\{(\w)\}", lambda m: kinds[m[1]](), piece[1:])

        opened, closed = pick(_OPEN)
        plain = opened == "<div>"
        body = ["+<h1>{w}</h1>" if rng.random() < 0.7 else "+<p>{S}</p>", *(pick(_BODY) for _ in range(rng.integers(1, 12)))]
        if plain:
            body = [b for b in body if "{S}" in b or "<h1" in b] or ["+<p>{S}</p>"]
        if rng.random() < 0.35:
            body.insert(int(rng.integers(1, len(body) + 1)), pick(_AROUND))
        parts = [filled(pick(_TOP)) for _ in range(rng.integers(0, 4))] + [filled(pick(_AROUND)) for _ in range(rng.integers(0, 2))]
        parts += [opened, *(filled(b) for b in body), closed]
        parts += [filled(pick(_REPLIES))] * int(rng.random() < 0.3) + [filled(pick(_AROUND)) for _ in range(rng.integers(0, 3))] + [filled(pick(_BOTTOM)) for _ in range(rng.integers(0, 2))]
        out.append((f"<html><head><title>t</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>", marks))
    return out


def trained(pages: int = PAGES) -> Model:
    examples = []
    for page, marks in labelled_pages(pages):
        texts, features = blocks(page)
        labels = [max(marks[m] for m in re.findall(r"q\d+q", t)) for t in texts]
        if texts:
            examples.append((features, labels))
    return fit(examples)


def main_text(page: str | None, model: Model) -> str:
    texts, features = blocks(page or "")
    if not texts:
        return ""
    return "\n".join(t for t, label in zip(texts, model.viterbi(model.emissions(features)), strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. A row for each row of pages: page_id, url, text (main blocks joined by a line feed; may be empty).

    Null, empty and tagless html is taken as it is: text without tags is one block. Broken markup is closed as browsers do in
    the main cases. Repeated rows get equal answers. No rows: no rows.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.selectExpr("cast(page_id AS bigint) AS page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
