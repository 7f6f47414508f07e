"""Secret scan: base patterns, and a character convolutional network over further candidates with their context.

Base patterns are settled rules and always count. Candidates are runs of key characters with letters and digits in them.
The network reads a window of characters around a candidate (what stands before it, its own, what follows) as classes,
convolves, pools, and gives a margin; a logistic curve makes it a probability, and the threshold is the highest that
still finds RECALL of the labelled findings kept aside. A candidate of more than OWN characters is read in windows that
overlap by half up to its end, and the highest probability counts.

Labelled findings: the base patterns' values in a bounded sample of documents and made-up keys in common formats are findings;
made-up long words, names with numbers, paths, dates and counts aren't. What else the sample holds is not labelled and not used.

Scale: a map without shuffle over whole texts. Byte tests on the Arrow buffer find the few texts that need a regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickspark.llm.frames import small_batches
from wickspark.llm.quality import logistic
from wickspark.llm.words import buffers, slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SAMPLE, LONGEST, BEFORE, OWN, AFTER, RECALL, SHORT_RUN = 2000, 100_000, 20, 40, 8, 0.99, 16
AT_ONCE = 2048
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters that hold a letter and a digit."""
    return [m.span() for m in _CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]


def _classes() -> np.ndarray:
    """Code point below 128 -> class: each letter and digit its own, marks of their own, others by kind. 0 is outside."""
    out = np.ones(128, np.int64)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        out[ord(c)] = 2 + k
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[ord(c)] = 38 + ord(c) - 65
    for k, c in enumerate(" =:\"'_-+/.,@"):
        out[ord(c)] = 64 + k
    out[10] = out[9] = 64
    return out


_CLASS, CLASSES, WIDTH = _classes(), 77, BEFORE + OWN + AFTER


def window(text: str, start: int, end: int) -> np.ndarray:
    """Classes of the characters before, within (the first OWN of them) and after; places without a character are 0."""
    out = np.zeros(WIDTH, np.int64)
    for at, part in ((BEFORE - min(BEFORE, start), text[max(0, start - BEFORE) : start]), (BEFORE, text[start : min(end, start + OWN)]), (BEFORE + OWN, text[end : end + AFTER])):
        codes = np.array([ord(c) for c in part], np.int64)
        out[at : at + len(part)] = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 76)
    return out


def window_starts(start: int, end: int) -> list[int]:
    """Where windows over a candidate begin: each OWN / 2 characters, the last one so that it ends with the candidate."""
    return [start] if end - start <= OWN else [*range(start, end - OWN, OWN // 2), end - OWN]


@dataclass
class Net:
    """Embedding, one convolution over five characters, rectifier, maximum and mean of the candidate's places and maximum of all, a dense layer."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    @classmethod
    def new(cls, width: int = 8, filters: int = 24, seed: int = 3) -> Net:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (CLASSES, width)), rng.normal(0, (5 * width) ** -0.5, (5 * width, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters), np.zeros(1))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        held = self.embed[np.pad(x, ((0, 0), (2, 2)))]
        patches = np.concatenate([held[:, k : k + x.shape[1]] for k in range(5)], axis=2)
        mapped = np.maximum(patches @ self.conv + self.conv_bias, 0)
        own = mapped[:, BEFORE : BEFORE + OWN]
        inside = (x[:, BEFORE : BEFORE + OWN] > 0)[:, :, None]
        count = np.maximum(inside.sum(axis=1), 1)
        pooled = np.concatenate([own.max(axis=1), (own * inside).sum(axis=1) / count, mapped.max(axis=1)], axis=1)
        return pooled @ self.dense + self.bias[0], (x, patches, mapped, own, inside, count, pooled)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[a : a + 512])[0] for a in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.shift, -30, 30)))

    def slopes(self, cache: tuple, error: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss, by embed, conv, conv_bias, dense, bias; error is the loss by the margins."""
        x, patches, mapped, own, inside, count, pooled = cache
        f = self.conv.shape[1]
        by_pool = error[:, None] * self.dense[None]
        by_map = np.zeros_like(mapped)
        rows, cols = np.arange(len(x))[:, None], np.arange(f)[None]
        by_map[rows, mapped.argmax(axis=1), cols] += by_pool[:, 2 * f :]
        by_map[:, BEFORE : BEFORE + OWN] += inside * (by_pool[:, f : 2 * f] / count)[:, None, :]
        by_map[rows, BEFORE + own.argmax(axis=1), cols] += by_pool[:, :f]
        by_map *= mapped > 0
        by_patch = by_map @ self.conv.T
        by_embed, width = np.zeros_like(self.embed), self.embed.shape[1]
        padded = np.pad(x, ((0, 0), (2, 2)))
        for k in range(5):
            np.add.at(by_embed, padded[:, k : k + x.shape[1]], by_patch[:, :, k * width : (k + 1) * width])
        return [by_embed, np.einsum("ntp,ntf->pf", patches, by_map), by_map.sum(axis=(0, 1)), pooled.T @ error, np.array([error.sum()])]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, recall: float = RECALL, seed: int = 5) -> Net:
    """Every fifth example is kept aside for the curve and the threshold. Without findings or without others the threshold is never met."""
    net, rng = Net.new(), np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~aside)
    if len(set(y[aside].tolist())) < 2:
        return net
    values = [net.embed, net.conv, net.conv_bias, net.dense, net.bias]
    first, square, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(rounds):
        order = rng.permutation(train)
        for a in range(0, len(order), 64):
            batch = order[a : a + 64]
            margin, cache = net.forward(x[batch])
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]) / len(batch)
            step += 1
            for v, s, m, q in zip(values, net.slopes(cache, error), first, square, strict=True):
                m += 0.1 * (s - m)
                q += 0.001 * (s * s - q)
                v -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    net.slope, net.shift = logistic(net.margins(x[aside]), y[aside].astype(float))
    findings = np.sort(net.probabilities(x[aside & (y == 1)]))
    net.threshold = float(findings[int((1 - recall) * len(findings))])
    return net


def _made_up(rng: np.random.Generator, n: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of invented findings and non-findings."""
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda letters, k: "".join(rng.choice(list(letters), k))
    word = lambda: draw(low, rng.integers(2, 10))
    length = lambda a, b: int(rng.integers(a, b))
    keys = (
        lambda: "ghp_" + draw(low + up + digits, 36), lambda: "sk-" + draw(low + up + digits, 40), lambda: "xoxb-" + draw(digits, 12) + "-" + draw(low + up + digits, 24), lambda: "AIza" + draw(low + up + digits + "_-", 35),
        lambda: draw(digits + "ABCDEF", length(32, 65)), lambda: draw(low + up + digits + "+/", length(32, 65)) + "=", lambda: "eyJ" + draw(low + up + digits + "_-", length(40, 80)), lambda: draw(low + up + digits, length(24, 49)),
    )
    plain = (
        lambda: word() + word() + word() + draw(digits, length(1, 5)), lambda: "/".join(word() for _ in range(5)) + "/" + draw(digits, 3), lambda: "-".join(word() for _ in range(4)) + "-" + draw(digits, 4),
        lambda: "_".join(word() for _ in range(4)) + draw(digits, 2), lambda: word().capitalize() + word() + word().capitalize() + word() + draw(digits, 2), lambda: draw(digits, 4) + "-" + draw(digits, 2) + "-" + draw(digits, 2) + "T" + draw(digits, 6) + "Z00",
        lambda: "a1-" + draw(digits, length(14, 24)), lambda: (word() + word() + word()).upper() + draw(digits, length(2, 5)), lambda: word() * 6 + draw(digits, 1), lambda: "=" * 20 + "a1",
    )
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.5)
        own = (keys if label else plain)[rng.integers(len(keys if label else plain))]()
        before = " ".join(word() for _ in range(6)) + str(rng.choice([" ", ": ", " = ", '="', " '", "\n", " key ", " https://"]))
        text = before + own + str(rng.choice([" ", ".", '"', "\n", ", "])) + word() + " " + word()
        out.append((text, len(before), len(before) + len(own), label))
    return out


def trained(texts: list[str]) -> Net:
    """texts: the sample. Findings are the values of its base spans; its other candidates may be either and teach nothing."""
    examples = _made_up(np.random.default_rng(11), 2000)
    for text in texts:
        spans = base_spans(text)
        examples += [(text, a if kind != "assign" else max(a, b - OWN), b, 1) for a, b, kind in spans]
    order = np.random.default_rng(13).permutation(len(examples))
    chosen = [examples[i] for i in order]
    return fit(np.stack([window(t, a, b) for t, a, b, _ in chosen]), np.array([label for *_, label in chosen]))


def _runs(inside: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Starts and ends of runs of at least so many bytes; a text's end ends a run."""
    broken = np.append(inside, False)
    start = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    end = np.flatnonzero(inside & ~broken[1:]) + 1
    inner = at[1:-1]
    extra = inner[(inner > 0) & (inner < len(inside))]
    extra = extra[inside[np.minimum(extra, len(inside) - 1)] & inside[np.maximum(extra - 1, 0)]]
    if len(extra):
        start, end = np.sort(np.append(start, extra)), np.sort(np.append(end, extra))
    long = end - start >= least
    return np.stack([start[long], end[long]])


def _table(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in letters]] = True
    return out


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_HEX_BYTE, _KEY_BYTE, _DIGIT_BYTE = _table(_DIGITS + "abcdef"), _table(_LOWER + _LOWER.upper() + _DIGITS + "+/_=-"), _table(_DIGITS)


def suspects(column: pa.Array) -> Iterator[tuple[int, bool, bool]]:
    """(number of the text, whether it may hold base spans, whether it may hold candidates) for texts that may hold any."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(part):
            continue
        base, more = np.zeros(b - a, bool), np.zeros(b - a, bool)
        owner = lambda x: np.searchsorted(at, x, side="right") - 1  # noqa: E731, B023
        base[owner(_runs(_HEX_BYTE[part], at, 24)[0])] = True
        runs = _runs(_KEY_BYTE[part], at, SHORT_RUN)
        digits = np.append(0, np.cumsum(_DIGIT_BYTE[part]))
        n = digits[runs[1]] - digits[runs[0]]
        more[owner(runs[0][(n > 0) & (n < runs[1] - runs[0])])] = True
        raw = part.tobytes()
        lowered = raw.lower()
        for word, where in [(b"AKIA", raw), *((w, lowered) for w in _WORDS)]:
            k = where.find(word)
            while k >= 0:
                base[owner(k)] = True
                k = where.find(word, k + 1)
        for t in np.flatnonzero(base | more):
            yield a + int(t), bool(base[t]), bool(more[t])


def _hits(net: Net, asked: Iterator[tuple[int, str, int, int]]) -> set[tuple[int, int, int]]:
    """asked: number of the text, text, start and end of a candidate. Those with a window at or over the threshold; at most
    AT_ONCE windows are held, however long a candidate is."""
    found: set[tuple[int, int, int]] = set()
    for part in batched(((t, text, a, b, s) for t, text, a, b in asked for s in window_starts(a, b)), AT_ONCE):
        hit = net.probabilities(np.stack([window(text, s, b) for _, text, _, b, s in part])) >= net.threshold
        found |= {(t, a, b) for (t, _, a, b, _), yes in zip(part, hit.tolist(), strict=True) if yes}
    return found


def find_secrets(docs: DataFrame, sample: int = SAMPLE, mark: str | None = None) -> DataFrame:
    """docs: doc_id, text and others. All columns of docs with secret_base and secret_spans (arrays of kind, start, end), a row for each.

    Spans count code points, end exclusive. secret_base: kinds assign, access and hex, by start and then kind as listed;
    secret_spans: these and the network's (kind network), which are whole candidates and may overlap base spans; a candidate
    within a base span isn't asked about. Null and empty texts have none. The
    network is fit on sample documents at most (smallest id hashes, texts of LONGEST characters at most). Repeated rows get equal answers. No rows:
    no rows, no findings in the sample: only made-up ones are learned. With mark, the columns are those of docs and the mark
    stands in place of each span of secret_spans (overlapping ones together).
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    chosen = [r.doc_id for r in own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    texts = own.filter(F.col("doc_id").isin(chosen) & (F.length("text") <= LONGEST)).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()["text"].tolist() if chosen else []
    sent = docs.sparkSession.sparkContext.broadcast(trained(texts))
    names, position = docs.columns if mark else [*docs.columns, "secret_base", "secret_spans"], docs.columns.index("text")
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = docs.schema if mark else T.StructType([*docs.schema.fields, T.StructField("secret_base", kind), T.StructField("secret_spans", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            column = batch.column(position)
            base: list[list[tuple[int, int, str]]] = [[]] * len(batch)
            every: list[list[tuple[int, int, str]]] = [[]] * len(batch)

            def asked() -> Iterator[tuple[int, str, int, int]]:
                for t, rules, more in suspects(column):  # noqa: B023
                    text = column[t].as_py()  # noqa: B023
                    if rules:
                        base[t] = every[t] = base_spans(text)  # noqa: B023
                    if more:
                        yield from ((t, text, a, b) for a, b in candidates(text) if not any(p <= a and b <= q for p, q, _ in base[t]))  # noqa: B023

            more_spans: dict[int, list[tuple[int, int, str]]] = {}
            for t, a, b in _hits(net, asked()):
                more_spans.setdefault(t, []).append((a, b, "network"))
            for t, spans in more_spans.items():
                every[t] = sorted([*every[t], *spans], key=lambda s: (s[0], (*KINDS, "network").index(s[2])))
            if mark:
                if any(every):
                    masked = [_masked(x, row, mark) if row else x for x, row in zip(column.to_pylist(), every, strict=True)]
                    column = pa.array(masked, column.type)
                yield pa.RecordBatch.from_arrays([column if k == position else c for k, c in enumerate(batch.columns)], names=names)
                continue
            spans = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in row] for row in rows], _SPAN_TYPE) for rows in (base, every)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *spans], names=names)

    return docs.mapInArrow(run, schema)


def redacted(docs: DataFrame, mark: str = "[secret]", sample: int = SAMPLE) -> DataFrame:
    """docs with mark in place of each span that is found; other texts and columns as they are."""
    return find_secrets(docs, sample, mark)


def _masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    parts, upto = [], 0
    for start, end, _ in spans:
        if start >= upto:
            parts += [text[upto:start], mark]
        upto = max(upto, end)
    return "".join([*parts, text[upto:]])
