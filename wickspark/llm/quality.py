"""Quality classifier: naive Bayes support vectors.

Features are the byte n-grams of 1 to 3 bytes that a text holds (indicators), each scaled by the log-ratio of its smoothed
shares among good and bad rows; a text's vector has length 1. A linear hinge-loss model on them is fit by dual coordinate
descent, its margins turned into probabilities by a logistic curve on rows that the descent didn't see.

Scale: fitting sees PER_LABEL rows of each label at most. Scoring is a map without shuffle over whole texts; the model is one
number for each slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.llm.chargrams import Presence
from wickspark.llm.frames import small_batches
from wickspark.llm.samples import fitting, remainder, sample

PER_LABEL, LONGEST, COST, ROUNDS, BITS = 1000, 100_000, 1.0, 30, 18
ORDERS = (1, 2, 3)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.margin(r) for r in rows])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))

    def margin(self, slots: np.ndarray) -> float:
        own = self.ratio[slots]
        length = np.sqrt(own @ own) if len(own) else 0.0
        return float(own @ self.weight[slots] / length + self.bias) if length > 0 else self.bias


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Least |w|^2 / 2 + cost x hinge losses, one dual variable at a time, rows (slots, values) in shuffled order; y is 1 or -1. The bias is a
    further feature that is always 1."""
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    norms = np.array([v @ v + 1 for _, v in rows])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slots, values = rows[i]
            slope = y[i] * (w[slots] @ values + bias) - 1
            step = min(max(alpha[i] - slope / norms[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[slots] += step * y[i] * values
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def fit(texts: list[str], labels: list[int]) -> Model:
    """Without rows of both labels the score is the share of good rows (one half without any)."""
    size, y = 1 << BITS, np.where(np.array(labels, dtype=int) == 1, 1, -1)
    model = Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1))))
    if len(set(y.tolist())) < 2:
        return model
    rows = list(Presence(ORDERS, np.arange(256, dtype=np.uint8), BITS).of(pa.array(texts, pa.string())))
    shares = []
    for side in (1, -1):
        count = np.ones(size)
        for i in np.flatnonzero(y == side):
            count[rows[i]] += 1
        shares.append(count / ((y == side).sum() + 2))
    model.ratio = np.log(shares[0] / shares[1])
    vectors = []
    for slots in rows:
        own = model.ratio[slots]
        vectors.append((slots, own / max(np.sqrt(own @ own), 1e-12)))
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    model.weight, model.bias = dual_descent([v for v, a in zip(vectors, aside, strict=True) if not a], y[~aside], size)
    seen = aside if aside.any() else ~aside
    margins = np.array([model.margin(r) for r, s in zip(rows, seen, strict=True) if s])
    model.slope, model.shift = logistic(margins, (y[seen] > 0).astype(float))
    return model


def logistic(x: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps, held back a little from infinity; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d = p * (1 - p) + 1e-9
        g = np.array([(p - t) @ x + 1e-2 * a, (p - t).sum() + 1e-2 * b])
        h = np.array([[d @ (x * x) + 1e-2, d @ x], [d @ x, d.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def qualities(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, folds: int = 3, held: int = 1) -> DataFrame:
    """docs: doc_id, text. labels: doc_id, quality. A row for each row of docs: doc_id, held_out, score, predicted.

    Learned from labelled rows whose crc32(doc_id) mod folds isn't held: per_label of each label at most (smallest id hashes among
    ids with a text of LONGEST characters at most). A score depends on the text alone; null and empty texts have the score of a text without features.
    Rows with other quality values, nulls and ids without a document teach nothing. Repeated rows get equal answers. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rest = remainder(F.col("doc_id"), folds)
    marked = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & (rest != held)).dropDuplicates(["doc_id"])
    usable = own.filter(fitting(F.col("text"), LONGEST)).select("doc_id").distinct()
    train = sample(marked.join(usable, "doc_id", "left_semi"), own, "quality", per_label, LONGEST)
    sent = docs.sparkSession.sparkContext.broadcast(fit(train["text"].tolist(), train["label"].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, presence = sent.value, Presence(ORDERS, np.arange(256, dtype=np.uint8), BITS)
        for batch in batches:
            scores = model.score(list(presence.of(batch.column(1)))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = own.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(rest == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
