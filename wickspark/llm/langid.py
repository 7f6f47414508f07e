"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams of 1 to 4 bytes that both hold (presence, all lengths blended), over the
geometric mean of the numbers each holds. A bounded sample of labelled rows is mapped by the Nystrom method on some of
its texts as landmarks; kernel ridge regression there gives one weight vector for each language against the rest. A batch of
texts is scored by two matrix products: presence x landmarks' presence, kernel x weights.

Scale: fitting sees PER_LANGUAGE rows of each language at most. Scoring is a map without shuffle over whole texts; the model
(landmarks x n-grams) is of bounded size and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickspark.llm.chargrams import Presence
from wickspark.llm.frames import small_batches
from wickspark.llm.samples import fitting, remainder, sample

PER_LANGUAGE, LANDMARKS, LONGEST, RIDGE, ROWS = 300, 24, 100_000, 1e-3, 64
ORDERS = (1, 2, 3, 4)


def _table() -> np.ndarray:
    """A-Z in lower case; ASCII that is no letter counts as a space."""
    out = np.full(256, 0x20, np.uint8)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def presence(self) -> Presence:
        return Presence(ORDERS, _table())

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        held = np.zeros((len(rows), len(self.landmarks)), np.float32)
        for r, slots in enumerate(rows):
            at = self.column[slots]
            held[r, at[at >= 0]] = 1
        own = np.array([max(1, len(s)) for s in rows], np.float64)
        return (held @ self.landmarks) / np.sqrt(own[:, None] * self.sizes[None, :])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.kernel(rows) @ self.weights


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(labels))
    rows = list(Presence(ORDERS, _table()).of(pa.array(texts, pa.string())))
    y = np.array([languages.index(x) for x in labels])
    marks = [i for k in range(len(languages)) for i in np.flatnonzero(y == k)[:landmarks]]
    known = np.unique(np.concatenate([rows[i] for i in marks])) if marks else np.zeros(0, np.int32)
    column = np.full(1 << 22, -1, np.int32)
    column[known] = np.arange(len(known), dtype=np.int32)
    held = np.zeros((len(known), len(marks)), np.float32)
    for j, i in enumerate(marks):
        held[column[rows[i]], j] = 1
    model = Model(languages, column, held, np.array([max(1, len(rows[i])) for i in marks], np.float64), np.zeros((len(marks), len(languages))))
    if not marks:
        return model
    kernel = np.concatenate([model.kernel(rows[a : a + ROWS]) for a in range(0, len(rows), ROWS)])
    values, vectors = np.linalg.eigh(kernel[marks])
    good = values > 1e-6 * values.max()
    back = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ back
    target = np.where(y[:, None] == np.arange(len(languages))[None, :], 1.0, 0.0)
    model.weights = back @ np.linalg.solve(mapped.T @ mapped + ridge * len(rows) * np.eye(mapped.shape[1]), mapped.T @ target)
    return model


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = 4, held: int = 2) -> Model:
    """The model that languages() learns from docs; without languages where nothing could be learned."""
    own = docs.select("doc_id", "lang", "text")
    usable = F.col("lang").isNotNull() & fitting(F.col("text"), LONGEST) & (remainder(F.col("doc_id"), folds) != held)
    train = sample(own.filter(usable), own, "lang", per_language, LONGEST)
    return fit(train["text"].tolist(), train["label"].tolist())


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = 4, held: int = 2, model: Model | None = None) -> DataFrame:
    """docs: doc_id, text, lang and others. All columns of docs with lid_held_out, lid_pred and lid_score, a row for each.

    Learned from rows with lang, text and doc_id whose crc32(doc_id) mod folds isn't held: per_language of each
    language at most (smallest id hashes among texts of LONGEST characters at most), or given as model. Predictions use the text alone. lid_score is the regression's value
    for the predicted language, held to 0 ... 1. Null texts and those without a letter are `und` with score 0, and so is all
    where nothing could be learned. Repeated rows get equal answers. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    rest = remainder(F.col("doc_id"), folds)
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, per_language, folds, held) if model is None else model)
    names, position = [*docs.columns, "lid_pred", "lid_score"], docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lid_pred", T.StringType()), T.StructField("lid_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        presence = model.presence()
        for batch in batches:
            scores, rows = [np.zeros((0, len(model.languages)))], []
            for slots in presence.of(batch.column(position)):
                rows.append(slots)
                if len(rows) == ROWS:
                    scores.append(model.scores(rows))
                    rows = []
            if rows:
                scores.append(model.scores(rows))
            every = np.concatenate(scores)
            best = every.argmax(axis=1) if every.shape[1] else np.zeros(len(batch), int)
            said = [model.languages[k] for k in best] if every.shape[1] else ["und"] * len(batch)
            top = np.clip(every.max(axis=1), 0, 1) if every.shape[1] else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(top)], names=names)

    lettered = has_letters(F.col("text")) & (F.col("lid_pred") != "und")
    return docs.mapInArrow(run, schema).select(
        *docs.columns, F.coalesce(rest == held, F.lit(False)).alias("lid_held_out"), F.when(lettered, F.col("lid_pred")).otherwise("und").alias("lid_pred"),
        F.when(lettered, F.col("lid_score")).otherwise(0.0).alias("lid_score"))
