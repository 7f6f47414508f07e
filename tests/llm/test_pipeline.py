"""The pipeline on a small fixture, stage by stage against plain loops, and as a whole."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_text_operators import DOCS, near_by_loop, said

import corpus_pipeline
from wickspark.llm import decontamination, mixing, secrets


@pytest.fixture(scope="module")
def folder_of(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = [said(rng, rng.randint(5, 80)) for _ in range(60)]
    items = [(1, said(rng, 20)), (2, said(rng, 30))]
    texts += texts[:5] + [t + " zz" for t in texts[20:25] if len(t.split()) > 40] + [items[0][1], f"{said(rng, 10)} {items[1][1]}", f"token = '{'0123456789abcdef' * 2}' {said(rng, 20)}", None, "", "12 34"]
    rows = [(i, t, None if i % 7 == 0 else "xx", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[30], (None, said(rng, 30), "xx", None, 0), (None, said(rng, 30), "xx", None, 0), (None, items[0][1], "xx", "a", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, folder_of):
    folder, rows = folder_of
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    seen = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/step{number}")
        docs = spark.read.parquet(f"{folder}/step{number}")
        after = sorted((tuple(r) for r in docs.collect()), key=key)
        if name == "language_id":
            want = [r for r in before if re.search(r"[^\W\d_]", r[1] or "")]
        elif name == "near_dedup":
            kept = {d for d, x in near_by_loop([(r[0], r[1]) for r in before if r[0] is not None], 5).items() if x[2]}
            want = list({r[0]: r for r in before if r[0] in kept}.values()) + [r for r in before if r[0] is None]
        elif name == "decontaminate":
            bad = {r.doc_id for r in decontamination.contamination(spark.createDataFrame([(i, r[1]) for i, r in enumerate(before)], "doc_id long, text string"), spark.read.parquet(f"{folder}/benchmark.parquet")).filter("contaminated").collect()}
            assert len(bad) == 3
            want = [r for i, r in enumerate(before) if i not in bad]
        elif name == "secret_scan":
            want = []
            for r in before:
                spans = secrets.base_spans(r[1])
                text = secrets._masked(r[1], spans, "[secret]")
                want.append((*r[:1], text, *r[2:4], len(text)))
            assert sum("[secret]" in r[1] for r in after) == 1
        else:
            copies = {key(r): r.mix_copies for r in mixing.mix(spark.createDataFrame(before, DOCS)).collect()}
            want = [r for r in before for _ in range(copies[key(r)])]
        assert after == sorted(want, key=key), name
        seen.append(len(after))
    assert seen[0] < len(rows) and seen[1] < seen[0] and seen[2] == seen[1] - 3 == seen[3]
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=key) == after


def test_letters_stay_where_no_language_is_known(spark, tmp_path):
    rows = [(1, "some words", None, "s", 10), (2, "12 ... 3", None, "s", 8), (3, None, None, "s", 0), (4, "слова", None, "s", 5)]
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()) == [1, 4]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_keep_their_values(spark, folder_of):
    """Columns named as those that the operators make, ids with several texts and repeated rows."""
    folder, rows = folder_of
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], DOCS).dropDuplicates(["doc_id"])
    taken = ["lid_pred", "lid_score", "_class", "_place", "_bucket", "_copy", "_source", "mix_size", "mix_copies", "secret_base", "secret_spans", "_row_key", "stays", "n", "kind", "row", "_user_5"]
    wide = docs.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in taken])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in taken), name


def test_different_texts_of_one_id_stay(spark, tmp_path):
    rng = random.Random(2)
    a, b, c = (said(rng, 60) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (6, a), (6, a), (7, c), (7, c)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(d, t, "xx", "s", 1) for d, t in rows], DOCS), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, a), (5, a), (5, b), (7, c)])
