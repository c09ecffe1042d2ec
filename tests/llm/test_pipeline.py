"""The pipeline against plain versions of its stages, and on odd tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logtide.llm import bpe, scratch
from tests.llm import brute, cases
from tests.oracle import DATA

SF = str(DATA / "sf0.001")


def test_stages_against_plain_versions(spark):
    keep = scratch.Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    quality, lines, near, mix, tokens = (f for _, f in corpus_pipeline.STAGES)

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = keep.keep(quality(spark, docs, SF), "a")
    kept = {r.doc_id for r in first.collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert first.columns == columns and np.mean(right) > 0.9

    second = keep.keep(lines(spark, first, SF), "b")
    expected = brute.without_lines([(r.doc_id, r.text) for r in first.collect()])
    assert second.columns == columns and {r.doc_id: r.text for r in second.collect()} == {i: t for i, (_, _, t) in expected.items()}
    assert second.where(F.col("n_chars") != F.length("text")).count() == 0

    third = keep.keep(near(spark, second, SF), "c")
    groups = brute.near_components([(r.doc_id, r.text) for r in second.collect()], 5, 80, 100)
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted({c for _, _, c in groups})

    fourth = keep.keep(mix(spark, third, SF), "d")
    sizes, taken = Counter(), Counter()
    for r in third.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text))
    for r in fourth.collect():
        taken[r.source] += len(brute.WORD.findall(r.text))
    aims = brute.targets(sizes)
    assert fourth.columns == columns and abs(sum(taken.values()) - sum(aims.values())) < 0.15 * sum(aims.values())
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= 2

    last = tokens(spark, fourth, SF)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    found = Counter((r.doc_id, r.n_tokens) for r in last.collect())
    assert found == Counter((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in fourth.collect())
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, last.collect()))


def test_stages_on_odd_tables(spark):
    for docs in (cases.clashing(cases.documents(spark)), cases.odd_documents(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).write.format("noop").mode("overwrite").save()
    assert corpus_pipeline.near_duplicates(spark, cases.odd_documents(spark), SF).where("doc_id = 1").count() == 2


def test_near_duplicates_keep_one_row_of_each_group(spark):
    """Near copies under one doc_id or none leave one row; an empty text without an id lets no other row through."""
    near = lambda word: [" ".join(f"{word}{i}" for i in range(60)), " ".join(f"{word}{i}" for i in range(59)) + " other"]
    a, b, c = near("a"), near("b"), near("c")
    rows = [(7, a[0]), (7, a[1]), (None, b[0]), (None, b[1]), (2, c[0]), (None, c[1]), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], cases.SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(i or 0 for i, _ in kept) == [0, 0, 2, 7] and len(set(kept) & {(None, t) for t in b}) == 1
    assert {(2, c[0]), (None, "")} < set(kept)
