"""Corpus pipeline: raw documents to token ids in five stages, each one operator of ``logtide.llm``.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All
but the last return the columns of documents. A stage's result is written as Parquet and read
again for the next, so a lost executor costs at most one stage's tasks.

Nulls, empty and repeated rows follow the operators. Beyond them: a document whose lines all
go keeps its row with an empty text; of rows that share doc_id and text one passes the third
stage; the fourth repeats a row as often as the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import bpe, line_dedup, mixing, ngram_jaccard, quality_classifier
from logtide.llm.scratch import Scratch, remove, watched

#: SQL can't express the classifier, so tests compare the pipeline with brute force.
ORACLE_SQL = None


def _like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order; names may hold dots."""
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat across them."""
    kept = line_dedup.rewritten(docs).select("row.*", F.col("kept").alias("text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _like(kept, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates, null ids last: five words, similarity 0.8."""
    found = ngram_jaccard.near_duplicates(docs, keyed=True)
    alone = [F.when(F.col("label").isNull(), F.col(c)).alias(f"own_{c}") for c in ("doc_id", "text_key")]  # an empty set is a group of its own
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key"))
    stays = found.groupBy("label", *alone).agg(first.alias("first")).select(F.col("first.doc_id").alias("stays"), F.col("first.text_key").alias("stays_key"))
    same = docs["doc_id"].eqNullSafe(stays["stays"]) & (F.xxhash64(docs["text"]) == stays["stays_key"])
    kept = docs.join(stays, same, "left_semi")
    return _like(kept.dropDuplicates(["doc_id", "text"]), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _like(mixing.mixed(docs), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of what they decode to."""
    return bpe.round_trip(docs, bpe.default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's own tables are removed as soon as its result is stored."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with watched() as made:
            kept = stage(spark, docs, sf_dir)
        before, docs = docs, scratch.keep(kept, f"stage{i}")
        remove(spark, *made)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
