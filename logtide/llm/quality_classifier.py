"""Document quality by regularised quadratic discriminant analysis.

Statistics of a whole text are transformed towards normal shape. Each class has a mean and a
covariance, shrunk towards the pooled covariance and then towards the diagonal of that.
The score is the logistic of the difference of the two log densities plus that of the log
priors; a density's Mahalanobis distance comes from a forward substitution with the Cholesky
factor of the class's covariance, which the model keeps.

Moments are exact decimal sums over all labelled training rows, so a model does not depend on
the order of rows. Only a class's moments reach the driver.

Nulls and odd rows: a null or empty text has zero statistics and gets a score like any other;
a null doc_id is never held out and matches no label; repeated rows score alike; a score of exactly the threshold is accepted; texts of any
length are read whole, and memory follows the longest; an empty table gives an empty result; a label that is neither 0 nor 1 is not used; with fewer than two training rows of a class every score is the share of class
1, or 0.5 without labels. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import words as W
from logtide.llm.joins import keep_listed
from logtide.llm.scratch import Scratch

FEATURES = (
    "log_words", "word_bytes", "word_bytes_spread", "upper", "digits", "symbols", "exclaims", "stops",
    "other_bytes", "distinct_words", "repeated_runs", "repeated_lines", "newlines",
)
#: Weight of the pooled covariance, and then of its diagonal.
POOLED, DIAGONAL = 0.1, 0.05
THRESHOLD = 0.7


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = {
    "upper": _members(bytes(range(65, 91))),
    "letters": _members(bytes(range(65, 91)) + bytes(range(97, 123))),
    "digits": _members(b"0123456789"),
    "symbols": _members(b"#*$%&|<>@^~_=+{}[]\\"),
    "exclaims": _members(b"!?"),
    "stops": _members(b".,;:"),
    "other": _members(bytes(range(128, 256))),
    "newlines": _members(b"\n"),
}


def segment_counts(table: np.ndarray, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many bytes of a class lie between each edge and the next."""
    return np.diff(np.searchsorted(np.flatnonzero(table[raw]), edges))


def _distinct(words: W.Words, length: int) -> np.ndarray:
    """Distinct runs of ``length`` words in each text."""
    hashes = W.windows(words.hashes, length)
    inside = W.fits(words, length)
    text, hashes = words.text_of()[: len(hashes)][inside], hashes[inside]
    order = np.argsort(hashes)
    order = order[np.argsort(text[order].astype(np.uint32), kind="stable")]
    text, hashes = text[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=len(words.first) - 1)


def statistics(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text."""
    words = W.split(offsets, raw, fold=True)
    n = words.counts.astype(float)
    some = np.maximum(n, 1)
    count = {k: segment_counts(v, raw, offsets).astype(float) for k, v in _CLASSES.items()}
    size = np.maximum(np.diff(offsets), 1).astype(float)
    length = (words.ends - words.starts).astype(float)
    total, squares = (np.diff(np.concatenate([[0.0], np.cumsum(x)])[words.first]) for x in (length, length * length))
    mean = total / some
    spread = np.sqrt(np.maximum(squares / some - mean * mean, 0))
    runs = np.maximum(n - 3, 0)
    whole = raw.tobytes()
    repeated = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip()]
        repeated.append(1 - len(set(lines)) / len(lines) if lines else 0.0)
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    return np.stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(spread), share(count["upper"], count["letters"]), share(count["digits"], size),
            share(count["symbols"], some), share(count["exclaims"], some), share(count["stops"], some), share(count["other"], size),
            np.log1p(_distinct(words, 1)) / np.maximum(np.log1p(n), 1e-9) * (n > 0), np.sqrt(np.maximum(1 - _distinct(words, 4) / np.maximum(runs, 1), 0)) * (runs > 0),
            np.sqrt(np.array(repeated)), share(count["newlines"], some),
        ],
        axis=1,
    )


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.release_memory()
    for batch in batches:
        for lo, hi, offsets, raw in W.chunks(batch.column(1)):
            x = np.round(statistics(offsets, raw), 6)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_featured, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def forward(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z with factor @ z = y, for a lower triangular factor and any number of columns."""
    z = np.empty_like(y, dtype=float)
    for i in range(len(factor)):
        z[i] = (y[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Model:
    """Class means, Cholesky factors of the class covariances, and the log-density constants."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    share: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = forward(factor, (x - mean).T)
            logs.append(constant - 0.5 * np.sum(z * z, axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame) -> Model:
    """``labelled``: x and y (0 or 1)."""
    d = len(FEATURES)
    exact = lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")
    sums = [exact(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    sums += [exact(F.round(F.col("x")[i] * F.col("x")[j], 9)).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {r["y"]: r for r in labelled.groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}  # two rows
    n = np.array([rows[y]["n"] if y in rows else 0 for y in (0, 1)], float)
    if n.min() < 2:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), float(n[1] / n.sum()) if n.sum() else 0.5)
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for y in (0, 1):
        means[y] = [rows[y][f"s{i}"] / n[y] for i in range(d)]
        second = np.array([[rows[y][f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / n[y]
        scatter[y] = second - np.outer(means[y], means[y])
    pooled = np.tensordot(n / n.sum(), scatter, 1)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, constants = [], []
    for y in (0, 1):
        cov = (1 - DIAGONAL) * ((1 - POOLED) * scatter[y] + POOLED * pooled) + DIAGONAL * scale
        factors.append(np.linalg.cholesky(cov))
        constants.append(np.log(n[y] / n.sum()) - np.sum(np.log(np.diag(factors[y]))))
    return Model(means, np.array(factors), np.array(constants))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = np.round(model.scores(x), 9) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; ``labels`` has doc_id and quality."""
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.keep(features(docs), "features")
    model = fit(table.join(_training_rows(labels), "doc_id").select("x", "y"))
    scored = table.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _training_rows(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("y"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a model fitted on their labelled rows doesn't reject."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = scratch.keep(_training_rows(labels).where("doc_id is not null"), "known")
    listed = scratch.keep(known.select("doc_id").distinct(), "listed")
    table = features(keep_listed(docs.select("doc_id", "text"), listed, ["doc_id"]))
    model = fit(scratch.keep(table.join(known, "doc_id").select("x", "y"), "labelled"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release_memory()
        for batch in batches:
            for lo, hi, offsets, raw in W.chunks(batch.column(1)):
                score = np.round(model.scores(np.round(statistics(offsets, raw), 6)), 9)
                yield batch.slice(lo, hi - lo).filter(pa.array(score >= THRESHOLD)).select(["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
