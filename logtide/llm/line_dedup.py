"""Repeated lines, found through levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased. Keys
of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose their
lines everywhere but in the document with the largest doc_id.

Documents arrive in batches, the largest ids first. A batch's hashes are aggregated and
merge-anti-joined with every run so far: what no run holds gets this batch's largest id as
its holder, what a run holds adds its count only. The batch becomes a sorted run of level 0;
when a level has ``fanout`` runs they are compacted into one run of the next level, counts
added up. The runs together then tell which keys are frequent and who holds them.

Hashes have 128 bits. Occurrences are aggregated before every shuffle and joined to the
frequent keys, so a line that all documents share is a skewed join that Spark splits; a
row's own list is bounded by its lines, because rows are told apart by doc_id and a hash of the text.

Nulls and odd rows: a null or empty text is one empty line; rows of one doc_id are one document, so
repeated rows count once and all rows with the holder's doc_id keep their lines; rows without a
doc_id are together one document, which ranks below all others; a key found several times in one document counts once;
an empty table gives an empty result; texts of any length are read whole, one at a time; other
columns are not read, except by ``rewritten``, which keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.joins import BROADCAST_ROWS, quantiles
from logtide.llm.scratch import MOST_BUCKETS, Scratch, ordered_buckets

#: Keys that one bucket of a run holds, about.
BUCKET_KEYS = 2_000_000
_SPACE = b" \t\n\r\x0b\x0c"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None for one that is too short."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                found = {_key(line, min_chars) for line in (text.as_py() or b"").split(b"\n")} - {None}
                rows += [i] * len(found)
                keys += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(keys, pa.binary())], ["doc_id", "text_key", "key"])

    return run


class LineRuns:
    """Levels of sorted runs (key, n_docs, holder); every batch must hold smaller ids than those before it.

    Runs have the same buckets of keys, each sorted, so a batch meets them and runs are compacted by merging buckets:
    only a batch's own aggregation shuffles.
    """

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = 2) -> None:
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, occurrences: DataFrame) -> None:
        batch = occurrences.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        batch = self.scratch.keep_sorted(batch, "batch", "key", self.buckets)
        if not self.runs():
            self._store(batch, 0)
            return
        new = batch.select("key")
        for run in self.runs():
            new = new.join(run.select("key").hint("merge"), "key", "left_anti")
        marked = batch.join(new.select("key", F.lit(True).alias("new")).hint("merge"), "key", "left")
        run = marked.select("key", "n_docs", F.when(F.col("new"), F.col("holder")).alias("holder"))
        self._store(self.scratch.keep_sorted(run, "run0", "key", self.buckets, dealt=True), 0)
        self.scratch.drop(batch)

    def _store(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._store(self.scratch.keep_sorted(self._merged(old), f"run{level + 1}", "key", self.buckets, dealt=True), level + 1)
            self.scratch.drop(*old)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            own = run.select("key", F.col("n_docs").alias("more"), F.col("holder").alias("other")).hint("merge")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            rows = rows.join(own, "key", "full").select("key", total.alias("n_docs"), F.greatest("holder", "other").alias("holder"))
        return rows

    def frequent(self, min_docs: int) -> DataFrame:
        """(key, holder) of the keys of at least so many documents."""
        with ordered_buckets(self.scratch.spark):
            return self.scratch.keep(self._merged(self.runs()).where(F.col("n_docs") >= min_docs).select("key", "holder"), "frequent")


def _of_documents(scratch: Scratch, docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(doc_id, key) once for each document that holds a key. A row's keys are distinct, so only rows of repeated ids are aggregated."""
    many = scratch.keep(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("many_id")), "repeated")
    pairs = occurrences.select("doc_id", "key")
    if many.isEmpty():
        return pairs
    repeated = F.col("doc_id").eqNullSafe(F.col("many_id"))
    return pairs.join(many, repeated, "left_anti").unionByName(pairs.join(many, repeated, "left_semi").distinct())


def dropped_keys(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """(doc_id, text_key, keys): the hashes of the keys whose lines a row loses; text_key is xxhash64(text). Rows that lose none are left out."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    occurrences = scratch.keep(rows.mapInArrow(_keys_of(min_chars), "doc_id long, text_key long, key binary"), "occurrences")
    held = _of_documents(scratch, rows.select("doc_id"), occurrences)
    cuts = quantiles(occurrences, "doc_id", batches)
    buckets = min(max(docs.sparkSession.sparkContext.defaultParallelism, 1 + occurrences.count() // BUCKET_KEYS), MOST_BUCKETS)
    runs = LineRuns(scratch, buckets, fanout)
    batch = sum((F.coalesce(F.col("doc_id") > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    for b in range(len(cuts), -1, -1):
        runs.add(held.where(batch == b))
    frequent = runs.frequent(min_docs)
    lost = occurrences.join(frequent, "key").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    lost = scratch.keep(lost.groupBy("doc_id", "text_key").agg(F.collect_set("key").alias("keys")), "lost")
    scratch.drop(occurrences, frequent, *runs.runs())
    return lost


def _rewrite(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, out = [], [], []
            for text, keys in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                lost = set(keys.as_py() or ())
                kept = [x for x in lines if _key(x, min_chars) not in lost] if lost else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                body = b"\n".join(kept)
                out.append(hashlib.sha256(body).hexdigest() if digest else body)
            kept = pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept], ["row", "n_lines", "n_dropped", "kept"])

    return run


def rewritten(docs: DataFrame, *, digest: bool = False, min_chars: int = 20, broadcast_rows: int = BROADCAST_ROWS, **options: int) -> DataFrame:
    """row (the input without its text, as a struct), n_lines, n_dropped, kept (the text that stays, or its SHA-256 in hex)."""
    lost = dropped_keys(docs, min_chars=min_chars, **options).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key"), "keys")
    if (lost.agg(F.sum(F.size("keys"))).first()[0] or 0) <= broadcast_rows:  # then texts needn't move
        lost = F.broadcast(lost)
    else:
        lost = lost.hint("merge")
    rest = [F.col("doc_id").cast("long").alias("doc_id")] + [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.struct(*rest).alias("row"), "text")
    same = F.col("row.doc_id").eqNullSafe(F.col("lost_id")) & (F.xxhash64("text") == F.col("lost_key"))
    joined = rows.join(lost, same, "left").select("row", "text", "keys")
    kind = T.StructType([joined.schema["row"], *(T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_rewrite(min_chars, digest), kind)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rewritten(docs, digest=True).select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos FROM documents,
         LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.holder AS lost FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
