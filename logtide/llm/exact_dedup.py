"""Exact duplicates, batch by batch, against immutable snapshots with binary fuse filters.

Texts are equal when identical after lower-casing A-Z. Documents arrive in batches in order
of doc_id. Each batch is grouped by SHA-256 digest on its own. Its digests are screened by
the filters of every earlier snapshot; those that pass join the snapshot's exact buckets on
the whole digest, and the digests that no snapshot holds become the next snapshot. A bucket
carries its group's keep_id, the row that stays and its size: what the join finds is added to that group, and all
other groups stay as their batch made them. Groups of
two or more then have their bytes compared: the normalised texts of their members, and of no
other document, are grouped by digest and text. A digest that covers more than one text is
resolved by joining on the text itself.

Filters cover digest ranges that are narrow enough for the largest batch, so screening is a co-group of groups
that are bounded on both sides. Copies meet in partial aggregates, so a group of any size costs one row a task, and
each row finds its group in a join that Spark splits where a group is large.

Nulls and odd rows: a null text counts as empty, and all empty texts form one group; a null
doc_id ranks below every other; of repeated rows with the same doc_id and text one stays, whichever; texts of any length are
hashed whole, one at a time; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import fuse
from logtide.llm.joins import BROADCAST_ROWS, keep_listed, quantiles
from logtide.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests that one filter covers, on average.
FILTER_KEYS = 1 << 15
_GROUP = ["digest", "keep_id", "keep_row", "n"]
_GROUP_TYPE = "digest binary, keep_id long, keep_row long, n long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        found = [hashlib.sha256((x.as_py() or b"").lower()).digest() for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests, "doc_id long, digest binary")


def _keys(table: pa.Table) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "little") for d in table.column("digest").to_pylist()], np.uint64)


def _build(table: pa.Table) -> pa.Table:
    return pa.table({"range": table.column("range").slice(0, 1), "filter": pa.array([fuse.build(_keys(table))], pa.binary())})


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    if not len(filters):
        return incoming.select(_GROUP).slice(0, 0)
    passed = np.zeros(len(incoming), bool)
    for one in filters.column("filter").to_pylist():
        passed |= fuse.contains(one, _keys(incoming))
    return incoming.select(_GROUP).filter(pa.array(passed))


def _kept_row(row: str, doc_id: str) -> Column:
    """A row with the largest doc_id; any row where none has one."""
    return F.coalesce(F.max_by(row, doc_id), F.max(row)).alias("keep_row")


class Snapshot:
    """Groups of one batch whose digests no earlier snapshot holds: exact buckets and their filters.

    ``largest`` is the most digests that the snapshot or a batch screened by it may have.
    """

    def __init__(self, scratch: Scratch, fresh: DataFrame, largest: int) -> None:
        self.buckets = scratch.keep(fresh.select(*_GROUP), "buckets")
        self.ranges = 1 + largest // FILTER_KEYS
        self.filters = scratch.keep(self.ranged(self.buckets).groupBy("range").applyInArrow(_build, "range long, filter binary"), "filters")

    def ranged(self, rows: DataFrame) -> DataFrame:
        part = F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long")
        return rows.select(*_GROUP, (part % self.ranges).alias("range"))

    def held(self, incoming: DataFrame) -> DataFrame:
        """Groups of ``incoming`` whose digests (distinct) the snapshot holds, with the bucket's as stored_id, stored_row and stored_n: filter first, then the exact buckets."""
        passed = self.ranged(incoming).groupBy("range").cogroup(self.filters.groupBy("range")).applyInArrow(_screen, _GROUP_TYPE)
        stored = self.buckets.select("digest", F.col("keep_id").alias("stored_id"), F.col("keep_row").alias("stored_row"), F.col("n").alias("stored_n"))
        return passed.join(stored, "digest")


def exact_groups(docs: DataFrame, *, batches: int = 2, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    hashed = scratch.keep(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    cuts = quantiles(hashed, "doc_id", batches)
    batch = sum((F.coalesce(F.col("doc_id") > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))

    grouped = []
    for b in range(len(cuts) + 1):
        own = hashed.where(batch == b).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), _kept_row("row", "doc_id"), F.count("*").alias("n"))
        grouped.append(scratch.keep(own, f"groups{b}"))
    largest = max(groups.count() for groups in grouped)

    held_again, snapshots = [], []
    for b, groups in enumerate(grouped):
        fresh = groups
        for snapshot in snapshots:
            held = scratch.keep(snapshot.held(fresh), "held")
            held_again.append(held)
            fresh = fresh.join(held, "digest", "left_anti")
        if b < len(cuts):
            snapshots.append(Snapshot(scratch, fresh, largest))

    classes = fresh
    for snapshot in snapshots:
        classes = classes.unionByName(snapshot.buckets)
    classes = classes.withColumnRenamed("n", "group_size")
    if held_again:  # only these groups differ from what their first batch made of them
        found = held_again[0]
        for held in held_again[1:]:
            found = found.unionByName(held)
        # Later batches hold larger ids, and the stored id comes first where an id is null.
        newer = F.col("stored_id").isNull() | (F.col("keep_id") > F.col("stored_id"))
        found = found.select("digest", "n", "stored_n", F.when(newer, F.col("keep_id")).otherwise(F.col("stored_id")).alias("id"), F.when(newer, F.col("keep_row")).otherwise(F.col("stored_row")).alias("row"))
        found = found.groupBy("digest").agg(F.max("id").alias("new_id"), _kept_row("row", "id").alias("new_row"), (F.max("stored_n") + F.sum("n")).alias("new_size"))
        latest = {c: F.coalesce(f"new_{c.split('_')[1]}", c).alias(c) for c in ("keep_id", "keep_row", "group_size")}
        classes = classes.join(found, "digest", "left").select("digest", *latest.values())
    classes = scratch.keep(classes, "classes")
    repeated = scratch.keep(classes.where("group_size > 1").select("digest"), "repeated")

    # Byte check: only members of groups have their texts read again.
    members = scratch.keep(hashed.join(repeated, "digest", "left_semi").select("doc_id").distinct(), "members")
    texts = docs.select(F.col("doc_id").cast("long"), F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER).alias("body"))
    texts = keep_listed(texts.where("doc_id is not null"), members.where("doc_id is not null"), ["doc_id"], broadcast_rows).unionByName(texts.where("doc_id is null"))
    checked = (
        texts.withColumn("digest", F.unhex(F.sha2("body", 256)))
        .groupBy("digest", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .groupBy("digest")
        .agg(F.count("*").alias("bodies"))
    )
    split = scratch.keep(checked.where("bodies > 1").select("digest"), "split")

    if split.isEmpty():
        joined = hashed.join(classes, "digest")
    else:  # one digest over different texts: the texts themselves decide
        bodies = scratch.keep(texts.withColumn("digest", F.unhex(F.sha2("body", 256))).join(split, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "bodies")
        exact = bodies.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), _kept_row("row", "doc_id"), F.count("*").alias("group_size"))
        columns = ["digest", "doc_id", "row", "keep_id", "keep_row", "group_size"]
        alone = hashed.join(split, "digest", "left_anti").join(classes, "digest").select(*columns)
        joined = alone.unionByName(bodies.join(exact, ["digest", "body"]).select(*columns))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM n
"""
