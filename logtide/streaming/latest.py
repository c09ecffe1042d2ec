"""Streams of log rows: keyed latest values, periodic flushes and dual writes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtide.operators.log import LOG_COLUMNS, latest
from logtide.sources.files import shared_folder


def newest_rows(stream: DataFrame) -> DataFrame:
    """The newest row of each key as a running aggregate; tombstones stay in state, so a late older version can't return."""
    best = F.max_by(F.struct("v", "deleted", "seq"), "seq").alias("r")
    return stream.groupBy("k").agg(best).select("k", "r.seq", "r.v", "r.deleted")


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def merge_batch(state_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds a batch into a small table of newest rows, one folder for each batch number.

    A batch that runs again reads the same older folder and overwrites its own; folders before that one are removed.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{state_path}/batch={number - 1}"
        rows = batch.select(*LOG_COLUMNS)
        if number:
            rows = rows.unionByName(spark.read.schema(batch.select(*LOG_COLUMNS).schema).parquet(before))
        latest(rows).write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        if number > 1:
            _remove(spark, f"{state_path}/batch={number - 2}")

    return run


def fold_batches(state_path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds a batch into a table of newest rows in buckets of keys.

    A batch rewrites the buckets it has keys of and no others. ``lists/batch=n`` says after batch n which batch wrote each bucket
    last; it is written at the end, so a batch that runs again starts from the same list. What neither this list nor the one before names is removed.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, data = batch.sparkSession, f"{state_path}/data"
        columns = batch.select(*LOG_COLUMNS)
        rows = columns.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")).persist()
        try:
            last = _listing(spark, state_path, number - 1)
            touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
            paths = [f"{data}/batch={last[b]}/bucket={b}" for b in sorted(touched & set(last))]
            merged = rows
            if paths:
                stored = spark.read.schema(rows.schema).option("basePath", data).parquet(*paths).select(*rows.columns)
                merged = rows.unionByName(stored)
            latest(merged).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{data}/batch={number}")
            now = last | {b: number for b in touched}
            listing = spark.createDataFrame(sorted(now.items()), "bucket int, written long")
            listing.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/lists/batch={number}")
            for b, older in _listing(spark, state_path, number - 2).items():
                if older != last.get(b):
                    _remove(spark, f"{data}/batch={older}/bucket={b}")
            if number > 1:
                _remove(spark, f"{state_path}/lists/batch={number - 2}")
        finally:
            rows.unpersist()

    return run


def _listing(spark: SparkSession, state_path: str, number: int) -> dict[int, int]:
    path = f"{state_path}/lists/batch={number}"
    if number < 0 or not _exists(spark, path):
        return {}
    return {r["bucket"]: r["written"] for r in spark.read.schema("bucket int, written long").parquet(path).collect()}  # a row a bucket


def folded(spark: SparkSession, state_path: str, schema: object) -> DataFrame:
    """The newest rows that ``fold_batches`` has stored, with the log's ``schema``."""
    empty = spark.createDataFrame([], schema)
    lists = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/lists")
    if not _exists(spark, f"{state_path}/lists"):
        return empty
    found = lists.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(lists)
    newest = max(int(f.getPath().getName().split("=")[1]) for f in found)
    paths = [f"{state_path}/data/batch={n}/bucket={b}" for b, n in sorted(_listing(spark, state_path, newest).items())]
    return spark.read.schema(empty.schema).parquet(*paths).select(*LOG_COLUMNS) if paths else empty


def recent_ring(stream: DataFrame, n: int = 50, key: str = "k") -> DataFrame:
    """A stream of (key, seq, deleted): with each batch, the last n operations of every key it touches, the newest first, kept in state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.select(key).schema[0].dataType.simpleString()

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            ring = sorted({*ring, *zip(batch["seq"].tolist(), batch["deleted"].tolist(), strict=True)}, reverse=True)[:n]
        state.update(tuple(list(c) for c in zip(*ring, strict=True)))
        yield pd.DataFrame({key: group[0], "age": range(1, len(ring) + 1), "seq": [s for s, _ in ring], "deleted": [d for _, d in ring]})

    return (
        stream.select(key, "seq", "deleted")
        .groupBy(key)
        .applyInPandasWithState(run, f"`{key}` {kind}, age long, seq long, deleted boolean", "seqs array<long>, gone array<boolean>", "update", GroupStateTimeout.NoTimeout)
    )


def dual_write(first: str, second: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to two tables, as while one replaces the other."""

    def run(batch: DataFrame, number: int) -> None:
        for path in (first, second):
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def start(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a batch function over a stream: every so often, or once over what is there."""
    writer = stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def replay(spark: SparkSession, source: DataFrame, stream_path: str, name: str) -> DataFrame:
    """Newest rows of a stored log, computed as a stream over its files into state on shared storage; also a view of that name."""
    stream = spark.readStream.schema(source.schema).parquet(os.path.join(stream_path))
    found = replay_stream(stream)
    found.createOrReplaceTempView(name)
    return found


def replay_stream(stream: DataFrame) -> DataFrame:
    """Newest rows of all that a stream holds now."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "replay")
    start(stream.select(*LOG_COLUMNS), fold_batches(f"{folder}/state"), f"{folder}/checkpoint").awaitTermination()
    return folded(spark, f"{folder}/state", stream.select(*LOG_COLUMNS).schema)
