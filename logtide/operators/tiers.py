"""Tiers, sorted runs and compaction of a log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.operators.blocks import running_sum
from logtide.operators.log import LOG_COLUMNS, live

#: Byte limits of the tiers, newest first.
TIER_LIMITS = (64 << 20, 256 << 20, 1 << 30, 4 << 30)


def resolve_tiers(rows: DataFrame) -> DataFrame:
    """The row that answers for each key over (tier, LOG_COLUMNS): the newest tier first, then the newest version."""
    order = Window.partitionBy("k").orderBy("tier", F.desc("seq"))
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def merge_down(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """A tier merged into the next: the upper tier's newest rows, and lower rows of other keys; tombstones are carried."""
    top = resolve_tiers(upper.withColumn("tier", F.lit(0))).select(*LOG_COLUMNS)
    return top.unionByName(lower.select(*LOG_COLUMNS).join(top.select("k"), "k", "left_anti"))


def flush_plan(rows: DataFrame, limits: tuple[int, ...] = TIER_LIMITS) -> DataFrame:
    """Bytes of each tier against its limit."""
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("tier") + 1)
    return rows.groupBy("tier").agg(F.sum("bytes").cast("long").alias("n_bytes")).withColumn("flush", F.col("n_bytes") > limit)


def run_metadata(rows: DataFrame, run: str, key: str, size: Column) -> DataFrame:
    """Smallest and largest key, entries and bytes of each run."""
    return rows.groupBy(run).agg(
        F.min(key).alias("min_k"), F.max(key).alias("max_k"), F.count("*").alias("n_entries"), F.sum(size).cast("long").alias("n_bytes")
    )


def write_run(rows: DataFrame, path: str, key: str = "k", partitions: int | None = None) -> None:
    """Write rows as files sorted by key, so that file statistics prune look-ups."""
    spread = rows.repartitionByRange(partitions, key) if partitions else rows.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def candidate_runs(metadata: DataFrame, probe: Column) -> DataFrame:
    """Runs whose key range covers the probe."""
    return metadata.where((F.col("min_k") <= probe) & (F.col("max_k") >= probe))


def memtable_runs(log: DataFrame, limit: int) -> DataFrame:
    """Rows with the run that a byte counter which never starts again would give them: ``run_id`` grows each time the bytes so far pass a multiple of the limit."""
    summed = running_sum(log, "bytes", "seq", "_before")
    return summed.withColumn("run_id", F.floor(F.col("_before") / limit).cast("long")).drop("_before")


def flush_runs(log: DataFrame, limit: int, shards: int) -> DataFrame:
    """Rows of (k, seq, bytes, deleted) with their shard and the run their memtable is flushed to.

    A shard has one memtable. Its counter adds the bytes of puts, a row that takes it to the limit ends the run, and the counter starts again
    at 0. That is a fold along the shard's log: each shard is one sorted stream, of which a task holds a batch and the counter.
    """
    from logtide.operators.shards import with_shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = number = None
        for batch in batches:
            own, size = batch.column("shard").to_numpy(), np.where(batch.column("deleted").to_numpy(zero_copy_only=False), 0, batch.column("bytes").to_numpy())
            runs = np.zeros(len(own), np.int64)
            for i, (s, n) in enumerate(zip(own.tolist(), size.tolist(), strict=True)):
                if s != shard:
                    shard, held, number = s, 0, 0
                runs[i], held = number, held + n
                if held >= limit:
                    number, held = number + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("k", "seq", "shard")] + [pa.array(runs)], ["k", "seq", "shard", "run_id"])

    rows = with_shard(log, shards).select("k", "seq", F.col("bytes").cast("long").alias("bytes"), "deleted", "shard")
    kind = log.select("k").schema[0].dataType.simpleString()
    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "seq").mapInArrow(run, f"k {kind}, seq long, shard int, run_id long")


def run_checksums(rows: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """CRC-32 over the key and value bytes of each run in order of key. A run's records are gathered, so runs are as small as a memtable."""
    record = F.hex(F.concat(F.col(key).cast("binary"), F.coalesce(F.col(value).cast("binary"), F.lit(b""))))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(key).cast("binary").alias("k"), record.alias("r"))))
    return rows.groupBy(run).agg(F.crc32(F.unhex(F.array_join(F.transform(ordered, lambda x: x["r"]), ""))).alias("crc"))


def sound_runs(rows: DataFrame, listing: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """Rows of the runs whose bytes have the CRC-32 of ``listing`` (run, crc); damaged runs are left out whole."""
    sound = run_checksums(rows, run, key, value).join(listing.select(run, "crc"), [run, "crc"], "left_semi")
    return rows.join(sound.select(run), run, "left_semi")


#: What a tier's store puts before keys of values and of tombstones.
DATA_PREFIX, TOMBSTONE_PREFIX = "d:", "t:"


def to_records(log: DataFrame) -> DataFrame:
    """The newest rows of a log as records (k, seq, v) of a store without tombstones: a prefix tells values and tombstones apart."""
    from logtide.operators.log import latest

    prefix = F.when(F.col("deleted"), TOMBSTONE_PREFIX).otherwise(DATA_PREFIX)
    value = F.when(~F.col("deleted"), F.col("v"))
    return latest(log).select(F.concat(prefix, "k").alias("k"), "seq", value.alias("v"))


def from_records(records: DataFrame) -> DataFrame:
    """The log of such records; keys without a prefix aren't records of the store and are left out."""
    kind = F.substring("k", 1, 2)
    rows = records.where(kind.isin(DATA_PREFIX, TOMBSTONE_PREFIX))
    return rows.select(F.expr("substring(k, 3)").alias("k"), "seq", "v", (kind == TOMBSTONE_PREFIX).alias("deleted"))


def compact(log: DataFrame) -> DataFrame:
    """The log without history and tombstones."""
    return live(log)


def compaction_stats(log: DataFrame) -> DataFrame:
    """One row: versions before and after, and how many were old or tombstones."""
    kept = live(log).agg(F.count("*").alias("kept"))
    return log.agg(F.count("*").alias("versions"), F.sum(F.col("deleted").cast("long")).alias("tombstones")).crossJoin(kept).withColumn("dropped", F.col("versions") - F.col("kept"))


def compact_generation(spark: SparkSession, base: str, shards: int) -> int:
    """Rewrite the newest generation below ``base`` as a new one, partitioned by shard, and return its number.

    The new folder counts once its listing row is written; a failed run leaves a folder that
    no listing names.
    """
    from logtide.operators.shards import with_shard

    current = spark.read.parquet(f"{base}/generations").agg(F.max("generation")).first()[0]
    log = spark.read.parquet(f"{base}/data-{current}").select(*LOG_COLUMNS)
    number = current + 1
    spread = with_shard(live(log), shards).repartitionByRange("shard", "k")  # a shard of any size takes as many tasks as its rows ask for
    spread.sortWithinPartitions("shard", "k").write.mode("overwrite").partitionBy("shard").parquet(f"{base}/data-{number}")
    spark.range(1).select(F.lit(number).alias("generation"), F.lit(shards).alias("n")).write.mode("append").parquet(f"{base}/generations")
    return number
