"""Checks and recovery of logs: checksums, valid prefixes, offset indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions.hashing import align8, guard, record_crc
from logtide.operators.blocks import next_value, running_sum


def with_crc(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.withColumn("crc", record_crc(F.col(key), F.col(value)))


def crc_mismatches(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose stored ``crc`` isn't that of their bytes."""
    return rows.where(~F.col("crc").eqNullSafe(record_crc(F.col(key), F.col(value))))


def valid_prefix(rows: DataFrame, bad: str = "bad") -> DataFrame:
    """Records before the first bad one, by seq; the first bad seq is one aggregate, so nothing is ordered."""
    first_bad = rows.where(F.col(bad)).agg(F.min("seq").alias("_bad"))
    return rows.crossJoin(F.broadcast(first_bad)).where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")


def offset_lengths(index: DataFrame, group: str) -> DataFrame:
    """Length of each record of an index of (group, entry, off): the next offset less this one, signs aside. A group of any size is ordered block by block."""
    sized = next_value(index.withColumn("_end", F.abs("off")), "_end", "entry", "_next", [group])
    return sized.withColumn("length", F.col("_next") - F.col("_end")).withColumn("tombstone", F.col("off") < 0).drop("_end", "_next")


def with_offsets(rows: DataFrame, group: str, order: str, size: str, deleted: Column) -> DataFrame:
    """``off``: where each record starts in its group's data file, negative for a tombstone."""
    return running_sum(rows, size, order, "_start", [group]).withColumn("off", F.when(deleted, -F.col("_start")).otherwise(F.col("_start")).cast("long")).drop("_start")


def reconcile(files: DataFrame, slack: int = 8) -> DataFrame:
    """Classify data files against their index's last offset: ok, truncate (data is longer), lost_tail (short by at most
    ``slack`` bytes, whose last record is dropped rather than filled up) or unrecoverable."""
    short = F.col("index_end") - F.col("data_end")
    state = F.when(short == 0, "ok").when(short < 0, "truncate").when(short <= slack, "lost_tail").otherwise("unrecoverable")
    return files.withColumn("state", state)


def join_index_data(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Key entries with the value entries of the same number."""
    return keys.join(values, "entry")


def sign_conflicts(index: DataFrame) -> DataFrame:
    """Entries whose key and value offsets disagree about being a tombstone."""
    return index.where((F.col("key_off") < 0) != (F.col("value_off") < 0))


def order_violations(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Rows of a run that aren't after the row before them."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy("entry"))
    return rows.withColumn("_before", before).where(F.col("_before") >= F.col(key)).drop("_before")


def pool_statistics(rows: DataFrame, capacity: int) -> DataFrame:
    """One row on a pool of (bytes) records, each at the next multiple of eight: records, bytes used and free, and the share used in percent."""
    used = F.coalesce(F.sum(align8(F.col("bytes"))), F.lit(0)).cast("long")
    total = rows.agg(F.count("*").alias("n_records"), used.alias("used"))
    return total.select("n_records", "used", (F.lit(capacity) - F.col("used")).cast("long").alias("free"), (F.col("used") * 100.0 / capacity).alias("used_percent"))


def guard_violations(rows: DataFrame, front: str, rear: str) -> DataFrame:
    """Rows whose rear guard isn't the complement of the front one; a missing guard is a violation."""
    return rows.where(~F.col(front).eqNullSafe(guard(F.col(rear))))


def beyond(rows: DataFrame, off: str, length: str, capacity: Column) -> DataFrame:
    """Records that start before their file or end behind it."""
    return rows.where((F.col(off) < 0) | (F.col(length) < 0) | (F.col(off) + F.col(length) > capacity))
