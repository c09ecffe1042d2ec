"""The change log relation ``(k, seq, v, deleted)`` and what follows from it.

``seq`` orders the versions of a key. A tombstone is a row with ``deleted``; an empty or null
value is a value. Everything is a function from DataFrames to DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG_COLUMNS = ["k", "seq", "v", "deleted"]


def build_log(rows: DataFrame, key: Column, seq: Column, value: Column, deleted: Column | None = None) -> DataFrame:
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    return rows.select(key.alias("k"), seq.cast("long").alias("seq"), value.alias("v"), gone.alias("deleted"))


def latest(log: DataFrame) -> DataFrame:
    """The newest row of each key, tombstones included."""
    newest = Window.partitionBy("k").orderBy(F.desc("seq"))
    return log.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def live(log: DataFrame) -> DataFrame:
    """The newest row of each key that isn't deleted; the flag is tested after the newest row is known."""
    return latest(log).where("NOT deleted")


def first_wins(log: DataFrame) -> DataFrame:
    """The oldest row of each key: a store that ignores later inserts."""
    oldest = Window.partitionBy("k").orderBy("seq")
    return log.where("NOT deleted").withColumn("_rn", F.row_number().over(oldest)).where("_rn = 1").drop("_rn")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live pairs as they were once version ``seq`` was written."""
    return live(log.where(F.col("seq") <= seq))


def history(log: DataFrame) -> DataFrame:
    """Every value a key ever held, oldest first by ``version_no``."""
    order = Window.partitionBy("k").orderBy("seq")
    return log.where("NOT deleted").withColumn("version_no", F.row_number().over(order).cast("long"))


# Access


#: Keys that one look-up broadcasts; more of them meet the log in a shuffle on the key, which the resolution then uses too.
BROADCAST_KEYS = 1_000_000


def asked(log: DataFrame, keys: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The log of the keys asked for: other keys' rows go before versions are compared."""
    wanted = keys.select("k").distinct()
    few = wanted.limit(broadcast_keys + 1).count() <= broadcast_keys
    return log.join(F.broadcast(wanted) if few else wanted.hint("merge"), "k", "left_semi")


def get(log: DataFrame, keys: DataFrame, *, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """A row for each key asked for: its live value, or null and found = false."""
    current = live(asked(log, keys, broadcast_keys)).select("k", "v", F.lit(True).alias("found"))
    return keys.select("k").distinct().join(current, "k", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exists(log: DataFrame, keys: DataFrame, *, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Keys with a presence flag; values are never read."""
    unvalued = log.select("k", "seq", F.lit(None).cast("string").alias("v"), "deleted")
    return get(unvalued, keys, broadcast_keys=broadcast_keys).select("k", F.col("found").alias("present"))


def present(log: DataFrame, keys: DataFrame, *, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    return keys.join(live(asked(log, keys, broadcast_keys)).select("k"), "k", "left_semi")


def absent(log: DataFrame, keys: DataFrame, *, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    return keys.join(live(asked(log, keys, broadcast_keys)).select("k"), "k", "left_anti")


def prefix_filter(column: str, prefix: str | bytes) -> Column:
    """Keys with a prefix, as a predicate that reaches the file scan.

    Text uses startswith; bytes a half-open range up to the prefix's successor, which a prefix
    of 0xFF bytes only doesn't have.
    """
    if isinstance(prefix, str):
        return F.col(column).startswith(prefix)
    stem = prefix.rstrip(b"\xff")
    above = F.col(column) >= F.lit(prefix)
    return above & (F.col(column) < F.lit(stem[:-1] + bytes([stem[-1] + 1]))) if stem else above


def prefix_scan(log: DataFrame, prefix: str | bytes) -> DataFrame:
    """Live pairs under a prefix; keys are filtered before versions are compared."""
    return live(log.where(prefix_filter("k", prefix)))


def keys(log: DataFrame) -> DataFrame:
    return live(log).select("k")


def size(log: DataFrame) -> DataFrame:
    """One row: live keys and the bytes of live keys and values."""
    length = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return live(log).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(length("k") + length("v")), F.lit(0)).cast("long").alias("n_bytes"))


# Changes


def _after(log: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Number a batch behind the log's last version."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    rank = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
    return batch.crossJoin(F.broadcast(last)).withColumn("seq", (F.col("_last") + rank).cast("long")).drop("_last")


def put(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Append (k, v) rows of a batch as one version; keys of a batch are distinct."""
    return log.unionByName(_after(log, batch, []).select("k", "seq", "v", F.lit(False).alias("deleted")))


def delete(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Append a tombstone for every key of a batch; unknown keys are harmless."""
    kind = log.schema["v"].dataType
    return log.unionByName(_after(log, batch, []).select("k", "seq", F.lit(None).cast(kind).alias("v"), F.lit(True).alias("deleted")))


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(k, v) of a stored map after a batch of (k, v): batch values win."""
    both = stored.select("k", "v", F.lit(0).alias("seq"), F.lit(False).alias("deleted"))
    return live(both.unionByName(batch.select("k", "v", F.lit(1).alias("seq"), F.lit(False).alias("deleted")))).select("k", "v")


def size_limits(rows: DataFrame, key: str, value: str, max_key: int, max_value: int) -> DataFrame:
    """Rows with ``accepted``: a key of 1 to max_key bytes and a value of at most max_value bytes."""
    fits = F.octet_length(key).between(1, max_key) & (F.octet_length(value) <= max_value)
    return rows.withColumn("accepted", F.coalesce(fits, F.lit(False)))


def net_operations(log: DataFrame) -> DataFrame:
    """One row: puts less deletes, and the keys that really are live."""
    counted = log.agg(F.sum(F.when(F.col("deleted"), -1).otherwise(1)).cast("long").alias("net_ops"))
    return counted.crossJoin(live(log).agg(F.count("*").alias("n_keys")))


def recent(log: DataFrame, n: int = 50) -> DataFrame:
    """The last n operations, the newest first."""
    return log.orderBy(F.desc("seq")).limit(n)
