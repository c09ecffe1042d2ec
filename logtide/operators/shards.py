"""Hash shards and hash trees: routing, statistics and split plans."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions.hashing import HashFunction, hash_prefix, route_hash, shard_of


def with_shard(log: DataFrame, shards: int, hash_function: HashFunction = route_hash) -> DataFrame:
    return log.withColumn("shard", shard_of(F.col("k"), shards, hash_function))


def shard_number(key: str | bytes, shards: int) -> int:
    """The shard of one key, computed on the driver so that a stored table's partition filter can use it."""
    raw = key.encode() if isinstance(key, str) else key
    low = int.from_bytes(hashlib.md5(raw).digest()[8:], "big", signed=True)
    return abs(low) % shards


def point_lookup(sharded: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows of one key of a table partitioned by shard: one partition is read."""
    return sharded.where((F.col("shard") == shard_number(key, shards)) & (F.col("k") == key))


def shard_stats(rows: DataFrame, value_bytes: str = "bytes") -> DataFrame:
    """Keys and bytes of each shard and in total (shard null), from one aggregation."""
    return rows.rollup("shard").agg(F.count("*").alias("n_keys"), F.sum(value_bytes).cast("long").alias("n_bytes"))


def split_plan(rows: DataFrame, limit: int, depth: int, hash_function: HashFunction = route_hash) -> DataFrame:
    """Tree nodes at ``depth`` with keys, bytes, and whether they are over the limit and split into 16 children."""
    nodes = rows.withColumn("node", hash_prefix(F.col("k"), depth, hash_function)).groupBy("node")
    return nodes.agg(F.count("*").alias("n_keys"), F.sum("bytes").cast("long").alias("n_bytes")).withColumn("split", F.col("n_bytes") > limit)


def split_rows(rows: DataFrame, limit: int, max_depth: int = 4, hash_function: HashFunction = route_hash) -> DataFrame:
    """Each row's tree node: the shortest prefix of its hash whose node holds at most ``limit`` bytes, or that of max_depth."""
    leaf = rows.withColumn("_leaf", hash_prefix(F.col("k"), max_depth, hash_function))
    nodes = leaf.groupBy("_leaf").agg(F.sum("bytes").alias("_bytes"))  # at most 8 * 16 ** max_depth rows
    choice = F.col("_leaf")
    for length in range(max_depth, -1, -1):
        prefix = F.substring("_leaf", 1, length)
        fits = F.sum("_bytes").over(Window.partitionBy(prefix)) <= limit
        choice = F.when(fits, prefix).otherwise(choice)
    return leaf.join(nodes.select("_leaf", choice.alias("node")), "_leaf").drop("_leaf")
