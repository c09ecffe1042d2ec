"""Workloads of random operations against a log, and the rate at which a batch of them runs.

A batch of writes is one append and a batch of reads one look-up of all its keys, the log of the items included.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.hashing import random_bytes
from logtide.operators import log


@dataclass(frozen=True)
class Workload:
    name: str
    items: int
    key_bytes: tuple[int, int]
    value_bytes: tuple[int, int]
    read_percent: int
    operations: int
    seed: int = 42


WORKLOADS = (
    Workload("small", 1_000, (16, 32), (64, 256), 70, 100),
    Workload("medium", 100_000, (16, 64), (256, 1024), 70, 1_000),
    Workload("large", 1_000_000, (16, 128), (1024, 4096), 70, 1_000),
    Workload("sequential writes", 100_000, (16, 16), (1024, 1024), 0, 100_000),
    Workload("random reads", 100_000, (16, 16), (1024, 1024), 100, 100_000),
    Workload("hot keys", 100, (16, 16), (1024, 1024), 80, 100_000),
)


def items(spark: SparkSession, load: Workload) -> DataFrame:
    """The loaded log: a row an item."""
    rows = spark.range(1, load.items + 1, 1, 16)
    key = F.concat(F.lpad(F.hex("id"), 8, "0").cast("binary"), random_bytes(load.key_bytes[0] - 8, load.key_bytes[1] - 8, load.seed))
    return rows.select(key.alias("k"), F.col("id").alias("seq"), random_bytes(*load.value_bytes, load.seed + 7).alias("v"), F.lit(False).alias("deleted"))


def run(spark: SparkSession, load: Workload, path: str) -> dict[str, object]:
    """Load the items into Parquet below ``path``, then time the operations: the record of name, items, operations, seconds, rate and errors."""
    items(spark, load).write.mode("overwrite").parquet(f"{path}/log")
    stored = spark.read.parquet(f"{path}/log")
    picked = spark.range(load.operations).select("id", (F.rand(load.seed) * load.items + 1).cast("long").alias("seq"), (F.rand(load.seed + 1) * 100 < load.read_percent).alias("reads"))
    chosen = picked.join(stored.select("seq", "k"), "seq")
    chosen.write.mode("overwrite").parquet(f"{path}/operations")
    chosen = spark.read.parquet(f"{path}/operations")
    began = time.perf_counter()
    writes = chosen.where("NOT reads").groupBy("k").agg(F.max("id").alias("id")).select("k", random_bytes(*load.value_bytes, load.seed + 9).alias("v"))
    log.put(stored, writes).where(F.col("seq") > load.items).write.mode("overwrite").parquet(f"{path}/written")
    after = stored.unionByName(spark.read.parquet(f"{path}/written"))
    missing = log.get(after, chosen.where("reads")).where("NOT found").count()
    seconds = time.perf_counter() - began
    return asdict(load) | {"seconds": round(seconds, 3), "operations_per_second": round(load.operations / seconds, 1), "errors": missing}
