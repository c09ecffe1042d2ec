"""Backends by name; a backend reads a location as a log or as pairs. Others can be registered, and wrap one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.operators.log import LOG_COLUMNS
from logtide.sources import formats

Reader = Callable[[SparkSession, str], DataFrame]


def _as_log(read: Reader) -> Reader:
    """Pairs as a log of one version."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        return read(spark, path).select("k", F.lit(0).cast("long").alias("seq"), "v", F.lit(False).alias("deleted"))

    return run


READERS: dict[str, Reader] = {
    "parquet": formats.read_parquet_log,
    "timed": formats.read_timed_log,
    "checked": formats.read_checked_log,
    "store": formats.read_store,
    "extent": formats.read_extent,
    "json": _as_log(formats.read_json_map),
    "objects": _as_log(formats.read_objects),
    "jdbc": _as_log(formats.read_jdbc),
}


def register(name: str, reader: Reader) -> None:
    READERS[name] = reader


def sharded(inner: str) -> Reader:
    """A backend over the shard folders 0, 1, ... of a location, each of the inner kind."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        return READERS[inner](spark, f"{path}/*").select(*LOG_COLUMNS)

    return run


def open_log(spark: SparkSession, kind: str, path: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no backend {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path)
