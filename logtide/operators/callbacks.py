"""User functions over all pairs. Values come back as rows; an error in a function fails the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.operators.log import live, prefix_scan

PairFunction = Callable[[pd.DataFrame], pd.DataFrame]


def _batched(function: PairFunction) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return run


def map_pairs(log: DataFrame, function: PairFunction, schema: str) -> DataFrame:
    """Apply a function to batches of live (k, v) pairs. The log it reads never changes, so results may be appended to it."""
    return live(log).select("k", "v").mapInPandas(_batched(function), schema)


def map_prefix(log: DataFrame, prefix: str | bytes, function: PairFunction, schema: str) -> DataFrame:
    return prefix_scan(log, prefix).select("k", "v").mapInPandas(_batched(function), schema)


def visit(log: DataFrame, function: Callable[[Iterator], None]) -> None:
    """Run a function with side effects over each partition of live pairs."""
    live(log).select("k", "v").foreachPartition(function)


def scan_until(log: DataFrame, stop: Column) -> DataFrame:
    """Live pairs in order of key up to the first for which ``stop`` is true, that one included; all if there is none.

    The first such key is one aggregate, so nothing is ordered and rows behind it are filtered where they are read.
    """
    pairs = live(log).select("k", "v")
    first = pairs.where(stop).agg(F.min("k").alias("_first"))
    return pairs.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col("k") <= F.col("_first"))).drop("_first")
