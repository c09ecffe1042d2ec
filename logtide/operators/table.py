"""The row table: numbered rows that are added, deleted, sorted, searched and weeded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def add_rows(table: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Append rows, numbered behind the last; numbers start at 1. One task numbers the batch, so batches are small against the table."""
    last = table.agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("_last"))
    numbered = rows.crossJoin(F.broadcast(last)).withColumn("row_no", (F.col("_last") + F.row_number().over(Window.orderBy(order))).cast("long"))
    return table.unionByName(numbered.select(*table.columns))


def delete_row(table: DataFrame, row_no: int) -> DataFrame:
    """Delete by moving the last row into the gap."""
    last = table.agg(F.max("row_no").alias("_last"))
    moved = F.when(F.col("row_no") == F.col("_last"), F.lit(row_no).cast("long")).otherwise(F.col("row_no"))
    kept = table.crossJoin(F.broadcast(last)).where(F.col("row_no") != row_no)
    return kept.withColumn("row_no", F.when(F.col("_last") >= row_no, moved).otherwise(F.col("row_no"))).drop("_last")


def fetch(table: DataFrame, row_no: int) -> DataFrame:
    return table.where(F.col("row_no") == row_no)


def sort_rows(table: DataFrame, *by: str | Column) -> DataFrame:
    return table.orderBy(*by)


def sort_by_key(table: DataFrame, key: Callable[[pd.DataFrame], pd.Series], kind: str) -> DataFrame:
    """Sort by what a function makes of each batch of rows, of SQL type ``kind``: an order of the caller's own. Rows of equal keys keep the order of row_no."""
    schema = T.StructType([*table.schema.fields, T.StructField("_key", T.StructType.fromDDL(f"k {kind}")["k"].dataType)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_key=key(batch))

    return table.mapInPandas(run, schema).orderBy("_key", "row_no").drop("_key")


def search(table: DataFrame, column: str, probes: DataFrame) -> DataFrame:
    """Rows whose column equals a probe."""
    return table.join(probes.select(F.col("probe").alias(column)), column, "left_semi")


def search_nearest(table: DataFrame, column: str, probe: object) -> DataFrame:
    """One row: the largest value not above the probe and the smallest above it."""
    c = F.col(column)
    return table.agg(F.max(F.when(c <= probe, c)).alias("at_or_below"), F.min(F.when(c > probe, c)).alias("above"))


def weed(table: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each group of equal rows."""
    first = Window.partitionBy(*keys).orderBy("row_no")
    return table.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def weeded_count(table: DataFrame, keys: list[str]) -> DataFrame:
    distinct = table.select(*keys).distinct().agg(F.count("*").alias("_kept"))
    return table.agg(F.count("*").alias("n_rows")).crossJoin(distinct).select("n_rows", (F.col("n_rows") - F.col("_kept")).alias("removed"))


def string_bank(rows: DataFrame, column: str) -> DataFrame:
    """Distinct strings with their offset in a bank that holds them one after another, by order of text, each with an end byte.

    The bank is a dictionary, one row a distinct string.
    """
    distinct = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("s")).distinct()
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return distinct.select("s", F.coalesce(F.sum(F.octet_length("s") + 1).over(before), F.lit(0)).cast("long").alias("offset"))
