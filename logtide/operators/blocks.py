"""Running sums and neighbours along a long order, without one task that orders it all.

The order is cut into blocks of ``width`` consecutive numbers. Blocks are aggregated first; what is carried
from block to block is a row a block, and rows are ordered within their block only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 20


def _same(left: list[str]) -> list:
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in left]


def _joined(rows: DataFrame, blocks: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows with ``columns`` of their block; keys may be null."""
    return rows.alias("l").join(blocks.alias("r"), _same(keys), "left").select("l.*", *(f"r.{c}" for c in columns))


def running_sum(rows: DataFrame, value: str, order: str, to: str, group: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds ``to``: the sum of ``value`` over the rows before this one, by ``order``, an integer that is distinct within a group."""
    group = group or []
    block = rows.withColumn("_blk", F.floor(F.col(order) / width))
    keys = [*group, "_blk"]
    sums = block.groupBy(*keys).agg(F.sum(value).alias("_blk_sum"))
    ahead = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_blk_ahead", F.coalesce(F.sum("_blk_sum").over(ahead), F.lit(0)))
    inside = block.withColumn("_blk_in", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return _joined(inside, carried, keys, "_blk_ahead").withColumn(to, F.col("_blk_ahead") + F.col("_blk_in")).drop("_blk", "_blk_ahead", "_blk_in")


def next_value(rows: DataFrame, value: str, order: str, to: str, group: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds ``to``: ``value`` of the row after this one, by ``order``, an integer that is distinct within a group; null for the last."""
    group = group or []
    block = rows.withColumn("_blk", F.floor(F.col(order) / width))
    keys = [*group, "_blk"]
    firsts = block.groupBy(*keys).agg(F.min_by(value, order).alias("_blk_first"))
    following = firsts.withColumn("_blk_next", F.lead("_blk_first").over(Window.partitionBy(*group).orderBy("_blk")))
    within = Window.partitionBy(*keys).orderBy(order)
    inside = block.withColumn("_blk_lead", F.lead(value).over(within)).withColumn("_blk_last", F.lead(F.lit(1)).over(within).isNull())
    return _joined(inside, following, keys, "_blk_next").withColumn(to, F.when(F.col("_blk_last"), F.col("_blk_next")).otherwise(F.col("_blk_lead"))).drop("_blk", "_blk_next", "_blk_lead", "_blk_last")
