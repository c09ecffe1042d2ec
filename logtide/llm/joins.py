"""Joins that broadcast only after counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of id rows is broadcast up to this many rows (16 MB of longs); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def counted(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few fixed-width columns, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(table) if table.count() <= limit else table


def keep_listed(rows: DataFrame, listed: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose ``on`` columns are in ``listed``, a stored table of distinct fixed-width keys."""
    small = listed.count() <= limit
    return rows.join(F.broadcast(listed) if small else listed.hint("merge"), on, "left_semi")


#: Cut points that one aggregate works out; more of them come from Spark's range partitioner.
AGGREGATED_PARTS = 1000


def quantiles(docs: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 increasing cut points of an integer column, from that column alone."""
    if parts < 2:
        return []
    if parts > AGGREGATED_PARTS:
        ranged = docs.select(column).where(F.col(column).isNotNull()).repartitionByRange(parts, column)
        tops = ranged.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.max(column).alias("top"))
        return sorted({r["top"] for r in tops.collect()})[:-1]  # a number for each part
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = docs.agg(F.percentile_approx(column, shares, max(10_000, 20 * parts))).first()[0]
    return sorted(set(found or []))
