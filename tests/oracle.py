"""Compare a Spark query with its DuckDB twin."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def check(spark, function, sql: str, sf: str = "sf0.001") -> None:
    connection = duckdb.connect()
    for path in (DATA / sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    mine, theirs = function(spark, str(DATA / sf)), connection.execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert _sorted(mine.columns, [tuple(r) for r in mine.collect()]) == _sorted(names, theirs.fetchall())
