"""Row-table files: rows of one width one after another, and a bank of strings that rows point into.

A string in the bank starts at its offset and ends before the next zero byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.operators.table import string_bank
from logtide.sources import files
from logtide.sources.files import Reader

#: Rows that one task reads.
RANGE_ROWS = 1 << 18


def read_rows(spark: SparkSession, path: str, fields: list[tuple[str, str]], strings: str | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a table file, numbered by ``row_no`` from 1, with ``fields`` of a name and a numpy number type such as ``<i8``.

    Fields in ``text`` are offsets into the bank file ``strings`` and come out as its strings. A last row that isn't whole is left out.
    """
    kind = np.dtype(fields)
    length = files.listed(spark, path).agg(F.sum("length")).first()[0]
    if strings is None and text:
        raise ValueError("text fields need a bank of strings")
    rows = (length or 0) // kind.itemsize
    types = {"i": "long", "u": "long", "f": "double"}
    schema = ", ".join(["row_no long", *(f"`{name}` {'string' if name in text else types[kind[name].kind]}" for name in kind.names)])

    def looked_up(bank: Reader, offsets: np.ndarray) -> list[str | None]:
        out = []
        for at in offsets.tolist():
            if not 0 <= at < bank.end:
                out.append(None)
                continue
            bank.at, size, whole = at, 64, b""
            while b"\0" not in whole and len(whole) < bank.left():
                whole = bank.peek(min(size, bank.left()))
                size *= 4
            out.append(whole.split(b"\0", 1)[0].decode("utf-8", "replace"))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                hi = min(lo + RANGE_ROWS, rows)
                bank = Reader(strings) if text else None
                reader = Reader(path, lo * kind.itemsize, hi * kind.itemsize)
                for first in range(lo, hi, 10_000):
                    n = min(10_000, hi - first)
                    part = np.frombuffer(reader.take(n * kind.itemsize), kind)
                    columns = [pa.array(np.arange(first + 1, first + n + 1))]
                    for name in kind.names:
                        value = part[name]
                        if name in text:
                            columns.append(pa.array(looked_up(bank, value), pa.string()))
                        else:
                            columns.append(pa.array(value.astype(np.float64 if kind[name].kind == "f" else np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, ["row_no", *kind.names])

    return spark.range(0, rows, RANGE_ROWS).mapInArrow(run, schema)


def banked(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``column`` as offset into a bank, the bank as (s, offset)); a null has offset -1."""
    bank = string_bank(rows, column)
    offsets = bank.select(F.col("s").alias(column), F.col("offset").alias("_offset"))
    joined = rows.join(offsets, column, "left").withColumn(column, F.coalesce("_offset", F.lit(-1).cast("long"))).drop("_offset")
    return joined.select(*rows.columns), bank


def write_rows(rows: DataFrame, path: str, fields: list[tuple[str, str]]) -> int:
    """Write (row_no, fields) as one table file in order of row_no, and return the rows. One task streams them: a table file is one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, n = np.dtype(fields), 0
        own, place = files.filesystem(path)
        with own.open_output_stream(place) as out:
            for batch in batches:
                part = np.zeros(batch.num_rows, kind)
                for i, name in enumerate(kind.names):
                    part[name] = batch.column(i).to_numpy(zero_copy_only=False)
                out.write(part.tobytes())
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = rows.orderBy("row_no").coalesce(1).select(*(name for name, _ in fields))
    return ordered.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_bank(bank: DataFrame, path: str) -> int:
    """Write a bank (s, offset) as one file, each string with a zero byte behind it, and return its bytes. A bank is a dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = files.filesystem(path)
        n = 0
        with own.open_output_stream(place) as out:
            for batch in batches:
                for s, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if at != n:
                        raise ValueError(f"offset {at} where {n} bytes lie before")
                    out.write(s.encode() + b"\0")
                    n += len(s.encode()) + 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return bank.select("s", "offset").orderBy("offset").coalesce(1).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
