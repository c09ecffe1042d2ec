"""Extent stores: folders with keys.dat, keys.index, values.dat and values.index.

An index holds big-endian 64-bit offsets, the first 0, then the end of each record; a record
spans two neighbours, and a negative start offset marks a tombstone. The value of a tombstone is the text DELETED.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.sources import files
from logtide.sources.files import FILE_RECORDS, Reader, Record

#: Entries that one task reads.
RANGE_ENTRIES = 1 << 16
TOMBSTONE_VALUE = b"DELETED"
_NAMES = ("keys.index", "values.index", "keys.dat", "values.dat")


def _offsets(uri: str, lo: int, hi: int) -> np.ndarray:
    return np.frombuffer(Reader(uri, 8 * lo, 8 * (hi + 1)).take(8 * (hi + 1 - lo)), ">i8").astype(np.int64)


def _pieces(folder: str, kind: str, lo: int, hi: int) -> Iterator[tuple[bytes | None, bool]]:
    """Bytes and sign of entries lo to hi; no bytes for an entry that the data file is too short for or whose end isn't after its start."""
    offsets = _offsets(f"{folder}/{kind}.index", lo, hi)
    starts, ends = np.abs(offsets[:-1]), np.abs(offsets[1:])
    reader = Reader(f"{folder}/{kind}.dat", int(starts[0]))
    for a, b, gone in zip(starts.tolist(), ends.tolist(), (offsets[:-1] < 0).tolist(), strict=True):
        if b < a or b > reader.end:
            yield None, gone
            continue
        if a != reader.at:
            reader = Reader(f"{folder}/{kind}.dat", a)
        yield reader.take(b - a), gone


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records(folder: str, number: int, lo: int, hi: int) -> Iterator[Record]:
        pairs = zip(_pieces(folder, "keys", lo, hi), _pieces(folder, "values", lo, hi), strict=True)
        for n, ((k, k_gone), (v, v_gone)) in enumerate(pairs, lo):
            if k is not None and v is not None:
                yield k, number * FILE_RECORDS + n, None if k_gone or v_gone else v, k_gone or v_gone

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            yield from files.batched(records(*row))


def read_extent(spark: SparkSession, path: str) -> DataFrame:
    """The log of one store, or of several folders each by itself; seq grows with the folder's number and the entry's.

    Entries that a data file is too short for are left out, as is a last index entry of zero.
    """
    found = files.listed(spark, path).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    lengths = [F.max(F.when(F.col("name") == name, F.col("length"))).alias(f"n{i}") for i, name in enumerate(_NAMES)]
    stores = found.where(F.col("name").isin(*_NAMES)).groupBy("folder").agg(*lengths).where("n0 is not null and n1 is not null")  # empty files aren't listed, and data files may be empty
    numbered = stores.withColumn("number", (F.row_number().over(Window.orderBy("folder")) - 1).cast("long"))  # a row a store
    entries = (F.least("n0", "n1") / 8).cast("long") - 1
    ranges = numbered.where(entries > 0).select("folder", "number", entries.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), entries - 1, F.lit(RANGE_ENTRIES).cast("long"))).alias("lo"))
    ranges = ranges.select("folder", "number", "lo", F.least(F.col("lo") + RANGE_ENTRIES, "n").alias("hi"))
    return ranges.repartition("folder", "lo").mapInArrow(_read, files.LOG_TYPE)


def _write(folder: str, records: Iterator[Record]) -> None:
    own, place = files.filesystem(folder)
    with (
        own.open_output_stream(f"{place}/keys.dat") as keys,
        own.open_output_stream(f"{place}/values.dat") as values,
        own.open_output_stream(f"{place}/keys.index") as key_index,
        own.open_output_stream(f"{place}/values.index") as value_index,
    ):
        key_end = value_end = 0
        for k, _, v, gone in records:
            if gone and not (key_end or value_end):
                continue  # offset 0 has no negative, and nothing is there to delete
            sign = -1 if gone else 1
            key_index.write((sign * key_end).to_bytes(8, "big", signed=True))
            value_index.write((sign * value_end).to_bytes(8, "big", signed=True))
            body = TOMBSTONE_VALUE if gone else v or b""
            keys.write(k)
            values.write(body)
            key_end, value_end = key_end + len(k), value_end + len(body)
        key_index.write(key_end.to_bytes(8, "big", signed=True))
        value_index.write(value_end.to_bytes(8, "big", signed=True))


def write_extent(log: DataFrame, path: str, shards: int) -> None:
    """Every version of a log as extent stores, a folder a shard, in order of seq. A tombstone before anything else in a shard deletes nothing and is left out."""
    files.write_shards(log, path, shards, _write, ["seq"])
