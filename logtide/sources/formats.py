"""JSON, object, relational and Parquet stores, metadata and exports; log and index files are in modules of their own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.text import is_printable_bytes
from logtide.operators.log import LOG_COLUMNS, live
from logtide.sources import files
from logtide.sources.extents import read_extent, write_extent
from logtide.sources.logfiles import checked_record, read_checked_log, read_store, read_timed_log, timed_record, write_store, write_timed_log

__all__ = [
    "checked_record", "export_history", "export_live", "export_values", "json_map", "read_checked_log", "read_extent", "read_jdbc", "read_json_map",
    "read_metadata", "read_object_rows", "read_objects", "read_parquet_log", "read_sql", "read_store", "read_tier_metadata", "read_timed_log", "timed_record", "write_extent",
    "write_metadata", "write_object_rows", "write_objects", "write_sql", "write_store", "write_tier_metadata", "write_timed_log",
]

#: Bytes of values that one JSON object holds, about.
JSON_BYTES = 32 << 20


def files_exist(path: str) -> bool:
    own, place = files.filesystem(path)
    return own.get_file_info(place).type != files.pafs.FileType.NotFound


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(k, v) of files that each hold one JSON object of base64 values."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return pairs.select("k", F.unbase64("v").alias("v"))


def json_map(pairs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of one JSON object each, with base64 values; keys are spread over ``buckets`` objects, by default as many as their bytes ask for."""
    if buckets is None:
        size = F.octet_length(F.col("k").cast("string")) + F.coalesce(F.octet_length(F.col("v").cast("binary")), F.lit(0))
        buckets = 1 + (pairs.agg(F.sum(size)).first()[0] or 0) // JSON_BYTES
    entry = F.struct("k", F.base64(F.col("v").cast("binary")).alias("v"))
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets))
    return pairs.groupBy(bucket.alias("bucket")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def read_objects(spark: SparkSession, base: str, prefix: str = "") -> DataFrame:
    """(k, v) of a folder or bucket with an object for each key, empty ones too; the key is the path behind ``base``.

    One task lists folder by folder, and all tasks read what is listed.
    """
    base = base.rstrip("/")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = files.filesystem(base)
        for batch in batches:
            todo = [f"{place}/{prefix}".rstrip("/")] * batch.num_rows
            while todo:
                found = own.get_file_info(files.pafs.FileSelector(todo.pop()))
                todo += [f.path for f in found if f.type == files.pafs.FileType.Directory]
                keys = [f.path[len(place) + 1 :] for f in found if f.type == files.pafs.FileType.File]
                for lo in range(0, len(keys), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 10_000], pa.string())], ["k"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = files.filesystem(base)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                with own.open_input_stream(f"{place}/{key}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([f.read()], pa.binary())], ["k", "v"])

    listed = spark.range(0, 1, 1, 1).select("id").mapInArrow(names, "k string")
    return listed.repartition("k").mapInArrow(contents, "k string, v binary")


def _written(pairs: DataFrame, write: Callable[[Iterator[tuple[bytes, bytes | None]]], int]) -> int:
    """Run a writer over each partition of (k, v) and add up what it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([write(rows)], pa.int64())], ["n"])

    rows = pairs.select(F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_objects(pairs: DataFrame, base: str) -> int:
    """Write each value of (k, v) as the object ``base``/k and return how many; writing a key again replaces its object. Keys are relative paths of text."""
    base = base.rstrip("/")
    store, root = files.filesystem(base)
    store.create_dir(root, recursive=True)  # without rows too

    def write(rows: Iterator[tuple[bytes, bytes | None]]) -> int:
        own, place = files.filesystem(base)
        made, n = set(), 0
        for k, v in rows:
            key = k.decode()
            if not key or key.startswith("/") or ".." in key.split("/"):
                raise ValueError(f"no object name: {key!r}")
            path = f"{place}/{key}"
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                own.create_dir(folder, recursive=True)
                made.add(folder)
            with own.open_output_stream(path) as out:
                out.write(v or b"")
            n += 1
        return n

    return _written(pairs, write)


def write_object_rows(rows: DataFrame, base: str) -> int:
    """Write every row of (k, v) as an object of its own below ``base`` and return how many; rows of one key, equal rows and nulls all stay.

    The path is the first byte of the key's SHA-256, then the whole of it and the row's number, so any key fits and no folder holds every object.
    The object is the sizes of key and value in ten places each (-1 for null), the key and the value. Rows are numbered by partition and
    place, so they must come from files or in another order that a task finds again when it is repeated.
    """
    k, v = F.col("k").cast("binary"), F.col("v").cast("binary")
    digest = F.sha2(F.coalesce(k, F.lit(b"")), 256)
    name = F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("."), F.monotonically_increasing_id().cast("string"))
    sizes = [F.lpad(F.coalesce(F.octet_length(x), F.lit(-1)).cast("string"), 10, " ").cast("binary") for x in (k, v)]
    return write_objects(rows.select(name.alias("k"), F.concat(*sizes, *[F.coalesce(x, F.lit(b"")) for x in (k, v)]).alias("v")), base)


def read_object_rows(spark: SparkSession, base: str) -> DataFrame:
    """(k, v) of the rows that ``write_object_rows`` wrote."""
    sizes = [F.trim(F.substring("v", at, 10).cast("string")).cast("int").alias(name) for at, name in ((1, "nk"), (11, "nv"))]
    rows = read_objects(spark, base).select(*sizes, "v")
    key, value = F.substring("v", F.lit(21), F.col("nk")), F.substring("v", F.lit(21) + F.greatest("nk", F.lit(0)), F.col("nv"))
    return rows.select(F.when(F.col("nk") >= 0, key).alias("k"), F.when(F.col("nv") >= 0, value).alias("v"))


def read_jdbc(spark: SparkSession, url: str, table: str = "kv_store") -> DataFrame:
    """(k, v, updated_at) of a relational key-value table; needs its JDBC driver on the class path."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table).load()
    return rows.select(F.col("key").alias("k"), F.col("value").alias("v"), "updated_at")


_TABLE = "CREATE TABLE IF NOT EXISTS kv_store (key TEXT PRIMARY KEY, value BLOB NOT NULL, updated_at INTEGER NOT NULL)"
_UPSERT = "INSERT INTO kv_store (key, value, updated_at) VALUES (?, ?, ?) ON CONFLICT (key) DO UPDATE SET value = excluded.value, updated_at = excluded.updated_at"


def write_sql(pairs: DataFrame, connect: Callable[[], object], stamp: int | None = None, batch: int = 1000) -> int:
    """Upsert (k, v) into the kv_store table that ``connect()``, a DB-API connection, reaches from every task; returns the rows.

    A task commits batch by batch; one that runs again upserts the same rows. ``stamp`` is updated_at in nanoseconds, by default now.
    """
    import time

    stamp = time.time_ns() if stamp is None else stamp

    def write(rows: Iterator[tuple[bytes, bytes | None]]) -> int:
        connection, n, held = connect(), 0, []
        try:
            connection.cursor().execute(_TABLE)
            for k, v in rows:
                held.append((k.decode(), v or b"", stamp))
                if len(held) >= batch:
                    connection.cursor().executemany(_UPSERT, held)
                    connection.commit()
                    n, held = n + len(held), []
            connection.cursor().executemany(_UPSERT, held)
            connection.commit()
        finally:
            connection.close()
        return n + len(held)

    return _written(pairs, write)


def read_sql(spark: SparkSession, connect: Callable[[], object], parts: int = 8) -> DataFrame:
    """(k, v, updated_at) of the kv_store table behind a DB-API connection, in ``parts`` ranges of keys that the table's counts cut."""
    connection = connect()
    try:
        cursor = connection.cursor()
        n = cursor.execute("SELECT count(*) FROM kv_store").fetchone()[0]
        places = sorted({n * i // parts for i in range(1, parts)} - {0})
        cuts = [cursor.execute("SELECT key FROM kv_store ORDER BY key LIMIT 1 OFFSET ?", (i,)).fetchone()[0] for i in places]
    finally:
        connection.close()
    ranges = list(zip([None, *cuts], [*cuts, None], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i in part.column(0).to_pylist():
                low, high = ranges[i]
                tests = [t for t, x in (("key >= ?", low), ("key < ?", high)) if x is not None]
                own = connect()
                try:
                    cursor = own.cursor()
                    cursor.execute("SELECT key, value, updated_at FROM kv_store" + (" WHERE " + " AND ".join(tests) if tests else ""), [x for x in (low, high) if x is not None])
                    while rows := cursor.fetchmany(1000):
                        k, v, at = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(v, pa.binary()), pa.array(at, pa.int64())], ["k", "v", "updated_at"])
                finally:
                    own.close()

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, "k string, v binary, updated_at long")


def read_parquet_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*LOG_COLUMNS)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Shard metadata files: generation, n, totalKeys."""
    return spark.read.schema("generation long, n long, totalKeys long").json(path, multiLine=True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_metadata(spark: SparkSession, path: str, generation: int, n: int, total_keys: int) -> None:
    _write_text(spark, path, json.dumps({"generation": generation, "n": n, "totalKeys": total_keys}))


_TIERS = "tiers array<struct<level: long, store_ids: array<string>, total_size: long>>, max_tier_sizes array<long>, last_flush string"


def read_tier_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row a tier: level, store_ids, total_size, max_size, last_flush and whether the tier is over its limit."""
    file = spark.read.schema(_TIERS).json(path, multiLine=True)
    tiers = file.select("max_tier_sizes", F.to_timestamp("last_flush").alias("last_flush"), F.explode("tiers").alias("t")).select("t.*", "max_tier_sizes", "last_flush")
    limit = F.get("max_tier_sizes", F.col("level").cast("int"))
    return tiers.select("level", "store_ids", "total_size", limit.alias("max_size"), "last_flush", F.coalesce(F.col("total_size") > limit, F.lit(False)).alias("over"))


def write_tier_metadata(spark: SparkSession, path: str, tiers: list[tuple[int, list[str], int]], max_sizes: list[int], last_flush: str) -> None:
    entries = [{"level": level, "store_ids": ids, "total_size": size} for level, ids, size in tiers]
    _write_text(spark, path, json.dumps({"tiers": entries, "max_tier_sizes": max_sizes, "last_flush": last_flush}))


def export_values(log: DataFrame, path: str) -> int:
    """Every version of every key as a file named by the key in hex, "value" and the version from 1 on, .bin, and .txt too where it is printable. Returns the versions."""
    from logtide.operators.log import history

    names = history(log).select(F.concat(F.lower(F.hex(F.col("k").cast("binary"))), F.lit("value"), F.col("version_no").cast("string")).alias("k"), "v")

    def write(rows: Iterator[tuple[bytes, bytes | None]]) -> int:
        own, place = files.filesystem(path.rstrip("/"))
        own.create_dir(place, recursive=True)
        n = 0
        for name, v in rows:
            for ending in ("bin", "txt") if is_printable_bytes(v or b"") else ("bin",):
                with own.open_output_stream(f"{place}/{name.decode()}.{ending}") as out:
                    out.write(v or b"")
            n += 1
        return n

    return _written(names, write)


def export_history(log: DataFrame, path: str) -> None:
    """Every version as a row of (key in hex, version, value), partitioned files below ``path``."""
    from logtide.operators.log import history

    rows = history(log).select(F.lower(F.hex(F.col("k").cast("binary"))).alias("key_hex"), "version_no", "v")
    rows.write.mode("overwrite").parquet(path)


def export_live(log: DataFrame, path: str, buckets: int | None = None) -> None:
    json_map(live(log).select("k", "v"), buckets).select("value").write.mode("overwrite").text(path)
