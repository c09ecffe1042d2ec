"""Command line over a store: put, get, delete, history, list, export and statistics.

    python -m logtide --store /path/to/log put user:1 --value Alice
    python -m logtide --store /path/to/stores --kind extent --sharded history user:1 --output /tmp/values

A store of kind parquet can be written: each put or delete appends one version. Other kinds are read only.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.functions.text import is_printable_bytes
from logtide.operators import log
from logtide.sources import backends, formats

_PREVIEW_BYTES, _PREVIEW_TEXT = 40, 100
_LOG = "k binary, seq long, v binary, deleted boolean"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logtide", description="Read and write key-value stores.")
    top.add_argument("--store", required=True, help="folder or pattern of the store")
    top.add_argument("--kind", default="parquet", choices=sorted(backends.READERS), help="how the store is kept")
    top.add_argument("--sharded", action="store_true", help="the store's folder holds a folder for each shard")
    top.add_argument("--hex", action="store_true", help="keys are given in hexadecimal")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("get", "print a key's live value"), ("delete", "append a tombstone"), ("history", "print every value of a key"), ("put", "append a value")):
        command = commands.add_parser(name, help=text)
        command.add_argument("key")
        if name == "history":
            command.add_argument("--output", help="also write the values to files in this folder")
        if name == "put":
            value = command.add_mutually_exclusive_group(required=True)
            value.add_argument("--value")
            value.add_argument("--value-file")
    keys = commands.add_parser("keys", help="list live keys")
    keys.add_argument("--prefix", default="")
    commands.add_parser("info", help="print counts and sizes")
    commands.add_parser("dump", help="print every live pair")
    export = commands.add_parser("export", help="write every version of every key to files")
    export.add_argument("output")
    return top


def describe(number: int, value: bytes) -> list[str]:
    """Lines that show one value of a history: its bytes in hexadecimal, and its text where it is printable; long ones are cut."""
    cut = " ..." if len(value) > _PREVIEW_BYTES else ""
    lines = [f"{number}\t{len(value)} bytes\t{value[:_PREVIEW_BYTES].hex()}{cut}"]
    if is_printable_bytes(value):
        text = value.decode("utf-8", "replace")
        lines.append(f"{number}\ttext\t{text[:_PREVIEW_TEXT]}{' ...' if len(text) > _PREVIEW_TEXT else ''}")
    return lines


def _append(spark: SparkSession, path: str, rows: DataFrame, key: bytes, value: bytes | None) -> None:
    last = rows.agg(F.max("seq")).first()[0] or 0
    row = [(bytearray(key), last + 1, None if value is None else bytearray(value), value is None)]
    spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").parquet(path)


def run(arguments: list[str], spark: SparkSession, show: Callable[[str], None] = print) -> int:
    """One command; returns 0, or 1 where a key has no live value or the store can't be written."""
    options = parser().parse_args(arguments)
    key = None
    if "key" in options:
        key = bytes.fromhex(options.key) if options.hex else options.key.encode()
    writes = options.command in ("put", "delete")
    if writes and options.kind != "parquet":
        show(f"stores of kind {options.kind} are read only")
        return 1
    if options.kind == "parquet" and options.command == "put" and not formats.files_exist(options.store):
        rows = spark.createDataFrame([], T.StructType.fromDDL(_LOG))
    elif options.sharded:
        rows = backends.sharded(options.kind)(spark, options.store)
    else:
        rows = backends.open_log(spark, options.kind, options.store)
    rows = rows.select(F.col("k").cast("binary").alias("k"), "seq", F.col("v").cast("binary").alias("v"), "deleted")

    if writes:
        value = None
        if options.command == "put":
            value = options.value.encode() if options.value is not None else Path(options.value_file).read_bytes()
        _append(spark, options.store, rows, key, value)
        return 0
    if options.command == "get":
        found = log.live(rows.where(F.col("k") == F.lit(key))).collect()  # at most one row
        for row in found:
            show(bytes(row.v or b"").decode("utf-8", "replace"))
        return 0 if found else 1
    if options.command == "history":
        own = rows.where(F.col("k") == F.lit(key))
        found = log.history(own).orderBy("version_no")
        show(f"{found.count()} values of {key.hex()}")
        for row in found.toLocalIterator():
            for line in describe(row.version_no, bytes(row.v or b"")):
                show(line)
        if options.output:
            show(f"{formats.export_values(own, options.output)} values written below {options.output}")
    elif options.command == "keys":
        for row in log.prefix_scan(rows, options.prefix.encode()).select("k").orderBy("k").toLocalIterator():
            show(bytes(row.k).hex() if options.hex else bytes(row.k).decode("utf-8", "replace"))
    elif options.command == "dump":
        for row in log.live(rows).orderBy("k").toLocalIterator():
            show("\t".join(bytes(x or b"").decode("utf-8", "replace") for x in (row.k, row.v)))
    elif options.command == "info":
        size = log.size(rows.withColumn("k", F.hex("k")).withColumn("v", F.hex("v"))).first()
        operations = log.net_operations(rows).first()
        show(f"live keys\t{size.n_keys}")
        show(f"bytes of live pairs\t{size.n_bytes // 2}")
        show(f"puts less deletes\t{operations.net_ops or 0}")
    elif options.command == "export":
        show(f"{formats.export_values(rows, options.output)} values written below {options.output}")
    return 0
