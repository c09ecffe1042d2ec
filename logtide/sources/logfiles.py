"""Log files: timestamped logs, checked logs, and single-file stores of a header, a checked log and sorted runs.

All numbers are little-endian. A log is cut at its first record that isn't valid.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from logtide.sources import files
from logtide.sources.files import Reader, Record

Entry = tuple[bytes, bytes | None, bool]

# Fixed values of the file formats.
# Timestamped log: int64 nanoseconds, uint32 key length, uint32 value length, key, value.
TIMED_HEADER, TIMED_DELETED = "<qII", 0xFFFFFFFF
# Largest key and value of a timestamped log; a larger one ends it.
TIMED_MAX_KEY, TIMED_MAX_VALUE = 32768, 1073741822
# Checked log: uint64 CRC-32 of key and value, int64 key length, int64 value length, uint32 flags, key, value.
CHECKED_HEADER, CHECKED_DELETED = "<QqqI", -1
# Entry of a sorted run: uint64 CRC-32, int64 key length, int64 value length, key, value.
RUN_HEADER = "<Qqq"
# Largest key and value of a checked log or a run.
MAX_KEY, MAX_VALUE = 1 << 30, 1 << 40
# Store header: uint32 magic, uint32 version, uint64 offsets of log, runs and run list, uint32 runs, uint32 CRC-32 of these; one page.
STORE_HEADER, STORE_MAGIC, STORE_VERSION, STORE_PAGE = "<IIQQQI", 0x4C534D46, 1, 4096
# Run list: uint64 offset, uint64 size, uint32 entries, uint32 CRC-32 of the run, uint32 lengths of the smallest and largest key, both keys.
LIST_HEADER = "<QQIIII"
# Bytes that a store keeps for its log.
LOG_BYTES = 64 << 20

#: Bytes of keys and values that a written store holds in one run, which is built in memory.
RUN_BYTES = 8 << 20


def timed_entries(reader: Reader) -> Iterator[Entry]:
    head = struct.calcsize(TIMED_HEADER)
    while (raw := reader.take(head)) is not None:
        stamp, n_key, n_value = struct.unpack(TIMED_HEADER, raw)
        gone = n_value == TIMED_DELETED
        if (stamp == 0 and n_key == 0 and n_value == 0) or n_key > TIMED_MAX_KEY or (not gone and n_value > TIMED_MAX_VALUE):
            return
        body = reader.take(n_key + (0 if gone else n_value))
        if body is None:
            return
        yield body[:n_key], None if gone else body[n_key:], gone


def _checked(reader: Reader, header: str) -> Iterator[Entry]:
    head = struct.calcsize(header)
    while (raw := reader.take(head)) is not None:
        crc, n_key, n_value = struct.unpack(header, raw)[:3]
        if not (0 < n_key <= MAX_KEY and CHECKED_DELETED <= n_value <= MAX_VALUE):
            return
        body = reader.take(n_key + max(n_value, 0))
        if body is None or zlib.crc32(body) != crc:
            return
        gone = n_value == CHECKED_DELETED
        yield body[:n_key], None if gone else body[n_key:], gone


def checked_entries(reader: Reader) -> Iterator[Entry]:
    return _checked(reader, CHECKED_HEADER)


def store_header(uri: str) -> tuple[int, int, int, int]:
    """Offsets of log, runs and run list, and the number of runs; an error if the file isn't a store."""
    raw = Reader(uri).take(struct.calcsize(STORE_HEADER) + 4)
    if raw is None:
        raise ValueError(f"{uri} is shorter than a store's header")
    magic, version, log_at, runs_at, list_at, n_runs = struct.unpack(STORE_HEADER, raw[:-4])
    if magic != STORE_MAGIC:
        raise ValueError(f"{uri} is not a single-file store")
    if version != STORE_VERSION:
        raise ValueError(f"{uri} has version {version}; {STORE_VERSION} can be read")
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError(f"{uri} has a damaged header")
    return log_at, runs_at, list_at, n_runs


def store_runs(uri: str) -> Iterator[tuple[int, int, int, int, bytes, bytes, bool]]:
    """Offset, size, entries, CRC-32, smallest key, largest key of each listed run, and whether its bytes are there and have that CRC-32."""
    _, _, list_at, n_runs = store_header(uri)
    reader = Reader(uri, list_at)
    for _ in range(n_runs if list_at else 0):
        raw = reader.take(struct.calcsize(LIST_HEADER))
        if raw is None:
            return
        at, size, entries, crc, n_low, n_high = struct.unpack(LIST_HEADER, raw)
        low, high = reader.take(n_low), reader.take(n_high)
        if low is None or high is None:
            return
        body = Reader(uri, at, at + size)
        yield at, size, entries, crc, low, high, body.left() == size and body.checksum() == crc


def store_entries(uri: str) -> Iterator[Entry]:
    """Entries of the sound runs, the oldest first, and then of the log; damaged runs are left out."""
    log_at, runs_at, _, _ = store_header(uri)
    for at, size, _, _, _, _, sound in store_runs(uri):
        if sound:
            yield from _checked(Reader(uri, at, at + size), RUN_HEADER)
    yield from checked_entries(Reader(uri, log_at, runs_at))


def _checked_or_store(uri: str) -> Iterator[Entry]:
    start = Reader(uri).peek(4)
    if start is not None and struct.unpack("<I", start)[0] == STORE_MAGIC:
        return store_entries(uri)
    return checked_entries(Reader(uri))


def read_timed_log(spark: SparkSession, path: str) -> DataFrame:
    return files.read_logs(files.listed(spark, path), lambda uri: timed_entries(Reader(uri)))


def read_checked_log(spark: SparkSession, path: str) -> DataFrame:
    """Bare checked logs; files that start as a store does are read as stores."""
    return files.read_logs(files.listed(spark, path), _checked_or_store)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Single-file stores; any other file is an error."""
    return files.read_logs(files.listed(spark, path), store_entries)


def read_store_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run lists of single-file stores: path, run, entries, bytes, CRC-32, smallest and largest key, and whether the run is sound."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for n, (_, size, entries, crc, low, high, sound) in enumerate(store_runs(uri)):
                    values = [uri, n, entries, size, crc, low, high, sound]
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "run", "n_entries", "n_bytes", "crc", "min_k", "max_k", "sound"), values, strict=True))])

    kind = "path string, run long, n_entries long, n_bytes long, crc long, min_k binary, max_k binary, sound boolean"
    return files.listed(spark, path).select("path").mapInArrow(run, kind)


def timed_record(stamp: int, key: bytes, value: bytes | None) -> bytes:
    """One record of a timestamped log; no value is a tombstone."""
    return struct.pack(TIMED_HEADER, stamp, len(key), TIMED_DELETED if value is None else len(value)) + key + (value or b"")


def _body(key: bytes, value: bytes | None) -> tuple[int, int, int, bytes]:
    body = key + (value or b"")
    return zlib.crc32(body), len(key), CHECKED_DELETED if value is None else len(value), body


def checked_record(key: bytes, value: bytes | None) -> bytes:
    crc, n_key, n_value, body = _body(key, value)
    return struct.pack(CHECKED_HEADER, crc, n_key, n_value, 0) + body


def run_entry(key: bytes, value: bytes | None) -> bytes:
    crc, n_key, n_value, body = _body(key, value)
    return struct.pack(RUN_HEADER, crc, n_key, n_value) + body


def store_bytes(runs: list[tuple[bytes, int, bytes, bytes]], log: bytes = b"", log_bytes: int = LOG_BYTES) -> Iterator[bytes]:
    """A store file in pieces, from runs (bytes, entries, smallest key, largest key), the oldest first, and the log's records."""
    at = runs_at = STORE_PAGE + log_bytes
    listing = b""
    for body, entries, low, high in runs:
        listing += struct.pack(LIST_HEADER, at, len(body), entries, zlib.crc32(body), len(low), len(high)) + low + high
        at += len(body)
    head = struct.pack(STORE_HEADER, STORE_MAGIC, STORE_VERSION, STORE_PAGE, runs_at, at if runs else 0, len(runs))
    head += struct.pack("<I", zlib.crc32(head))
    yield head + bytes(STORE_PAGE - len(head))
    yield log
    for lo in range(len(log), log_bytes, 1 << 20):
        yield bytes(min(1 << 20, log_bytes - lo))
    for body, *_ in runs:
        yield body
    yield listing


def write_timed_log(log: DataFrame, path: str, shards: int) -> None:
    """Every version of a log as data.log files, a folder a shard, in order of seq; the stamp is seq + 1."""

    def write(folder: str, records: Iterator[Record]) -> None:
        own, place = files.filesystem(f"{folder}/data.log")
        with own.open_output_stream(place) as out:
            for k, seq, v, gone in records:
                out.write(timed_record(seq + 1, k, None if gone else v or b""))

    files.write_shards(log, path, shards, write, ["seq"])


def write_store(log: DataFrame, path: str, shards: int, *, run_bytes: int = RUN_BYTES, log_bytes: int = LOG_BYTES) -> None:
    """The newest rows of a log, tombstones included, as single-file stores, a folder a shard and a file a sorted run."""
    from logtide.operators.log import latest

    def write(folder: str, records: Iterator[Record]) -> None:
        own, place = files.filesystem(folder)
        held: list[tuple[bytes, bytes]] = []
        n_files = size = 0

        def flush() -> None:
            nonlocal held, size, n_files
            run = (b"".join(raw for _, raw in held), len(held), held[0][0], held[-1][0])
            with own.open_output_stream(f"{place}/store-{n_files:06d}.lsm") as out:
                for piece in store_bytes([run], log_bytes=log_bytes):
                    out.write(piece)
            held, size, n_files = [], 0, n_files + 1

        for k, _, v, gone in records:
            raw = run_entry(k, None if gone else v or b"")
            held.append((k, raw))
            size += len(raw)
            if size >= run_bytes:
                flush()
        if held:
            flush()

    files.write_shards(latest(log), path, shards, write, ["k"])
