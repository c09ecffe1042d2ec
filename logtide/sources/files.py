"""Store files read by ranges and written as streams, through pyarrow's file systems.

A file may be of any size: a reader holds one buffer and one batch of rows. Sinks write below a
folder of their own attempt; the driver moves what the job's result lists to its place, so a task that
runs again leaves nothing behind but files that are removed.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.operators.log import LOG_COLUMNS

LOG_TYPE = "k binary, seq long, v binary, deleted boolean"
#: A record's number within its file lies below this; file numbers lie above.
FILE_RECORDS = 1 << 40
_BUFFER, _BATCH_BYTES, _BATCH_ROWS = 4 << 20, 16 << 20, 10_000
#: Largest binary value of a row.
_LARGEST = (1 << 31) - 64
Record = tuple[bytes, int, bytes | None, bool]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a local path."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Reader:
    """A file from ``start`` to ``end``, read through one buffer; ``at`` may be set to any place."""

    def __init__(self, uri: str, start: int = 0, end: int | None = None) -> None:
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.at, self.end = start, size if end is None else min(end, size)
        self._buffer, self._base = b"", start

    def left(self) -> int:
        return self.end - self.at

    def peek(self, n: int) -> bytes | None:
        """The next n bytes, or None where there are fewer."""
        if n > self.left():
            return None
        lo = self.at - self._base
        if lo < 0 or lo + n > len(self._buffer):
            self._buffer = self.file.read_at(min(max(n, _BUFFER), self.left()), self.at)
            self._base, lo = self.at, 0
        return self._buffer[lo : lo + n]

    def take(self, n: int) -> bytes | None:
        found = self.peek(n)
        if found is not None:
            self.at += n
        return found

    def skip(self, n: int) -> None:
        self.at += n

    def checksum(self) -> int:
        """CRC-32 of the rest."""
        crc = 0
        while self.left():
            crc = zlib.crc32(self.take(min(_BUFFER, self.left())), crc)
        return crc


def batched(records: Iterable[Record]) -> Iterator[pa.RecordBatch]:
    """Log rows in batches of bounded size."""
    columns: tuple[list, ...] = ([], [], [], [])
    held = 0

    def made() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], LOG_COLUMNS)

    for record in records:
        size = len(record[0]) + len(record[2] or b"")
        if size > _LARGEST:
            raise ValueError(f"a record of {size} bytes is too large for a row")
        if columns[0] and (held + size > _BATCH_BYTES or len(columns[0]) >= _BATCH_ROWS):
            yield made()
            columns, held = ([], [], [], []), 0
        for column, value in zip(columns, record, strict=True):
            column.append(value)
        held += size
    if columns[0]:
        yield made()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_no) of the files at a path or pattern, numbered in order of path. Contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.withColumn("file_no", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))  # a row a file


def read_logs(files: DataFrame, parse: Callable[[str], Iterator[tuple[bytes, bytes | None, bool]]]) -> DataFrame:
    """The log of files that one parser reads from the front, one file a task; seq grows with the file's number and the record's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from batched((k, number * FILE_RECORDS + n, v, gone) for n, (k, v, gone) in enumerate(parse(path)))

    return files.select("path", "file_no").repartition("file_no").mapInArrow(run, LOG_TYPE)


# Sinks

Writer = Callable[[str, Iterator[Record]], None]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, int, bytes | None, bool]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)


def write_shards(log: DataFrame, path: str, shards: int, write: Writer, order: list[str]) -> None:
    """Write each shard of a log into a folder of its number below ``path``, which must not exist, by ``write(folder, records)``.

    A shard is one task's sorted stream. Moving the files to their place is the last step.
    """
    from logtide.operators.shards import with_shard

    spark = log.sparkSession
    own, place = filesystem(path)
    if own.get_file_info(place).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    attempts = f"{place}-{uuid.uuid4().hex}"
    uri = f"{path.rstrip('/')}{attempts[len(place) :]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _records(batches)
        first = next(rows, None)
        while first is not None:
            shard, following = first[0], None
            name = f"{shard}-{uuid.uuid4().hex}"

            def of_shard(head=first, number=shard) -> Iterator[Record]:
                nonlocal following
                yield head[1:]
                for row in rows:
                    if row[0] != number:
                        following = row
                        return
                    yield row[1:]

            files, folder = filesystem(f"{uri}/{name}")
            files.create_dir(folder, recursive=True)
            write(f"{uri}/{name}", of_shard())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name])], ["shard", "name"])
            first = following

    columns = [F.col("k").cast("binary").alias("k"), F.col("seq").cast("long").alias("seq"), F.col("v").cast("binary").alias("v"), "deleted"]
    rows = with_shard(log, shards).select("shard", *columns).repartitionById(shards, "shard").sortWithinPartitions("shard", *order)
    written = rows.mapInArrow(run, "shard int, name string").collect()  # a row a shard
    own.create_dir(place, recursive=True)
    for shard, name in written:  # file by file, as object stores have no folders to move
        own.create_dir(f"{place}/{shard}", recursive=True)
        for found in own.get_file_info(pafs.FileSelector(f"{attempts}/{name}")):
            own.move(found.path, f"{place}/{shard}/{found.base_name}")
    if own.get_file_info(attempts).type != pafs.FileType.NotFound:
        own.delete_dir(attempts)


_folders: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return "file://" + tempfile.mkdtemp(prefix="logtide-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _remove_at_exit(uri: str) -> None:
    own, place = filesystem(uri)
    if own.get_file_info(place).type == pafs.FileType.Directory:
        own.delete_dir(place)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, removed at exit; in a local session without one, in the system's temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{_base(spark).rstrip('/')}/stores-{app}"
        atexit.register(_remove_at_exit, _folders[app])
    return f"{_folders[app]}/{label}-{uuid.uuid4().hex}"
