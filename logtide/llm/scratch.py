"""Intermediate tables in the folder that all executors share.

A table written here replaces the plan that made it, so a later stage neither repeats the
work nor depends on blocks that live on one executor only.
"""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a finished execution's shuffle files when this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch between Spark and Python. Long texts and sketches make the default of 10,000 rows tens of megabytes on either side.
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
#: Spark takes the order of a bucket that is one file as sorted when this is set.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Most buckets that Spark allows by default.
MOST_BUCKETS = 100_000
_own: dict[str, str] = {}
_watching: list[list[str]] = []
_log = logging.getLogger(__name__)


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary folder only where executors share this machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return "file://" + tempfile.mkdtemp(prefix="logtide-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def root(spark: SparkSession) -> str:
    """The shared folder of this application."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"{_base(spark).rstrip('/')}/logtide-{app}"
        atexit.register(_remove_at_exit, spark, _own[app])
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception as failure:  # the application may have ended already
        _log.warning("scratch folder %s was not removed: %s", path, type(failure).__name__)


@contextlib.contextmanager
def watched() -> Iterator[list[str]]:
    """Within this, the paths of all tables that are kept come into a list, so that a caller can remove them later."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.pop()


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str = "true", default: str = "false") -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def short_lived_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within this, Spark removes the shuffle files of an execution as soon as it ends."""
    return _set(spark, _CLEANUP)


def ordered_buckets(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within this, sorted buckets are read as sorted."""
    return _set(spark, _ORDERED)


class Scratch:
    """The intermediate tables of one operator run.

    ``keep`` writes a table and returns it as read back; ``drop`` deletes tables that no
    plan reads any more. What is left goes when the application ends, because the operator's
    lazy result may still read it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self._paths: dict[int, tuple[DataFrame, str]] = {}  # holds the table too, so that no other object gets its id
        self._tables: dict[str, str] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{label}")
        with short_lived_shuffles(self.spark), _set(self.spark, _BATCH, _BATCH_ROWS, "10000"):
            df.write.option("compression", "zstd").parquet(path)
        return self._listed(self.spark.read.schema(df.schema).parquet(path), path)

    def keep_sorted(self, df: DataFrame, label: str, key: str, buckets: int, *, dealt: bool = False) -> DataFrame:
        """A table in ``buckets`` of hashes of ``key``, each one file in order of key, so that tables of as many buckets merge without a shuffle or a sort.

        ``dealt`` says that a task of ``df`` holds one bucket already, as after a merge of such tables.
        """
        path, name = new_path(self.spark, f"{self.name}-{label}"), f"scratch_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(buckets, key)
        with short_lived_shuffles(self.spark), ordered_buckets(self.spark):
            rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        self._tables[path] = name
        return self._listed(self.spark.table(name), path)

    def _listed(self, table: DataFrame, path: str) -> DataFrame:
        self._paths[id(table)] = table, path
        for made in _watching:
            made.append(path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            kept = self._paths.pop(id(table), None)
            if kept:
                if kept[1] in self._tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(kept[1])}")
                remove(self.spark, kept[1])

    def drop_all_but(self, *tables: DataFrame) -> None:
        stays = {id(table) for table in tables}
        self.drop(*(table for table, _ in list(self._paths.values()) if id(table) not in stays))
