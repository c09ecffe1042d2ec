"""Stores that are written to: sorted runs in tiers, and hash shards in generations, as Parquet below one folder.

Nothing is changed in place. A change writes new files and then one new manifest (or listing) that names what counts, so a
reader of an older manifest keeps its snapshot, and a change that fails leaves files that nothing names; ``vacuum`` removes them.
One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators import log, shards, tiers
from logtide.operators.log import LOG_COLUMNS

_RUNS = "tier int, run string, n_bytes long, last_seq long"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _path(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


class TieredStore:
    """A line of tiers: changes are runs of tier 0; a tier above its byte limit is merged into the next, tombstones included.

    ``schema`` gives the types of k and v. The last tier has no limit.
    """

    def __init__(self, spark: SparkSession, base: str, key: str = "string", value: str = "string", limits: tuple[int, ...] = tiers.TIER_LIMITS) -> None:
        self.spark, self.base, self.limits = spark, base.rstrip("/"), limits
        self.schema = T.StructType.fromDDL(f"k {key}, seq long, v {value}, deleted boolean")

    # Manifests

    def versions(self) -> list[int]:
        """The snapshots that can be read, oldest first."""
        return sorted(int(n.split("=")[1]) for n in _names(self.spark, f"{self.base}/manifests"))

    def _runs(self, version: int | None = None) -> list[tuple[int, str, int, int]]:
        known = self.versions()
        if not known:
            return []
        rows = self.spark.read.schema(_RUNS).parquet(f"{self.base}/manifests/version={known[-1] if version is None else version}")
        return [tuple(r) for r in rows.collect()]  # a row a run

    def _commit(self, runs: list[tuple[int, str, int, int]]) -> None:
        number = (self.versions() or [-1])[-1] + 1
        self.spark.createDataFrame(runs, _RUNS).coalesce(1).write.parquet(f"{self.base}/manifests/version={number}")

    def _write(self, rows: DataFrame, tier: int) -> tuple[int, str, int, int]:
        name = uuid.uuid4().hex
        tiers.write_run(rows.select(*LOG_COLUMNS), f"{self.base}/runs/{name}")
        size = F.octet_length(F.col("k").cast("string")) + F.coalesce(F.octet_length(F.col("v").cast("string")), F.lit(0))
        stored = self.spark.read.schema(self.schema).parquet(f"{self.base}/runs/{name}")
        n_bytes, last = stored.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
        return tier, name, n_bytes, last

    # Changes

    def _append(self, rows: DataFrame) -> None:
        runs = self._runs()
        last = max((r[3] for r in runs), default=0)
        self._commit([*runs, self._write(rows.withColumn("seq", F.lit(last + 1).cast("long")), 0)])
        tier = 0
        while tier < len(self.limits) - 1 and sum(r[2] for r in self._runs() if r[0] == tier) > self.limits[tier]:
            self.flush(tier)
            tier += 1

    def put(self, pairs: DataFrame) -> None:
        """Put (k, v), whose keys are distinct, as one version."""
        self._append(pairs.select("k", "v", F.lit(False).alias("deleted")))

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select("k", F.lit(None).cast(self.schema["v"].dataType).alias("v"), F.lit(True).alias("deleted")).distinct())

    def flush(self, tier: int) -> None:
        """Merge all of a tier into the next; keys of the last tier lose their tombstones."""
        runs = self._runs()
        upper, lower = (self._read([r for r in runs if r[0] == t]) for t in (tier, tier + 1))
        merged = tiers.merge_down(upper, tiers.resolve_tiers(lower.withColumn("tier", F.lit(0))))
        if not any(r[0] > tier + 1 for r in runs):
            merged = merged.where("NOT deleted")
        self._commit([r for r in runs if r[0] not in (tier, tier + 1)] + [self._write(merged, tier + 1)])

    def vacuum(self, keep: int = 1) -> None:
        """Forget all snapshots but the newest ``keep``, and remove runs that none of these names."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {r[1] for version in kept for r in self._runs(version)}
        for version in old:
            _remove(self.spark, f"{self.base}/manifests/version={version}")
        for name in _names(self.spark, f"{self.base}/runs"):
            if name not in named:
                _remove(self.spark, f"{self.base}/runs/{name}")

    # Reading

    def _read(self, runs: list[tuple[int, str, int, int]]) -> DataFrame:
        paths = [f"{self.base}/runs/{r[1]}" for r in runs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def log(self, version: int | None = None) -> DataFrame:
        """Rows of all runs with their tier."""
        runs, found = self._runs(version), None
        for tier in sorted({r[0] for r in runs}):
            rows = self._read([r for r in runs if r[0] == tier]).withColumn("tier", F.lit(tier))
            found = rows if found is None else found.unionByName(rows)
        return self._read([]).withColumn("tier", F.lit(0)) if found is None else found

    def scan(self, version: int | None = None) -> DataFrame:
        """Live (k, v), the newest tier first."""
        return tiers.resolve_tiers(self.log(version)).where("NOT deleted").select("k", "v")

    def get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """A row for each key: its live value, or null and found = false. Newer tiers hold larger versions, so the log's look-up applies."""
        return log.get(self.log(version).drop("tier"), keys)

    def sizes(self) -> DataFrame:
        """Bytes of each tier against its limit."""
        return tiers.flush_plan(self.spark.createDataFrame(self._runs(), _RUNS).withColumnRenamed("n_bytes", "bytes"), self.limits)


class ShardedStore:
    """Hash shards in generations: ``data-<generation>/shard=<n>``, and a listing of the generations that count."""

    def __init__(self, spark: SparkSession, base: str, n: int = 16, key: str = "string", value: str = "string") -> None:
        """Open the store at ``base``, or create one of n shards; an existing store keeps its own number."""
        self.spark, self.base = spark, base.rstrip("/")
        self.schema = T.StructType.fromDDL(f"k {key}, seq long, v {value}, deleted boolean")
        if _names(spark, f"{self.base}/generations"):
            listed = spark.read.parquet(f"{self.base}/generations")
            self.generation, self.n = listed.agg(F.max("generation"), F.max_by("n", "generation")).first()
        else:
            self.generation, self.n = 0, n
            spark.range(1).select(F.lit(0).alias("generation"), F.lit(n).alias("n")).write.parquet(f"{self.base}/generations")
        self.vacuum()

    def _data(self) -> str:
        return f"{self.base}/data-{self.generation}"

    def vacuum(self) -> None:
        """Remove what an interrupted or a finished compaction left: every generation but the listed newest."""
        for name in _names(self.spark, self.base):
            if name.startswith("data-") and name != f"data-{self.generation}":
                _remove(self.spark, f"{self.base}/{name}")

    def log(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("shard", T.IntegerType())])
        if not _names(self.spark, self._data()):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._data())

    def _append(self, rows: DataFrame) -> None:
        last = self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        numbered = rows.withColumn("seq", F.lit(last + 1).cast("long")).select(*LOG_COLUMNS)
        shards.with_shard(numbered, self.n).repartition("shard").write.mode("append").partitionBy("shard").parquet(self._data())

    def put(self, pairs: DataFrame) -> None:
        """Put (k, v), whose keys are distinct, as one version."""
        self._append(pairs.select("k", "v", F.lit(False).alias("deleted")))

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select("k", F.lit(None).cast(self.schema["v"].dataType).alias("v"), F.lit(True).alias("deleted")).distinct())

    def scan(self) -> DataFrame:
        return log.live(self.log()).select("k", "v")

    def get(self, keys: DataFrame) -> DataFrame:
        return log.get(self.log().drop("shard"), keys)

    def lookup(self, key: str) -> DataFrame:
        """The live pair of one key, from its shard's folder alone."""
        return log.live(shards.point_lookup(self.log(), key, self.n)).select("k", "v")

    def sizes(self) -> DataFrame:
        """Live keys and bytes of each shard, and in total (shard null)."""
        sized = log.live(self.log()).withColumn("bytes", F.octet_length(F.col("k").cast("string")) + F.coalesce(F.octet_length(F.col("v").cast("string")), F.lit(0)))
        return shards.shard_stats(sized)

    def compact(self) -> None:
        """A new generation without history and tombstones; readers of the old one are done before it goes."""
        if _names(self.spark, self._data()):
            self.generation = tiers.compact_generation(self.spark, self.base, self.n)
            self.vacuum()
