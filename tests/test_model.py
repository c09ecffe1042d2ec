"""Random operations against a dict, and what must not depend on how rows are spread."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logtide.functions import hashing, text
from logtide.operators import integrity, log, shards, table, tiers

SCHEMA = "k string, seq long, v string, deleted boolean"


def operations(seed: int, n: int = 1000, n_keys: int = 20):
    rng, model, past, rows = random.Random(seed), {}, {}, []
    for seq in range(n):
        k = f"key-{rng.randrange(n_keys)}"
        if rng.random() < 0.3:
            rows.append((k, seq, None, True))
            model.pop(k, None)
        else:
            v = rng.choice(["", f"value-{seq}", "x" * rng.randrange(50)])
            rows.append((k, seq, v, False))
            model[k] = v
            past.setdefault(k, []).append(v)
    return rows, model, past


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_random_operations(spark, partitions):
    for seed in (1, 2):
        rows, model, past = operations(seed)
        random.Random(seed + 100).shuffle(rows)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        assert {r.k: r.v for r in log.live(frame).collect()} == model
        found: dict[str, list] = {}
        for r in log.history(frame).orderBy("k", "version_no").collect():
            found.setdefault(r.k, []).append(r.v)
        assert found == past
        size = log.size(frame).first()
        assert size.n_keys == len(model) and size.n_bytes == sum(len(k) + len(v) for k, v in model.items())
        asked = spark.createDataFrame([(f"key-{i}",) for i in range(25)], "k string")
        assert {r.k: r.present for r in log.exists(frame, asked).collect()} == {f"key-{i}": f"key-{i}" in model for i in range(25)}


def test_empty_value_delete_and_put_again(spark):
    frame = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "", False), ("b", 1, "y", False), ("b", 2, None, True), ("c", 1, None, True), ("c", 2, "z", False)], SCHEMA)
    assert {r.k: r.v for r in log.live(frame).collect()} == {"a": "", "c": "z"}
    gone = log.delete(frame, spark.createDataFrame([("a",), ("unknown",)], "k string"))
    assert {r.k for r in log.live(gone).collect()} == {"c"}
    back = log.put(gone, spark.createDataFrame([("a", "again")], "k string, v string"))
    assert {r.k: r.v for r in log.live(back).collect()} == {"a": "again", "c": "z"}
    assert log.live(log.as_of(frame, 1).withColumn("deleted", F.lit(False))).count() == 2


def test_prefixes(spark):
    pairs = ["user:1:name", "user:1:email", "user:2:name", "user:2:email", "product:1:name", "product:1:price", "config:setting", "other:key", "us%r:1", "us_r:1"]
    frame = spark.createDataFrame([(k, i, "v", False) for i, k in enumerate(pairs)], SCHEMA)
    for prefix, n in {"user:": 4, "user:1:": 2, "product:": 2, "config:": 1, "nonexistent:": 0, "us%": 1, "us_": 1, "": 10}.items():
        assert log.prefix_scan(frame, prefix).count() == n
    raw = spark.createDataFrame([(bytes([0xFF, 0xFF, 1]), 1, "a", False), (b"\xff\xfe", 2, "b", False), (b"", 3, "c", False)], "k binary, seq long, v string, deleted boolean")
    assert log.prefix_scan(raw, b"\xff\xff").count() == 1
    assert log.prefix_scan(raw, b"\xff").count() == 2
    assert log.prefix_scan(raw, b"").count() == 3


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(b"abc", "abc")], "k binary, s string").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = stored.where(log.prefix_filter("k", b"ab"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k" in plan and "LessThan(k" in plan
    assert "StringStartsWith(s,ab)" in stored.where(log.prefix_filter("s", "ab"))._jdf.queryExecution().toString()


def test_routing(spark, tmp_path):
    frame = spark.createDataFrame([(f"key-{i}", i, "v", False) for i in range(500)], SCHEMA)
    sharded = shards.with_shard(frame, 16)
    assert all(r.shard == shards.shard_number(r.k, 16) for r in sharded.collect())
    sharded.write.partitionBy("shard").parquet(str(tmp_path / "s"))
    found = shards.point_lookup(spark.read.parquet(str(tmp_path / "s")), "key-7", 16)
    assert found.count() == 1 and "PartitionFilters: [isnotnull(shard" in found._jdf.queryExecution().toString()
    sized = frame.select("k", F.lit(10).cast("long").alias("bytes"))
    nodes = shards.split_rows(sized, 300).groupBy("node").agg(F.sum("bytes").alias("b"))
    assert nodes.where("b > 300").count() == 0 and nodes.agg(F.sum("b")).first()[0] == 5000


def test_tiers_and_generations(spark, tmp_path):
    upper = spark.createDataFrame([("a", 9, None, True), ("b", 8, "new", False)], SCHEMA)
    lower = spark.createDataFrame([("a", 1, "old", False), ("b", 2, "old", False), ("c", 3, "kept", False)], SCHEMA)
    merged = tiers.merge_down(upper, lower)
    assert {(r.k, r.v, r.deleted) for r in merged.collect()} == {("a", None, True), ("b", "new", False), ("c", "kept", False)}
    base = str(tmp_path / "g")
    lower.unionByName(upper).write.parquet(f"{base}/data-0")
    spark.createDataFrame([(0, 4)], "generation int, n int").write.parquet(f"{base}/generations")
    assert tiers.compact_generation(spark, base, 4) == 1
    assert {r.k for r in spark.read.parquet(f"{base}/data-1").collect()} == {"b", "c"}


def test_table_and_text(spark):
    rows = spark.createDataFrame([(i, f"n{i % 3}") for i in range(1, 8)], "row_no long, name string")
    left = {(r.row_no, r.name) for r in table.delete_row(rows, 2).collect()}
    assert left == {(1, "n1"), (2, "n1"), (3, "n0"), (4, "n1"), (5, "n2"), (6, "n0")}
    assert {r.row_no for r in table.delete_row(rows, 7).collect()} == {1, 2, 3, 4, 5, 6}
    assert [r.row_no for r in table.weed(rows, ["name"]).orderBy("row_no").collect()] == [1, 2, 3]
    near = table.search_nearest(rows, "row_no", 3.5).first()
    assert (near.at_or_below, near.above) == (3, 4)
    words = spark.createDataFrame([("Inserting",), ("nodes",), ("into",), ("tree",), ("In",), (None,), ("",)], "w string")
    trie = {r.prefix: (r.n_words, r.is_word) for r in text.trie(words, "w").collect()}
    assert trie["In"] == (2, True) and trie["tre"] == (1, False) and "tref" not in trie
    one = spark.createDataFrame([("/a//b\\c/", "abcd", "xyz", "")], "p string, h string, b string, e string")
    r = one.select(text.path_tokens(F.col("p")).alias("t"), text.is_hex(F.col("h")).alias("h"), text.is_hex(F.col("b")).alias("b"), text.is_printable(F.col("e")).alias("e")).first()
    assert (r.t, r.h, r.b, r.e) == (["a", "b", "c"], True, False, False)


def test_integrity(spark):
    rows = spark.createDataFrame([(i, i in (5, 7)) for i in range(10)], "seq long, bad boolean")
    assert {r.seq for r in integrity.valid_prefix(rows).collect()} == {0, 1, 2, 3, 4}
    assert integrity.valid_prefix(rows.where("NOT bad")).count() == 8
    data = spark.createDataFrame([(bytearray((5).to_bytes(8, "big") + (-9).to_bytes(8, "big", signed=True)),)], "d binary")
    assert [data.select(hashing.big_endian_long(F.col("d"), i)).first()[0] for i in (0, 1)] == [5, -9]
