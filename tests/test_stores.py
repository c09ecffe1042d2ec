"""Store files laid out byte by byte, damaged, sharded, large and written by the sinks; the command line; rows in blocks."""

from __future__ import annotations

import json
import random
import sqlite3
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logtide import cli
from logtide.functions import hashing, lists, text
from logtide.operators import blocks, callbacks, integrity, log, shards, stores, table, tiers
from logtide.plans import catalogue, workload
from logtide.sources import backends, extents, files, formats, logfiles, rowtables
from logtide.streaming import latest as streaming
from tests.oracle import check

SCHEMA = "k binary, seq long, v binary, deleted boolean"


def pairs(frame):
    return {bytes(r.k): bytes(r.v) for r in log.live(frame).collect()}


def crc(body):
    return zlib.crc32(body)


def run_bytes(entries):
    out = b""
    for k, v in entries:
        out += struct.pack("<Qqq", crc(k + (v or b"")), len(k), -1 if v is None else len(v)) + k + (v or b"")
    return out


def wal_bytes(entries):
    return b"".join(struct.pack("<QqqI", crc(k + (v or b"")), len(k), -1 if v is None else len(v), 0) + k + (v or b"") for k, v in entries)


def store_file(path, runs, log_entries, log_room=4096, gap=0, damage=None):
    """Header page, log region, runs and run list, as a store writes them; ``gap`` leaves a hole before the runs."""
    runs_at = 4096 + log_room + gap
    bodies = [run_bytes(r) for r in runs]
    list_at, listing, at = runs_at + sum(map(len, bodies)), b"", runs_at
    for r, body in zip(runs, bodies, strict=True):
        low, high = r[0][0], r[-1][0]
        listing += struct.pack("<QQIIII", at, len(body), len(r), crc(body), len(low), len(high)) + low + high
        at += len(body)
    head = struct.pack("<IIQQQI", 0x4C534D46, 1, 4096, runs_at, list_at if runs else 0, len(runs))
    head += struct.pack("<I", crc(head))
    with open(path, "wb") as f:
        f.write(head + bytes(4096 - len(head)))
        f.write(wal_bytes(log_entries))
        at = runs_at
        for i, body in enumerate(bodies):
            f.seek(at)
            f.write(body if damage != i else body[:-1] + bytes([body[-1] ^ 1]))
            at += len(body)
        f.seek(list_at)
        f.write(listing)


RUNS = [[(b"a", b"1"), (b"b", b"old"), (b"c", b"")], [(b"b", None), (b"d", b"4")]]
LOG = [(b"e", b"5"), (b"d", None), (b"c", b"new")]


def test_single_file_store(spark, tmp_path):
    store_file(tmp_path / "s", RUNS, LOG)
    read = lambda: backends.open_log(spark, "store", str(tmp_path / "s"))
    assert pairs(read()) == {b"a": b"1", b"c": b"new", b"e": b"5"}
    assert pairs(backends.open_log(spark, "checked", str(tmp_path / "s"))) == pairs(read())
    listed = logfiles.read_store_runs(spark, str(tmp_path / "s")).orderBy("run").collect()
    assert [(r.n_entries, bytes(r.min_k), bytes(r.max_k), r.sound) for r in listed] == [(3, b"a", b"c", True), (2, b"b", b"d", True)]
    store_file(tmp_path / "s", RUNS, [])
    assert pairs(read()) == {b"a": b"1", b"c": b"", b"d": b"4"}
    store_file(tmp_path / "s", RUNS, LOG, damage=1)  # a damaged run is left out whole
    assert pairs(read()) == {b"a": b"1", b"b": b"old", b"c": b"new", b"e": b"5"}
    store_file(tmp_path / "s", [], [])
    assert pairs(read()) == {}


def test_single_file_store_refuses_other_files(spark, tmp_path):
    store_file(tmp_path / "s", RUNS, LOG)
    whole = (tmp_path / "s").read_bytes()
    for at, message in ((0, "not a single-file store"), (4, "version"), (9, "damaged header")):
        (tmp_path / "s").write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(Exception, match=message):
            backends.open_log(spark, "store", str(tmp_path / "s")).collect()
    (tmp_path / "s").write_bytes(b"short")
    with pytest.raises(Exception, match="shorter"):
        backends.open_log(spark, "store", str(tmp_path / "s")).collect()
    (tmp_path / "s").write_bytes(whole[:4096] + wal_bytes(LOG)[:-3])  # a torn log and no runs
    assert pairs(backends.open_log(spark, "store", str(tmp_path / "s"))) == {b"e": b"5"}


def test_files_above_two_gigabytes(spark, tmp_path):
    store_file(tmp_path / "s", RUNS, LOG, gap=5 << 30)
    assert (tmp_path / "s").stat().st_size > 5 << 30
    assert pairs(backends.open_log(spark, "store", str(tmp_path / "s"))) == {b"a": b"1", b"c": b"new", b"e": b"5"}


def test_timed_log_limits(spark, tmp_path):
    good = struct.pack("<qII", 7, 1, 1) + b"ab"
    for bad in (struct.pack("<qII", 8, 40_000, 1) + bytes(40_001), struct.pack("<qII", 8, 1, 1073741823) + b"xy", struct.pack("<qII", 8, 4, 90) + b"torn"):
        (tmp_path / "log").write_bytes(good + bad + good.replace(b"a", b"z"))
        assert pairs(backends.open_log(spark, "timed", str(tmp_path / "log"))) == {b"a": b"b"}
    longest = struct.pack("<qII", 9, 32768, 0xFFFFFFFF) + b"k" * 32768
    (tmp_path / "log").write_bytes(longest + good)
    assert [r.deleted for r in backends.open_log(spark, "timed", str(tmp_path / "log")).orderBy("seq").collect()] == [True, False]
    zero_key = struct.pack("<qII", 0, 0, 3) + b"abc"  # only a header of zeros ends the log
    (tmp_path / "log").write_bytes(zero_key + good + bytes(100))
    assert pairs(backends.open_log(spark, "timed", str(tmp_path / "log"))) == {b"": b"abc", b"a": b"b"}


def operations(seed, n=400):
    rng, model, rows = random.Random(seed), {}, []
    for seq in range(1, n):
        k = f"key-{rng.randrange(60)}".encode()
        if rng.random() < 0.3:
            rows.append((k, seq, None, True))
            model.pop(k, None)
        else:
            v = rng.choice([b"", f"value-{seq}".encode(), bytes(rng.randrange(256) for _ in range(rng.randrange(90)))])
            rows.append((k, seq, v, False))
            model[k] = v
    return rows, model


@pytest.mark.parametrize("kind", ["extent", "timed", "store"])
def test_sinks_and_readers(spark, tmp_path, kind):
    rows, model = operations(3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    write = {"extent": formats.write_extent, "timed": formats.write_timed_log, "store": lambda *a: formats.write_store(*a, run_bytes=300, log_bytes=1000)}[kind]
    write(frame, str(tmp_path / "s"), 4)
    assert sorted(p.name for p in tmp_path.glob("*")) == ["s"] and len(list((tmp_path / "s").glob("*"))) == 4
    back = backends.sharded(kind)(spark, str(tmp_path / "s"))
    assert pairs(back) == model
    if kind != "store":  # stores keep the newest rows only
        expected = {}
        for k, _, v, gone in rows:
            if not gone:
                expected.setdefault(k, []).append(v)
        found = {}
        for r in log.history(back).orderBy("k", "version_no").collect():
            found.setdefault(bytes(r.k), []).append(bytes(r.v))
        assert found == expected
    for shard in (0, 3):
        own = backends.open_log(spark, kind, str(tmp_path / "s" / str(shard)))
        assert all(shards.shard_number(bytes(r.k), 4) == shard for r in own.collect())
    with pytest.raises(FileExistsError):
        write(frame, str(tmp_path / "s"), 4)


def test_extent_of_empty_values(spark, tmp_path):
    formats.write_extent(spark.createDataFrame([(b"a", 1, b"", False), (b"b", 2, b"", False), (b"a", 3, None, True)], SCHEMA), str(tmp_path / "s"), 1)
    assert pairs(backends.open_log(spark, "extent", str(tmp_path / "s" / "0"))) == {b"b": b""}


def test_extent_ranges_and_recovery(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extents, "RANGE_ENTRIES", 7)
    rows, model = operations(4, 100)
    formats.write_extent(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "s"), 1)
    folder = tmp_path / "s" / "0"
    assert pairs(backends.open_log(spark, "extent", str(folder))) == model
    index = (folder / "keys.index").read_bytes()
    (folder / "keys.index").write_bytes(index + bytes(8))  # zeros written by a crash
    assert pairs(backends.open_log(spark, "extent", str(folder))) == model
    (folder / "values.dat").write_bytes((folder / "values.dat").read_bytes()[:-1])
    cut = backends.open_log(spark, "extent", str(folder))
    assert cut.count() < len(rows) + 1 and set(pairs(cut)) <= {k for k, *_ in rows}
    (tmp_path / "e").mkdir()
    for name in ("keys", "values"):
        (tmp_path / "e" / f"{name}.index").write_bytes(bytes(8))
        (tmp_path / "e" / f"{name}.dat").write_bytes(b"")
    assert backends.open_log(spark, "extent", str(tmp_path / "e")).count() == 0


def test_objects(spark, tmp_path):
    frame = spark.createDataFrame([(b"user/1", b"x"), (b"user/2", b""), (b"root", b"y")], "k binary, v binary")
    assert formats.write_objects(frame, str(tmp_path / "o")) == 3
    assert formats.write_objects(frame.where("v = X'78'").withColumn("v", F.lit(b"z")), str(tmp_path / "o")) == 1
    assert {r.k: bytes(r.v) for r in formats.read_objects(spark, str(tmp_path / "o")).collect()} == {"user/1": b"z", "user/2": b"", "root": b"y"}
    with pytest.raises(Exception, match="no object name"):
        formats.write_objects(spark.createDataFrame([(b"../up", b"x")], "k binary, v binary"), str(tmp_path / "o"))


_LONG = "https://example.org/" + "ä/" * 3000


@pytest.mark.parametrize(
    "rows",
    [
        [("https://a.org/1", "one"), ("https://a.org/1", "two"), ("https://a.org/1", "two"), ("ü?#=/+_-", "<p>\0\r\n</p>")],
        [("https://a.org/1", None), ("https://a.org/1", ""), (None, "x"), (None, None), ("", ""), ("", "y")],
        [(_LONG, "z"), (_LONG, "z"), (_LONG[:250], " ")],
        [],
    ],
    ids=["shared", "nulls", "long", "none"],
)
def test_pages_as_objects(spark, tmp_path, rows):
    """Every page comes back, whatever its address and text."""
    url, html = (pa.array([row[i] for row in rows], pa.string()) for i in (0, 1))
    pq.write_table(pa.table({"page_id": pa.array([1] * len(rows), pa.int64()), "url": url, "html": html}), tmp_path / "pages.parquet")
    check(spark, catalogue.QUERIES["object_store_roundtrip"], catalogue.ORACLES["object_store_roundtrip"], str(tmp_path))


def test_sql_store(spark, tmp_path):
    path = str(tmp_path / "db")

    def connect():
        return sqlite3.connect(path, timeout=60)

    first = spark.createDataFrame([(f"k{i}".encode(), f"v{i}".encode()) for i in range(500)], "k binary, v binary").repartition(4)
    assert formats.write_sql(first, connect, stamp=1, batch=100) == 500
    assert formats.write_sql(first.limit(50).withColumn("v", F.lit(b"new")), connect, stamp=2) == 50
    rows = formats.read_sql(spark, connect, 5).collect()
    assert len({r.k for r in rows}) == len(rows) == 500 and sum(r.updated_at == 2 and bytes(r.v) == b"new" for r in rows) == 50
    assert formats.write_sql(first.limit(0), connect) == 0


def test_metadata(spark, tmp_path):
    formats.write_metadata(spark, str(tmp_path / "metadata.json"), 2, 16, 99)
    assert tuple(formats.read_metadata(spark, str(tmp_path / "metadata.json")).first()) == (2, 16, 99)
    body = {"tiers": [{"level": 0, "store_ids": ["a", "b"], "total_size": 70}, {"level": 1, "store_ids": [], "total_size": 5}], "max_tier_sizes": [64, 256], "last_flush": "2024-05-06T07:08:09.123456789Z"}
    (tmp_path / "tiers.json").write_text(json.dumps(body))
    rows = formats.read_tier_metadata(spark, str(tmp_path / "tiers.json")).orderBy("level").collect()
    assert [(r.level, r.store_ids, r.total_size, r.max_size, r.over) for r in rows] == [(0, ["a", "b"], 70, 64, True), (1, [], 5, 256, False)]
    assert rows[0].last_flush.year == 2024
    formats.write_tier_metadata(spark, str(tmp_path / "t2.json"), [(0, ["a", "b"], 70), (1, [], 5)], [64, 256], "2024-05-06T07:08:09Z")
    assert [tuple(r)[:4] for r in formats.read_tier_metadata(spark, str(tmp_path / "t2.json")).orderBy("level").collect()] == [tuple(r)[:4] for r in rows]


def test_row_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rowtables, "RANGE_ROWS", 3)
    names = ["one", "two", "", None, "x" * 500, "two", "größe"]
    rows = spark.createDataFrame([(i + 1, n, i * 7 - 3, i / 2) for i, n in enumerate(names)], "row_no long, name string, size long, weight double")
    offsets, bank = rowtables.banked(rows, "name")
    fields = [("name", "<i8"), ("size", "<i4"), ("weight", "<f8")]
    assert rowtables.write_rows(offsets, str(tmp_path / "t.table"), fields) == 7
    rowtables.write_bank(bank, str(tmp_path / "t.strings"))
    back = rowtables.read_rows(spark, str(tmp_path / "t.table"), fields, str(tmp_path / "t.strings"), ("name",))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with open(tmp_path / "t.table", "ab") as f:
        f.write(b"torn")
    assert rowtables.read_rows(spark, str(tmp_path / "t.table"), fields).count() == 7
    guards = spark.createDataFrame([(5, ~5), (6, 6), (7, None)], "front long, rear long")
    assert {r.front for r in integrity.guard_violations(guards, "front", "rear").collect()} == {6, 7}


def test_command_line(spark, tmp_path):
    store, said = str(tmp_path / "kv"), []
    run = lambda *words: cli.run(["--store", store, *words], spark, said.append)
    assert run("put", "a", "--value", "first") == run("put", "b", "--value", "x" * 150) == run("put", "a", "--value", "second") == 0
    (tmp_path / "raw").write_bytes(bytes(range(50)))
    assert run("put", "c", "--value-file", str(tmp_path / "raw")) == run("delete", "b") == run("delete", "unknown") == 0
    assert run("get", "a") == 0 and said.pop() == "second"
    assert run("get", "b") == run("get", "unknown") == 1
    said.clear()
    assert run("history", "a", "--output", str(tmp_path / "out")) == 0
    lines = [f"{i}\t{len(v)} bytes\t{v.hex()}\n{i}\ttext\t{v.decode()}" for i, v in ((1, b"first"), (2, b"second"))]
    assert "\n".join(said) == "\n".join(["2 values of 61", *lines, f"2 values written below {tmp_path / 'out'}"])
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*")} == {f"61value{i}.{e}": v for i, v in ((1, b"first"), (2, b"second")) for e in ("bin", "txt")}
    said.clear()
    run("history", "c")
    assert said[1:] == [f"1\t50 bytes\t{bytes(range(40)).hex()} ..."]
    said.clear()
    run("keys")
    run("--hex", "keys", "--prefix", "a")
    run("dump")
    run("info")
    assert said[:3] == ["a", "c", "61"] and said[3] == "a\tsecond" and said[-3:] == ["live keys\t2", f"bytes of live pairs\t{2 + 6 + 50}", "puts less deletes\t2"]
    assert run("export", str(tmp_path / "all")) == 0 and len(list((tmp_path / "all").glob("*.bin"))) == 4
    formats.write_extent(spark.read.schema(SCHEMA).parquet(store), str(tmp_path / "e"), 2)
    said.clear()
    assert cli.run(["--store", str(tmp_path / "e"), "--kind", "extent", "--sharded", "get", "a"], spark, said.append) == 0 and said == ["second"]
    assert cli.run(["--store", str(tmp_path / "e"), "--kind", "extent", "put", "a", "--value", "x"], spark, said.append) == 1


# Operators


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_rows_in_blocks(spark, width):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i * 3 - 40, rng.randrange(9)) for i in range(60)]
    frame = spark.createDataFrame(rows, "g string, i long, n long").repartition(4)
    sums = {(r.g, r.i): r.s for r in blocks.running_sum(frame, "n", "i", "s", ["g"], width).collect()}
    following = {(r.g, r.i): r.x for r in blocks.next_value(frame, "n", "i", "x", ["g"], width).collect()}
    for g, i, _ in rows:
        assert sums[g, i] == sum(n for h, j, n in rows if h == g and j < i)
        assert following[g, i] == next((n for h, j, n in rows if h == g and j > i), None)
    total = blocks.running_sum(frame, "n", "i", "s", width=width)
    assert total.columns == ["g", "i", "n", "s"] and {r.i: r.s for r in total.collect()} == {i: sum(n for _, j, n in rows if j < i) for _, i, _ in rows}


@pytest.mark.parametrize("broadcast_keys", [0, 1_000_000])
def test_look_ups_filter_the_log_first(spark, tmp_path, broadcast_keys):
    rows, model = operations(6)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    keys = spark.createDataFrame([(f"key-{i}".encode(),) for i in (1, 1, 5, 99)], "k binary")
    asked = {b"key-1", b"key-5", b"key-99"}
    found = log.get(stored, keys, broadcast_keys=broadcast_keys)
    assert {bytes(r.k): (r.found, None if r.v is None else bytes(r.v)) for r in found.collect()} == {k: (k in model, model.get(k)) for k in asked}
    assert {bytes(r.k): r.present for r in log.exists(stored, keys, broadcast_keys=broadcast_keys).collect()} == {k: k in model for k in asked}
    assert {bytes(r.k) for r in log.present(stored, keys, broadcast_keys=broadcast_keys).collect()} == asked & set(model)
    assert {bytes(r.k) for r in log.absent(stored, keys, broadcast_keys=broadcast_keys).collect()} == asked - set(model)
    if broadcast_keys:  # the log is cut to the keys before it is shuffled
        plan = log.live(log.asked(stored, keys))._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("Window") < plan.index("BroadcastHashJoin") < plan.index("FileScan")


def test_flush_runs(spark):
    rows, _ = operations(7)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("bytes", F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).repartition(3)
    expected = {}
    for shard in range(4):
        held = number = 0
        for k, seq, v, gone in rows:
            if shards.shard_number(k, 4) == shard:
                expected[seq] = (shard, number)
                held += 0 if gone else len(k) + len(v)
                if held >= 200:
                    held, number = 0, number + 1
    assert {r.seq: (r.shard, r.run_id) for r in tiers.flush_runs(frame, 200, 4).collect()} == expected


def test_run_checksums(spark):
    rows, _ = operations(8, 200)
    frame = spark.createDataFrame(rows, SCHEMA).where("NOT deleted").dropDuplicates(["k"]).withColumn("run", (F.col("seq") % 3).cast("int"))
    found = {r.run: r.crc for r in tiers.run_checksums(frame, "run", "k", "v").collect()}
    for run, value in found.items():
        own = sorted((bytes(r.k), bytes(r.v)) for r in frame.where(F.col("run") == run).collect())
        assert value == crc(b"".join(k + v for k, v in own))
    listing = spark.createDataFrame([(r, c + (r == 1)) for r, c in found.items()], "run int, crc long")
    assert {r.run for r in tiers.sound_runs(frame, listing, "run", "k", "v").collect()} == {0, 2}


def test_tier_records(spark):
    frame = spark.createDataFrame([("a", 1, "x", False), ("b", 2, "", False), ("b", 3, None, True), ("c", 4, None, True), ("c", 5, "y", False)], "k string, seq long, v string, deleted boolean")
    records = tiers.to_records(frame)
    assert {(r.k, r.v) for r in records.collect()} == {("d:a", "x"), ("t:b", None), ("d:c", "y")}
    other = spark.createDataFrame([("meta", 0, "z")], "k string, seq long, v string")
    assert {(r.k, r.v, r.deleted) for r in tiers.from_records(records.unionByName(other)).collect()} == {("a", "x", False), ("b", None, True), ("c", "y", False)}


def test_scan_until_and_scalars(spark):
    frame = spark.createDataFrame([(f"k{i}", i, str(i % 4), False) for i in range(9)], "k string, seq long, v string, deleted boolean")
    assert [r.k for r in callbacks.scan_until(frame, F.col("v") == "2").orderBy("k").collect()] == ["k0", "k1", "k2"]
    assert callbacks.scan_until(frame, F.col("v") == "none").count() == 9
    row = spark.createDataFrame([([1, 2, 3], [])], "a array<int>, e array<int>").select(
        lists.cons(F.lit(0), F.col("a")).alias("cons"), lists.car(F.col("a")).alias("car"), lists.cdr(F.col("a")).alias("cdr"),
        lists.car(F.col("e")).alias("none"), lists.cdr(F.col("e")).alias("rest"), lists.is_empty(F.col("e")).alias("empty"), lists.is_empty(F.col("a")).alias("full"),
    ).first()
    assert tuple(row) == ([0, 1, 2, 3], 1, [2, 3], None, [], True, False)
    numbers = [5, -9, 1 << 60]
    data = spark.createDataFrame([(bytearray(struct.pack("<3q", *numbers)),)], "d binary")
    assert [data.select(hashing.little_endian_long(F.col("d"), i)).first()[0] for i in range(3)] == numbers
    made = spark.range(200).select(hashing.random_bytes(3, 40, 1).alias("b"), hashing.now_nanos().alias("t"))
    lengths = {len(r.b) for r in made.collect()}
    assert min(lengths) >= 3 and max(lengths) <= 40 and len(lengths) > 10 and made.select("b").distinct().count() > 190 and made.first().t > 1e18
    signs = spark.createDataFrame([(4, True), (4, False)], "o long, d boolean").select(hashing.tombstone_offset(F.col("o"), F.col("d")))
    assert sorted(r[0] for r in signs.collect()) == [-4, 4]


def test_generations_spread_hot_shards(spark, tmp_path):
    base = str(tmp_path / "g")
    spark.createDataFrame([(f"k{i}", i, "v", False) for i in range(3000)], "k string, seq long, v string, deleted boolean").write.parquet(f"{base}/data-0")
    spark.createDataFrame([(0, 1)], "generation int, n int").write.parquet(f"{base}/generations")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tiers.compact_generation(spark, base, 1) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "g/data-1/shard=0").glob("*.parquet"))) > 1 and spark.read.parquet(f"{base}/data-1").count() == 3000


def test_tries_and_orders(spark):
    words = spark.createDataFrame([("tree", 1, "a"), ("tree", 2, "b"), ("trick", 3, "c"), ("t", 4, None), ("", 5, "x"), (None, 6, "y")], "w string, n int, v string")
    found = {r.prefix: (r.depth, r.is_word, r.value) for r in text.trie_values(words, "w", "v", "n").collect()}
    assert found["tree"] == (4, True, "b") and found["tre"] == (3, False, None) and found["t"] == (1, True, None) and "" not in found
    probes = spark.createDataFrame([("tree",), ("tref",), ("tre",)], "p string")
    assert {(r.p, r.found) for r in text.trie_search(text.trie(words, "w"), probes, "p").collect()} == {("tree", True), ("tref", False), ("tre", False)}
    rows = spark.createDataFrame([(1, "bb"), (2, "a"), (3, "ccc"), (4, "dd")], "row_no int, s string")
    assert [r.row_no for r in table.sort_by_key(rows, lambda x: -x.s.str.len(), "long").collect()] == [3, 1, 4, 2]


def test_workload(spark, tmp_path):
    load = workload.Workload("tiny", 200, (16, 32), (5, 50), 70, 80)
    record = workload.run(spark, load, str(tmp_path / "w"))
    assert record["errors"] == 0 and record["operations_per_second"] > 0 and spark.read.parquet(str(tmp_path / "w/log")).select("k").distinct().count() == 200
    written = spark.read.parquet(str(tmp_path / "w/written"))
    assert 0 < written.count() <= 80 and written.agg(F.min("seq")).first()[0] == 201


def random_changes(spark, store, seed, rounds=6):
    rng, model = random.Random(seed), {}
    for b in range(rounds):
        put = {f"k{rng.randrange(30)}": f"v{b}-{rng.randrange(99)}" for _ in range(8)}
        store.put(spark.createDataFrame(list(put.items()), "k string, v string"))
        model |= put
        gone = [f"k{rng.randrange(40)}" for _ in range(4)]
        store.delete(spark.createDataFrame([(k,) for k in gone], "k string"))
        for k in gone:
            model.pop(k, None)
    return model


def test_tiered_store(spark, tmp_path):
    store = stores.TieredStore(spark, str(tmp_path / "t"), limits=(60, 150, 10_000))
    assert store.scan().count() == 0 and store.versions() == []
    model = random_changes(spark, store, 1)
    assert {r.k: r.v for r in store.scan().collect()} == model
    assert {r.tier for r in store.sizes().collect()} - {0} and not any(r.flush for r in store.sizes().collect())
    asked = spark.createDataFrame([(f"k{i}",) for i in range(45)], "k string")
    assert {r.k: r.v for r in store.get(asked).collect()} == {f"k{i}": model.get(f"k{i}") for i in range(45)}
    before = store.versions()[-1]
    store.delete(spark.createDataFrame([(k,) for k in model], "k string"))
    store.put(spark.createDataFrame([("new", "x")], "k string, v string"))
    assert {r.k: r.v for r in store.scan(before).collect()} == model and {r.k for r in store.scan().collect()} == {"new"}
    again = stores.TieredStore(spark, str(tmp_path / "t"), limits=(60, 150, 10_000))
    again.flush(0)
    again.flush(1)
    assert again.log().where("deleted").count() == 0 and {r.k for r in again.scan().collect()} == {"new"}
    again.vacuum()
    assert len(again.versions()) == 1 and len(list((tmp_path / "t/runs").glob("*"))) == 1 and {r.v for r in again.scan().collect()} == {"x"}


def test_sharded_store(spark, tmp_path):
    store = stores.ShardedStore(spark, str(tmp_path / "s"), 5)
    assert store.scan().count() == 0
    store.compact()
    model = random_changes(spark, store, 2)
    check = lambda s: {r.k: r.v for r in s.scan().collect()} == model
    assert check(store)
    one = next(iter(model))
    assert [tuple(r) for r in store.lookup(one).collect()] == [(one, model[one])]
    versions = store.log().count()
    store.compact()
    assert check(store) and store.log().count() == len(model) < versions and store.generation == 1
    (tmp_path / "s/data-2/shard=0").mkdir(parents=True)  # an interrupted compaction
    again = stores.ShardedStore(spark, str(tmp_path / "s"), 99)
    assert (again.n, again.generation) == (5, 1) and check(again) and not (tmp_path / "s/data-2").exists()
    assert {r.k: r.found for r in again.get(spark.createDataFrame([(one,), ("none",)], "k string")).collect()} == {one: True, "none": False}
    total = again.sizes().where("shard IS NULL").first()
    assert (total.n_keys, total.n_bytes) == (len(model), sum(len(k) + len(v) for k, v in model.items()))
    again.put(spark.createDataFrame([(one, "later")], "k string, v string"))
    assert again.lookup(one).first().v == "later"


# Streams


def test_folded_batches(spark, tmp_path):
    schema = "k string, seq long, v string, deleted boolean"
    rng, model, source, state = random.Random(9), {}, str(tmp_path / "in"), str(tmp_path / "state")
    batches = []
    for b in range(5):
        rows = [(f"k{rng.randrange(20)}", rng.randrange(1000) * 10 + b, f"v{b}", rng.random() < 0.3) for _ in range(6)]
        batches.append(spark.createDataFrame(rows, schema))
        for k, seq, v, gone in rows:
            model[k] = max(model.get(k, (-1, "", False)), (seq, v, gone))
    fold = streaming.fold_batches(state, buckets=8)
    assert streaming.folded(spark, state, batches[0].schema).count() == 0
    for number, batch in enumerate(batches):
        fold(batch, number)
        if number in (0, 3):
            fold(batch, number)  # a batch that runs again
    found = {r.k: (r.seq, r.v, r.deleted) for r in streaming.folded(spark, state, batches[0].schema).collect()}
    assert found == model
    kept = {p.relative_to(state).as_posix() for p in (tmp_path / "state/lists").glob("*")}
    assert kept == {"lists/batch=3", "lists/batch=4"}
    batches[0].unionByName(batches[1]).write.parquet(source)
    streaming.start(spark.readStream.schema(schema).parquet(source), streaming.fold_batches(str(tmp_path / "s2")), str(tmp_path / "cp")).awaitTermination()
    newest = {r.k: r.seq for r in log.latest(spark.read.schema(schema).parquet(source)).collect()}
    assert {r.k: r.seq for r in streaming.folded(spark, str(tmp_path / "s2"), batches[0].schema).collect()} == newest


def test_ring_of_recent_operations(spark, tmp_path):
    schema = "k string, seq long, v string, deleted boolean"
    source = str(tmp_path / "in")
    for part in ([("a", i, "v", False) for i in range(5)], [("a", i, None, True) for i in range(5, 9)] + [("b", 1, "v", False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def collect(batch, number):
        seen.append({(r.k, r.age): (r.seq, r.deleted) for r in batch.collect()})

    query = streaming.recent_ring(stream, 3).writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for batch in seen:
        last |= batch
    assert {k: v[0] for k, v in last.items()} == {("a", 1): 8, ("a", 2): 7, ("a", 3): 6, ("b", 1): 1}


def test_small_state_drops_old_folders(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1, "x", False)], "k string, seq long, v string, deleted boolean")
    merge = streaming.merge_batch(str(tmp_path / "m"))
    for number in range(4):
        merge(batch.withColumn("seq", F.lit(number).cast("long")), number)
    assert sorted(p.name for p in (tmp_path / "m").glob("batch=*")) == ["batch=2", "batch=3"]


def test_shared_folder_is_needed():
    from types import SimpleNamespace

    for master, base in (("spark://host:7077", None), ("spark://host:7077", "hdfs:///a"), ("local[2]", None)):
        context = SimpleNamespace(master=master, getConf=lambda base=base: {"spark.checkpoint.dir": base} if base else {}, getCheckpointDir=lambda: None)
        session = SimpleNamespace(sparkContext=context, conf={})
        if master.startswith("local") or base:
            assert files._base(session) == base or files._base(session).startswith("file://")
        else:
            with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
                files._base(session)


