"""Store files written here and read back, whole and damaged; streams of log files."""

from __future__ import annotations

import base64
import json
import struct

from logtide.operators.log import live
from logtide.sources import backends, formats
from logtide.streaming import latest as streaming

OPERATIONS = [(b"a", b"1"), (b"b", b""), (b"a", None), (b"c", b"3" * 1000), (b"a", b"again")]
MODEL = {b"a": b"again", b"b": b"", b"c": b"3" * 1000}


def pairs(frame):
    return {bytes(r.k): bytes(r.v) for r in live(frame).collect()}


def test_timed_log(spark, tmp_path):
    raw = b"".join(formats.timed_record(i + 1, k, v) for i, (k, v) in enumerate(OPERATIONS))
    (tmp_path / "log").write_bytes(raw + bytes(64))
    assert pairs(backends.open_log(spark, "timed", str(tmp_path))) == MODEL
    (tmp_path / "log").write_bytes(raw[:-3])
    assert b"a" not in pairs(backends.open_log(spark, "timed", str(tmp_path)))


def test_checked_log(spark, tmp_path):
    raw = b"".join(formats.checked_record(k, v) for k, v in OPERATIONS)
    (tmp_path / "log").write_bytes(raw)
    assert pairs(backends.open_log(spark, "checked", str(tmp_path))) == MODEL
    damaged = bytearray(raw)
    damaged[-1] ^= 1
    (tmp_path / "log").write_bytes(bytes(damaged))
    assert pairs(backends.open_log(spark, "checked", str(tmp_path))) == {b"b": b"", b"c": b"3" * 1000}


def test_extent(spark, tmp_path):
    for kind, at in (("keys", 0), ("values", 1)):
        body, offsets = b"", [0]
        for operation in OPERATIONS:
            piece = operation[at] if operation[1] is not None or at == 0 else b"DELETED"
            if operation[1] is None:
                offsets[-1] = -offsets[-1]
            body += piece
            offsets.append(len(body))
        (tmp_path / f"{kind}.dat").write_bytes(body)
        (tmp_path / f"{kind}.index").write_bytes(b"".join(struct.pack(">q", x) for x in offsets))
    assert pairs(backends.open_log(spark, "extent", str(tmp_path))) == MODEL
    (tmp_path / "values.dat").write_bytes((tmp_path / "values.dat").read_bytes()[:-2])
    assert b"a" not in pairs(backends.open_log(spark, "extent", str(tmp_path)))


def test_sharded_extents(spark, tmp_path):
    shards = [[(b"a", b"first"), (b"b", b"22")], [(b"c", b"3"), (b"d", None), (b"e", b"five")]]
    for number, records in enumerate(shards):
        (tmp_path / str(number)).mkdir()
        for kind, at in (("keys", 0), ("values", 1)):
            body, offsets = b"", [0]
            for record in records:
                offsets[-1] *= -1 if record[1] is None else 1
                body += record[at] or b"DELETED"
                offsets.append(len(body))
            (tmp_path / str(number) / f"{kind}.dat").write_bytes(body)
            (tmp_path / str(number) / f"{kind}.index").write_bytes(b"".join(struct.pack(">q", x) for x in offsets))
    rows = backends.sharded("extent")(spark, str(tmp_path))
    assert rows.count() == 5
    assert pairs(rows) == {k: v for records in shards for k, v in records if v is not None}


def test_json_and_objects(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/map.json").write_text(json.dumps({"k1": base64.b64encode(b"v1").decode(), "k2": ""}))
    assert {r.k: bytes(r.v) for r in backends.open_log(spark, "json", str(tmp_path / "j")).collect()} == {"k1": b"v1", "k2": b""}
    (tmp_path / "o/user").mkdir(parents=True)
    (tmp_path / "o/user/1").write_bytes(b"x")
    (tmp_path / "o/root").write_bytes(b"y")
    assert {r.k: bytes(r.v) for r in formats.read_objects(spark, str(tmp_path / "o")).collect()} == {"user/1": b"x", "root": b"y"}


def test_export_and_metadata(spark, tmp_path):
    frame = spark.createDataFrame([("k", 1, "a", False), ("k", 2, "b", False)], "k string, seq long, v string, deleted boolean")
    formats.export_history(frame, str(tmp_path / "h"))
    assert {(r.key_hex, r.version_no, r.v) for r in spark.read.parquet(str(tmp_path / "h")).collect()} == {("6b", 1, "a"), ("6b", 2, "b")}
    formats.export_live(frame, str(tmp_path / "l"))
    assert {r.k: bytes(r.v) for r in formats.read_json_map(spark, str(tmp_path / "l/*.txt")).collect()} == {"k": b"b"}
    (tmp_path / "m.json").write_text('{"generation": 3, "n": 4, "totalKeys": 5}')
    assert tuple(formats.read_metadata(spark, str(tmp_path / "m.json")).first()) == (3, 4, 5)


def test_streams(spark, tmp_path):
    schema = "k string, seq long, v string, deleted boolean"
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("a", 5, "new", False), ("b", 6, None, True)], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("a", 1, "late", False), ("b", 2, "late", False), ("c", 3, "x", False)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.start(stream, streaming.merge_batch(state), str(tmp_path / "cp")).awaitTermination()
    last = max((tmp_path / "state").glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))
    assert {(r.k, r.v, r.deleted) for r in spark.read.schema(schema).parquet(str(last)).collect()} == {("a", "new", False), ("b", None, True), ("c", "x", False)}
    table = streaming.replay(spark, spark.read.parquet(source), source, "replayed")
    assert {(r.k, r.v, r.deleted) for r in table.collect()} == {("a", "new", False), ("b", None, True), ("c", "x", False)}
    streaming.start(spark.readStream.schema(schema).parquet(source), streaming.dual_write(str(tmp_path / "x"), str(tmp_path / "y")), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "x")).count() == spark.read.parquet(str(tmp_path / "y")).count() == 5
