"""Every key-value query against its DuckDB twin, and the entry points."""

from __future__ import annotations

import zlib

import pytest

from logtide.plans import catalogue
from tests.conftest import ROOT
from tests.oracle import DATA, check


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_oracle(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_crc_is_that_of_zlib(spark):
    docs = {str(r.doc_id): r.text for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()}
    found = {r.k: r.crc for r in catalogue.crc_records(spark, str(DATA / "sf0.001")).collect()}
    assert found == {k: zlib.crc32((k + (v or "")).encode()) for k, v in docs.items()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_key_sets(spark):
    """Every customer is asked for and deleted, and every order put."""
    sf = str(DATA / "sf0.01")
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    asked = {f"{t}:{r.c_custkey}" for r in table("customer").collect() for t in ("purchase", "view")}
    run = lambda name: catalogue.QUERIES[name](spark, sf).collect()
    stored = {r.k for r in run("kv_live")}
    assert {r.k: r.found for r in run("kv_multi_get_all")} == {k: k in stored for k in asked}
    assert {r.k: r.present for r in run("kv_exists_all")} == {k: k in stored for k in asked}
    assert {r.k for r in run("kv_exists_semi_all")} == asked & stored
    assert {r.k for r in run("kv_exists_anti_all")} == asked - stored
    assert {r.k for r in run("kv_delete_batch_all")} == stored - asked
    assert {r.k for r in run("kv_put_batch_all")} == stored | {f"order:{r.o_orderkey}" for r in table("orders").collect()}


def test_cuts_grow_with_the_log(spark):
    """The replayed half and the valid prefix reach half of the log at every scale."""
    for sf in ("sf0.001", "sf0.01"):
        events = spark.read.parquet(str(DATA / sf / "events.parquet"))
        half = events.selectExpr("max(event_id) div 2").first()[0]
        before = events.where(events.event_id <= half)
        assert catalogue.QUERIES["wal_valid_prefix_half"](spark, str(DATA / sf)).count() >= before.count()
        assert half * 0.9 < max(r.seq for r in catalogue.QUERIES["kv_as_of_half"](spark, str(DATA / sf)).collect()) <= half


def test_entry_without_the_optional_part():
    """The other queries load where a library of the training-data operators is missing, and where their folders are."""
    import subprocess
    import sys

    hide = "import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'kv_live' in q and 'op3_bpe' not in q and set(e.oracle_sql()) <= set(q)"
    for name in ("ahocorasick", "logtide.llm", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", hide.format(name=name)], check=True, cwd=ROOT, capture_output=True)
