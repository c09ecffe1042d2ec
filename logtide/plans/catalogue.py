"""Registry of the key-value queries and their DuckDB twins.

The log of most queries comes from ``events``: key ``event_type:user_id``, version ``event_id``,
and a tombstone where the event is an error or its value is below 20.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions import hashing, text
from logtide.operators import callbacks, integrity, log, shards, table, tiers
from logtide.sources import backends, files, formats
from logtide.streaming import latest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOG_SQL = """WITH log AS (
  SELECT concat(event_type, ':', cast(user_id AS varchar)) AS k, event_id AS seq, value AS v,
         (event_type = 'error' OR value < 20) AS deleted FROM events),
latest AS (SELECT k, seq, v, deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT k, seq, v FROM latest WHERE NOT deleted)
"""
_HASH_SQL = """CASE WHEN ('0x' || substr(md5({k}), 17, 16))::UBIGINT >= 9223372036854775808
  THEN 18446744073709551615 - ('0x' || substr(md5({k}), 17, 16))::UBIGINT + 1 ELSE ('0x' || substr(md5({k}), 17, 16))::UBIGINT END"""
SHARDS = 16


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a function under its own name, with its DuckDB twin."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    gone = (F.col("event_type") == "error") | (F.col("value") < 20)
    return log.build_log(read(spark, sf_dir, "events"), key, F.col("event_id"), F.col("value"), gone)


def middle(rows: DataFrame) -> int:
    """Half of the log's last version; 0 for an empty log."""
    return (rows.agg(F.max("seq")).first()[0] or 0) // 2


def all_probe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase and a view of every customer, stored or not."""
    custkey = F.col("c_custkey").cast("string")
    return read(spark, sf_dir, "customer").select(F.explode(F.array(*[F.concat(F.lit(t), custkey) for t in ("purchase:", "view:")])).alias("k"))


_ALL_PROBES_SQL = ", probes AS (SELECT 'purchase:' || c_custkey AS k FROM customer UNION ALL SELECT 'view:' || c_custkey FROM customer)\n"

# Point access


@query(_LOG_SQL + "SELECT k, seq, v FROM live")
def kv_live(spark, sf_dir):
    return log.live(event_log(spark, sf_dir)).select("k", "seq", "v")


@query(_LOG_SQL + "SELECT * FROM latest")
def kv_latest_with_tombstones(spark, sf_dir):
    return log.latest(event_log(spark, sf_dir))


@query(_LOG_SQL + "SELECT p.k, l.v, l.k IS NOT NULL AS found FROM (SELECT 'no:such:key' AS k) p LEFT JOIN live l ON p.k = l.k")
def kv_get_missing(spark, sf_dir):
    return log.get(event_log(spark, sf_dir), spark.range(1).select(F.lit("no:such:key").alias("k")))


@query(_LOG_SQL + _ALL_PROBES_SQL + "SELECT p.k, l.v, l.k IS NOT NULL AS found FROM (SELECT DISTINCT k FROM probes) p LEFT JOIN live l ON p.k = l.k")
def kv_multi_get_all(spark, sf_dir):
    return log.get(event_log(spark, sf_dir), all_probe_keys(spark, sf_dir))


@query(_LOG_SQL + _ALL_PROBES_SQL + "SELECT DISTINCT p.k, l.k IS NOT NULL AS present FROM probes p LEFT JOIN live l ON p.k = l.k")
def kv_exists_all(spark, sf_dir):
    return log.exists(event_log(spark, sf_dir), all_probe_keys(spark, sf_dir))


@query(_LOG_SQL + _ALL_PROBES_SQL + "SELECT k FROM probes WHERE k IN (SELECT k FROM live)")
def kv_exists_semi_all(spark, sf_dir):
    return log.present(event_log(spark, sf_dir), all_probe_keys(spark, sf_dir))


@query(_LOG_SQL + _ALL_PROBES_SQL + "SELECT k FROM probes WHERE k NOT IN (SELECT k FROM live)")
def kv_exists_anti_all(spark, sf_dir):
    return log.absent(event_log(spark, sf_dir), all_probe_keys(spark, sf_dir))


@query(_LOG_SQL + "SELECT k FROM live ORDER BY k")
def kv_keys_sorted(spark, sf_dir):
    return log.keys(event_log(spark, sf_dir)).orderBy(F.col("k").cast("binary"))


@query(_LOG_SQL + "SELECT k, strlen(k)::BIGINT AS n FROM live ORDER BY n, k")
def kv_keys_shortlex(spark, sf_dir):
    return log.keys(event_log(spark, sf_dir)).withColumn("n", F.octet_length("k").cast("long")).orderBy("n", "k")


@query("SELECT count(*) AS n_keys, sum(strlen(cast(doc_id AS varchar)) + strlen(coalesce(text, '')))::BIGINT AS n_bytes FROM documents")
def kv_size(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return log.size(log.build_log(docs, F.col("doc_id").cast("string"), F.lit(1), F.col("text")))


# Prefixes


@query(_LOG_SQL + "SELECT k, v FROM live WHERE starts_with(k, 'purchase:1')")
def kv_prefix_scan(spark, sf_dir):
    return log.prefix_scan(event_log(spark, sf_dir), "purchase:1").select("k", "v")


@query(_LOG_SQL + "SELECT k, v FROM live WHERE starts_with(k, 'view:')")
def kv_prefix_bytes(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("k", F.col("k").cast("binary"))
    return log.prefix_scan(rows, b"view:").select(F.col("k").cast("string").alias("k"), "v")


@query(_LOG_SQL + "SELECT k, v FROM live WHERE k ILIKE 'PURCHASE:_2%'")
def kv_prefix_ilike(spark, sf_dir):
    return log.live(event_log(spark, sf_dir)).where(F.col("k").ilike("PURCHASE:_2%")).select("k", "v")


@query("SELECT url AS k, strlen(html)::BIGINT AS n_bytes FROM pages WHERE starts_with(url, 'https://')")
def kv_prefix_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(log.prefix_filter("url", "https://")).select(F.col("url").alias("k"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT conv_id || ':' || turn AS k, role FROM conversations WHERE starts_with(conv_id || ':' || turn, '1')")
def kv_prefix_conversation(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "role")
    return turns.where(log.prefix_filter("k", "1"))


# Versions


@query(_LOG_SQL + "SELECT k, seq, v, row_number() OVER (PARTITION BY k ORDER BY seq) AS version_no FROM log WHERE NOT deleted")
def kv_key_history(spark, sf_dir):
    return log.history(event_log(spark, sf_dir)).select("k", "seq", "v", "version_no")


@query(_LOG_SQL + "SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS age FROM log WHERE NOT deleted")
def kv_history_newest_first(spark, sf_dir):
    from pyspark.sql.window import Window

    newest = Window.partitionBy("k").orderBy(F.desc("seq"))
    return event_log(spark, sf_dir).where("NOT deleted").select("k", "v", F.row_number().over(newest).cast("long").alias("age"))


@query(_LOG_SQL + "SELECT k, count(*) AS n_versions, count(*) FILTER (NOT deleted) AS n_values FROM log GROUP BY k")
def kv_history_counts(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n_versions"), F.count(F.when(~F.col("deleted"), 1)).alias("n_values"))


@query(_LOG_SQL + "SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM log WHERE NOT deleted) WHERE rn = 1")
def kv_first_wins(spark, sf_dir):
    return log.first_wins(event_log(spark, sf_dir)).select("k", "seq", "v")


@query(
    _LOG_SQL
    + """, cut AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log))
SELECT k, seq, v FROM cut WHERE rn = 1 AND NOT deleted"""
)
def kv_as_of_half(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    return log.as_of(rows, middle(rows)).select("k", "seq", "v")


# Changes


@query(_LOG_SQL + ", batch AS (SELECT 'order:' || o_orderkey AS k, o_totalprice AS v FROM orders) SELECT k, v FROM live UNION ALL SELECT k, v FROM batch")
def kv_put_batch_all(spark, sf_dir):
    batch = read(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("k"), F.col("o_totalprice").alias("v"))
    return log.live(log.put(event_log(spark, sf_dir), batch)).select("k", "v")


@query(_LOG_SQL + _ALL_PROBES_SQL + "SELECT k, v FROM live WHERE k NOT IN (SELECT k FROM probes)")
def kv_delete_batch_all(spark, sf_dir):
    return log.live(log.delete(event_log(spark, sf_dir), all_probe_keys(spark, sf_dir))).select("k", "v")


@query(
    """WITH stored AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1),
batch AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 5000)
SELECT k, v FROM batch UNION ALL SELECT k, v FROM stored WHERE k NOT IN (SELECT k FROM batch)"""
)
def kv_upsert_merge(spark, sf_dir):
    stored = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    batch = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return log.upsert(stored, batch)


@query("SELECT doc_id, coalesce(strlen(cast(doc_id AS varchar)) BETWEEN 1 AND 32768 AND strlen(text) <= 4096, false) AS accepted FROM documents")
def kv_size_limits(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"), "text")
    return log.size_limits(docs, "k", "text", 32768, 4096).select("doc_id", "accepted")


@query(_LOG_SQL + "SELECT sum(CASE WHEN deleted THEN -1 ELSE 1 END)::BIGINT AS net_ops, (SELECT count(*) FROM live) AS n_keys FROM log")
def kv_net_ops(spark, sf_dir):
    return log.net_operations(event_log(spark, sf_dir))


@query(_LOG_SQL + "SELECT * FROM log ORDER BY seq DESC LIMIT 50")
def recent_ops(spark, sf_dir):
    return log.recent(event_log(spark, sf_dir), 50)


@query(
    _LOG_SQL
    + "SELECT k, string_agg(CASE WHEN deleted THEN 'delete' ELSE 'put' END || ' ' || seq, chr(10) ORDER BY seq) AS ops FROM log GROUP BY k"
)
def op_log_text(spark, sf_dir):
    line = F.concat(F.when(F.col("deleted"), "delete ").otherwise("put "), F.col("seq").cast("string"))
    lines = F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))
    return event_log(spark, sf_dir).groupBy("k").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("ops"))


# Routing


@query(_LOG_SQL + f"SELECT k, printf('%016x', h::BIGINT) AS hash, (h % {SHARDS})::INT AS shard FROM (SELECT k, {_HASH_SQL.format(k='k')} AS h FROM live)")
def route_hash(spark, sf_dir):
    rows = log.keys(event_log(spark, sf_dir))
    return rows.select("k", hashing.hash_hex(F.col("k")).alias("hash"), hashing.shard_of(F.col("k"), SHARDS).alias("shard"))


@query(f"SELECT doc_id, ({_HASH_SQL.format(k='doc_id::VARCHAR')} % {SHARDS})::INT AS shard FROM documents")
def shard_assign(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"))
    return shards.with_shard(docs, SHARDS).select("doc_id", "shard")


_SIZED_SQL = f"""WITH sized AS (SELECT doc_id::VARCHAR AS k, strlen(coalesce(text, '')) AS bytes, {_HASH_SQL.format(k='doc_id::VARCHAR')} AS h FROM documents)
"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


@query(_SIZED_SQL + f"SELECT (h % {SHARDS})::INT AS shard, count(*) AS n_keys, sum(bytes)::BIGINT AS n_bytes FROM sized GROUP BY 1")
def shard_stats(spark, sf_dir):
    return shards.shard_stats(shards.with_shard(_sized(spark, sf_dir), SHARDS)).where("shard IS NOT NULL")


@query(_SIZED_SQL + f"SELECT (h % {SHARDS})::INT AS shard, count(*) AS n_keys, sum(bytes)::BIGINT AS n_bytes FROM sized GROUP BY ROLLUP (1)")
def shard_rollup(spark, sf_dir):
    return shards.shard_stats(shards.with_shard(_sized(spark, sf_dir), SHARDS))


@query(_SIZED_SQL + f"SELECT k, bytes::BIGINT AS bytes, (h % {SHARDS})::INT AS shard FROM sized WHERE k = '42'")
def shard_point_lookup(spark, sf_dir):
    return shards.point_lookup(shards.with_shard(_sized(spark, sf_dir), SHARDS), "42", SHARDS)


@query(_SIZED_SQL + "SELECT k, substr(printf('%016x', h::BIGINT), 1, 1) AS depth0, substr(printf('%016x', h::BIGINT), 1, 3) AS depth2 FROM sized")
def hash_prefix_depth(spark, sf_dir):
    k = F.col("k")
    return _sized(spark, sf_dir).select("k", hashing.hash_prefix(k, 0).alias("depth0"), hashing.hash_prefix(k, 2).alias("depth2"))


@query(_SIZED_SQL + "SELECT substr(printf('%016x', h::BIGINT), 1, 2) AS node, count(*) AS n_keys, sum(bytes)::BIGINT AS n_bytes, sum(bytes) > 20000 AS split FROM sized GROUP BY 1")
def split_plan(spark, sf_dir):
    return shards.split_plan(_sized(spark, sf_dir), 20000, 1)


# Tiers, runs, compaction

_TIER_SQL = _LOG_SQL + ", tiered AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 0 ELSE 1 END AS tier FROM log)\n"


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).withColumn("tier", F.when(F.col("seq") % 4 == 0, 0).otherwise(1))


@query(_TIER_SQL + "SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, seq DESC) AS rn FROM tiered) WHERE rn = 1 AND NOT deleted")
def tier_merge(spark, sf_dir):
    return tiers.resolve_tiers(_tiered(spark, sf_dir)).where("NOT deleted").select("k", "v")


@query(
    _TIER_SQL
    + """, top AS (SELECT k, seq, v, deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM tiered WHERE tier = 0) WHERE rn = 1)
SELECT * FROM top UNION ALL SELECT k, seq, v, deleted FROM tiered WHERE tier = 1 AND k NOT IN (SELECT k FROM top)"""
)
def tier_tombstone_carry(spark, sf_dir):
    rows = _tiered(spark, sf_dir)
    return tiers.merge_down(rows.where("tier = 0").drop("tier"), rows.where("tier = 1").drop("tier"))


@query(
    """SELECT (doc_id % 4)::INT AS tier, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes,
       sum(strlen(coalesce(text, ''))) > [200000, 400000, 800000, 1600000][doc_id % 4 + 1] AS flush FROM documents GROUP BY doc_id % 4"""
)
def tier_flush_plan(spark, sf_dir):
    rows = _sized(spark, sf_dir).withColumn("tier", (F.col("k").cast("long") % 4).cast("int"))
    return tiers.flush_plan(rows, (200_000, 400_000, 800_000, 1_600_000))


@query("SELECT l_orderkey // 1000 AS run_id, min(l_orderkey) AS min_k, max(l_orderkey) AS max_k, count(*) AS n_entries, sum(8 + strlen(l_returnflag))::BIGINT AS n_bytes FROM lineitem GROUP BY 1")
def run_metadata(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("run_id", F.floor(F.col("l_orderkey") / 1000))
    return tiers.run_metadata(rows, "run_id", "l_orderkey", F.octet_length("l_returnflag") + 8)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 1234")
def run_pruned_lookup(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_orderkey = 1234").select("l_orderkey", "l_linenumber", "l_quantity")


@query(_LOG_SQL + "SELECT (seq // 1000)::BIGINT AS run_id FROM log GROUP BY 1 HAVING min(k) <= 'purchase:5' AND max(k) >= 'purchase:5'")
def run_candidates(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("run_id", F.floor(F.col("seq") / 1000))
    return tiers.candidate_runs(tiers.run_metadata(rows, "run_id", "k", F.lit(8)), F.lit("purchase:5")).select("run_id")


@query(
    _LOG_SQL
    + """, sized AS (SELECT seq, strlen(k) + 8 AS bytes FROM log)
SELECT seq, (coalesce(sum(bytes) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8192)::BIGINT AS run_id FROM sized"""
)
def memtable_runs(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("bytes", (F.octet_length("k") + 8).cast("long"))
    return tiers.memtable_runs(rows, 8192).select("seq", "run_id")


@query(_LOG_SQL + "SELECT k, seq, v, false AS deleted FROM live")
def compaction(spark, sf_dir):
    return tiers.compact(event_log(spark, sf_dir))


@query(_LOG_SQL + "SELECT count(*) AS versions, sum(deleted::INT)::BIGINT AS tombstones, (SELECT count(*) FROM live) AS kept, count(*) - (SELECT count(*) FROM live) AS dropped FROM log")
def compaction_stats(spark, sf_dir):
    return tiers.compaction_stats(event_log(spark, sf_dir))


# Integrity


@query()
def crc_records(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), "text")
    return integrity.with_crc(docs, "k", "text").select("k", "crc")


@query("SELECT cast(doc_id AS varchar) AS k FROM documents WHERE doc_id % 7 = 3")
def crc_mismatch_filter(spark, sf_dir):
    stored = integrity.with_crc(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), "doc_id", "text"), "k", "text")
    damaged = stored.withColumn("crc", F.when(F.col("doc_id") % 7 == 3, F.col("crc").bitwiseXOR(F.lit(1).cast("long"))).otherwise(F.col("crc")))
    return integrity.crc_mismatches(damaged, "k", "text").select("k")


@query(_LOG_SQL + "SELECT k, seq FROM log WHERE seq < (SELECT min(seq) FROM log WHERE seq > (SELECT max(seq) // 2 FROM log) AND v < 25)")
def wal_valid_prefix_half(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    return integrity.valid_prefix(rows.withColumn("bad", (F.col("seq") > middle(rows)) & (F.col("v") < 25))).select("k", "seq")


_INDEX_SQL = """WITH idx AS (
  SELECT source, doc_id AS entry, (coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         * CASE WHEN doc_id % 9 = 4 THEN -1 ELSE 1 END)::BIGINT AS off FROM documents)
"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("entry"), "n_chars")
    return integrity.with_offsets(docs, "source", "entry", "n_chars", F.col("entry") % 9 == 4).select("source", "entry", "off")


@query(_INDEX_SQL + "SELECT source, entry, off, (lead(abs(off)) OVER (PARTITION BY source ORDER BY entry) - abs(off))::BIGINT AS length, off < 0 AS tombstone FROM idx")
def offset_index_lengths(spark, sf_dir):
    return integrity.offset_lengths(_index(spark, sf_dir), "source")


_FILES_SQL = "SELECT doc_id, n_chars AS index_end, (n_chars + doc_id % 5 * 4 - 8)::BIGINT AS data_end FROM documents"


@query(
    f"""SELECT *, CASE WHEN index_end = data_end THEN 'ok' WHEN index_end < data_end THEN 'truncate'
       WHEN index_end - data_end <= 4 THEN 'lost_tail' ELSE 'unrecoverable' END AS state FROM ({_FILES_SQL})"""
)
def offset_reconcile(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("index_end"), (F.col("n_chars") + F.col("doc_id") % 5 * 4 - 8).alias("data_end"))
    return integrity.reconcile(files, 4)


@query("SELECT e.event_id AS entry, e.event_type, o.o_totalprice FROM events e JOIN orders o ON e.event_id = o.o_orderkey")
def index_data_join(spark, sf_dir):
    names = read(spark, sf_dir, "events").select(F.col("event_id").alias("entry"), "event_type")
    values = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), "o_totalprice")
    return integrity.join_index_data(names, values)


@query("SELECT entry FROM (SELECT event_id AS entry, CASE WHEN event_id % 11 = 0 THEN -1 ELSE 1 END AS a, CASE WHEN event_id % 22 = 0 THEN -1 ELSE 1 END AS b FROM events) WHERE (a < 0) <> (b < 0)")
def index_sign_conflicts(spark, sf_dir):
    sign = lambda n: F.when(F.col("event_id") % n == 0, -1).otherwise(1)
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("entry"), sign(11).alias("key_off"), sign(22).alias("value_off"))
    return integrity.sign_conflicts(rows).select("entry")


@query("SELECT run_id, entry FROM (SELECT l_orderkey // 100 AS run_id, l_orderkey * 10 + l_linenumber AS entry, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey * 10 + l_linenumber) AS b FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey)) WHERE b >= l_partkey")
def run_order_violations(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = rows.select(F.floor(F.col("l_orderkey") / 100).alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry"), "l_partkey")
    return integrity.order_violations(rows, "l_partkey", "run_id").select("run_id", "entry")


# Row table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), "p_name", "p_brand", "p_size")


_PARTS_SQL = "WITH parts AS (SELECT p_partkey AS row_no, p_name, p_brand, p_size FROM part)\n"


@query(
    _PARTS_SQL
    + """SELECT * FROM parts UNION ALL
SELECT (SELECT max(row_no) FROM parts) + row_number() OVER (ORDER BY s_name), s_name, 'new', 0 FROM supplier"""
)
def table_add_rows(spark, sf_dir):
    new = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("p_name"), F.lit("new").alias("p_brand"), F.lit(0).alias("p_size"))
    return table.add_rows(_parts(spark, sf_dir), new, "p_name")


@query(_PARTS_SQL + "SELECT CASE WHEN row_no = (SELECT max(row_no) FROM parts) THEN 17 ELSE row_no END AS row_no, p_name, p_brand, p_size FROM parts WHERE row_no <> 17")
def table_delete_row(spark, sf_dir):
    return table.delete_row(_parts(spark, sf_dir), 17)


@query(_PARTS_SQL + "SELECT * FROM parts WHERE row_no = 5")
def table_fetch_row(spark, sf_dir):
    return table.fetch(_parts(spark, sf_dir), 5)


@query(_PARTS_SQL + "SELECT * FROM parts ORDER BY p_size, p_name, row_no")
def table_sort(spark, sf_dir):
    return table.sort_rows(_parts(spark, sf_dir), "p_size", "p_name", "row_no")


@query(_PARTS_SQL + "SELECT p_size, row_no, p_name, p_brand FROM parts WHERE p_size IN (3, 7)")
def table_search_exact(spark, sf_dir):
    return table.search(_parts(spark, sf_dir), "p_size", spark.createDataFrame([(3,), (7,)], "probe int"))


@query("SELECT max(CASE WHEN p_retailprice <= 1000.5 THEN p_retailprice END) AS at_or_below, min(CASE WHEN p_retailprice > 1000.5 THEN p_retailprice END) AS above FROM part")
def table_search_nearest(spark, sf_dir):
    return table.search_nearest(read(spark, sf_dir, "part"), "p_retailprice", 1000.5)


@query(_PARTS_SQL + "SELECT row_no, p_name, p_brand, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY row_no) AS rn FROM parts) WHERE rn = 1")
def table_weed(spark, sf_dir):
    return table.weed(_parts(spark, sf_dir), ["p_brand", "p_size"])


@query(_PARTS_SQL + "SELECT count(*) AS n_rows, count(*) - count(DISTINCT (p_brand, p_size)) AS removed FROM parts")
def table_weed_count(spark, sf_dir):
    return table.weeded_count(_parts(spark, sf_dir), ["p_brand", "p_size"])


@query("SELECT s, coalesce(sum(strlen(s) + 1) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT DISTINCT source AS s FROM documents WHERE source IS NOT NULL)")
def string_bank(spark, sf_dir):
    return table.string_bank(read(spark, sf_dir, "documents"), "source")


# Text


@query("SELECT page_id, t.pos AS pos, t.token FROM pages, LATERAL (SELECT unnest(x) AS token, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT list_filter(regexp_split_to_array(url, '[/\\\\]+'), lambda y: y <> '') AS x)) t")
def tokenise_path(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(text.path_tokens(F.col("url"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT substr(w, 1, d) AS prefix, d AS depth, count(*) AS n_words, bool_or(substr(w, 1, d) = w) AS is_word FROM (SELECT w, unnest(range(1, length(w) + 1)) AS d FROM (SELECT DISTINCT p_type AS w FROM part WHERE p_type <> '')) GROUP BY 1, 2")
def trie_prefix_counts(spark, sf_dir):
    return text.trie(read(spark, sf_dir, "part"), "p_type")


@query("SELECT count(*) AS n_nodes, max(d)::BIGINT AS depth FROM (SELECT DISTINCT substr(w, 1, d) AS p, d FROM (SELECT w, unnest(range(1, length(w) + 1)) AS d FROM (SELECT DISTINCT p_type AS w FROM part WHERE p_type <> '')))")
def trie_statistics(spark, sf_dir):
    return text.trie(read(spark, sf_dir, "part"), "p_type").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))


@query(
    """WITH RECURSIVE last AS (SELECT p_type AS w, max(p_partkey) AS value FROM part WHERE p_type <> '' GROUP BY 1),
nodes AS (SELECT DISTINCT substr(w, 1, d) AS prefix, d FROM (SELECT w, unnest(range(1, length(w) + 1)) AS d FROM last))
SELECT n.prefix, n.d AS depth, l.w IS NOT NULL AS is_word, l.value FROM nodes n LEFT JOIN last l ON l.w = n.prefix"""
)
def trie_set_values(spark, sf_dir):
    return text.trie_values(read(spark, sf_dir, "part"), "p_type", "p_partkey", "p_partkey")


@query("SELECT DISTINCT p_name AS w, p_name IN (SELECT p_type FROM part) AS found FROM part")
def trie_search(spark, sf_dir):
    words = text.trie(read(spark, sf_dir, "part"), "p_type")
    return text.trie_search(words, read(spark, sf_dir, "part").select(F.col("p_name").alias("w")), "w")


@query(_PARTS_SQL + "SELECT * FROM parts ORDER BY length(p_name), reverse(p_name), row_no")
def table_sort_by_key(spark, sf_dir):
    return table.sort_by_key(_parts(spark, sf_dir), lambda rows: rows.p_name.map(lambda x: f"{len(x):09d}{x[::-1]}"), "string")


@query(
    r"""SELECT doc_id, length(regexp_replace(text, '[^\x20-\x7e\n\r\t]', '', 'g')) / nullif(length(text), 0)::DOUBLE AS share,
       coalesce(length(regexp_replace(text, '[^\x20-\x7e\n\r\t]', '', 'g')) / nullif(length(text), 0)::DOUBLE > 0.8, false) AS printable FROM documents"""
)
def printable_ratio(spark, sf_dir):
    body = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.printable_share(body).alias("share"), text.is_printable(body).alias("printable"))


@query("SELECT doc_id, lower(hex(encode(substr(text, 1, 8)))) AS key_hex, coalesce(regexp_full_match(substr(text, 1, 8), '([0-9a-fA-F]{2})*'), false) AS is_hex FROM documents")
def hex_preview(spark, sf_dir):
    head = F.substring("text", 1, 8)
    return read(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(head.cast("binary"))).alias("key_hex"), F.coalesce(text.is_hex(head), F.lit(False)).alias("is_hex"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS head FROM documents")
def value_preview_40(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("head"))


@query("SELECT page_id, concat_ws('/', 'store', url) AS path, (ceil(strlen(html) / 8.0) * 8)::BIGINT AS slot FROM pages")
def object_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.object_path(F.col("url"), "store").alias("path"), hashing.align8(F.octet_length("html")).alias("slot"))


# Formats and callbacks


@query(_LOG_SQL + "SELECT k, v FROM live")
def json_map_roundtrip(spark, sf_dir):
    packed = formats.json_map(log.live(event_log(spark, sf_dir)).select("k", F.col("v").cast("string").alias("v")))
    pairs = packed.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return pairs.select("k", F.unbase64("v").cast("string").cast("double").alias("v"))


@query(_LOG_SQL + "SELECT k, true AS present FROM live")
def map_visited(spark, sf_dir):
    return log.keys(event_log(spark, sf_dir)).withColumn("present", F.lit(True))


@query(_LOG_SQL + "SELECT k, v + 1 AS v FROM live WHERE starts_with(k, 'click:')")
def map_callback_prefix(spark, sf_dir):
    def add_one(pairs: pd.DataFrame) -> pd.DataFrame:
        return pairs.assign(v=pairs.v + 1)

    return callbacks.map_prefix(event_log(spark, sf_dir), "click:", add_one, "k string, v double")


@query(_LOG_SQL + "SELECT k || '_new' AS k, v FROM live")
def map_callback_rename(spark, sf_dir):
    """Put every pair under a new name and delete the old one, from a scan of the log before the change."""

    def renamed(pairs: pd.DataFrame) -> pd.DataFrame:
        return pairs.assign(k=pairs.k + "_new")

    before = event_log(spark, sf_dir)
    added = callbacks.map_pairs(before, renamed, "k string, v double")
    return log.live(log.put(log.delete(before, log.keys(before)), added)).select("k", "v")


@query(_LOG_SQL + ", live_first AS (SELECT min(k) AS k FROM live WHERE v > 99) SELECT l.k, l.v FROM live l, live_first f WHERE f.k IS NULL OR l.k <= f.k")
def map_scan_until(spark, sf_dir):
    return callbacks.scan_until(event_log(spark, sf_dir), F.col("v") > 99)


@query(_LOG_SQL + "SELECT k, seq, v, deleted FROM latest")
def stream_latest_state(spark, sf_dir):
    """The newest rows of the log, computed by a stream over its files into state on shared storage."""
    events = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    key = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    gone = (F.col("event_type") == "error") | (F.col("value") < 20)
    return streaming.replay_stream(log.build_log(stream, key, F.col("event_id"), F.col("value"), gone))


# Stores: the log written by a sink and read back


def _stored(spark: SparkSession, sf_dir: str, kind: str, write: Callable[..., None], **options: int) -> DataFrame:
    path = files.shared_folder(spark, kind)
    rows = event_log(spark, sf_dir)
    write(rows.withColumn("v", F.col("v").cast("string")), path, SHARDS, **options)
    back = backends.sharded(kind)(spark, path)
    return back.select(F.col("k").cast("string").alias("k"), "seq", F.col("v").cast("string").cast("double").alias("v"), "deleted")


@query(_LOG_SQL + "SELECT k, v FROM live")
def extent_store_roundtrip(spark, sf_dir):
    return log.live(_stored(spark, sf_dir, "extent", formats.write_extent)).select("k", "v")


@query(_LOG_SQL + "SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq) AS version_no FROM log WHERE NOT deleted")
def timed_log_history(spark, sf_dir):
    return log.history(_stored(spark, sf_dir, "timed", formats.write_timed_log)).select("k", "v", "version_no")


@query(_LOG_SQL + "SELECT k, CASE WHEN NOT deleted THEN v END AS v, deleted FROM latest")
def single_file_store_roundtrip(spark, sf_dir):
    return _stored(spark, sf_dir, "store", formats.write_store, log_bytes=1 << 16).select("k", "v", "deleted")


@query("SELECT url AS k, html AS v FROM pages")
def object_store_roundtrip(spark, sf_dir):
    """An object a page, as several pages may share an address."""
    path = files.shared_folder(spark, "objects")
    formats.write_object_rows(read(spark, sf_dir, "pages").select(F.col("url").alias("k"), F.col("html").alias("v")), path)
    return formats.read_object_rows(spark, path).select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query(_LOG_SQL + "SELECT CASE WHEN deleted THEN 't:' ELSE 'd:' END || k AS k, seq, CASE WHEN NOT deleted THEN v END AS v FROM latest")
def tier_records(spark, sf_dir):
    return tiers.to_records(event_log(spark, sf_dir))


@query(_LOG_SQL + "SELECT k, v FROM live WHERE starts_with(k, 'view:')")
def tier_records_prefix(spark, sf_dir):
    records = tiers.to_records(event_log(spark, sf_dir))
    return log.live(tiers.from_records(records.where(F.substring("k", 3, 5) == "view:"))).select("k", "v")


@query(
    _LOG_SQL.replace("WITH log", "WITH RECURSIVE log")
    + f""", sharded AS (SELECT k, seq, CASE WHEN deleted THEN 0 ELSE strlen(k) + 8 END AS n, ({_HASH_SQL.format(k="k")} % {SHARDS})::INT AS shard FROM log),
summed AS (SELECT shard, k, seq, sum(n) OVER (PARTITION BY shard ORDER BY seq) AS c FROM sharded),
runs AS (
  SELECT DISTINCT shard, 0::BIGINT AS run_id, -1::BIGINT AS start, 0::HUGEINT AS base FROM sharded
  UNION ALL
  SELECT r.shard, r.run_id + 1, min(s.seq), min(s.c) FROM runs r JOIN summed s ON s.shard = r.shard AND s.seq > r.start AND s.c >= r.base + 2048
  GROUP BY r.shard, r.run_id)
SELECT s.k, s.seq, s.shard, max(r.run_id) AS run_id FROM summed s JOIN runs r ON r.shard = s.shard AND r.start < s.seq GROUP BY s.k, s.seq, s.shard"""
)
def flush_runs(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("bytes", (F.octet_length("k") + 8).cast("long"))
    return tiers.flush_runs(rows, 2048, SHARDS)


@query()
def run_checksums(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("run_id", F.floor(F.col("seq") / 1000))
    return tiers.run_checksums(rows.withColumn("v", F.col("v").cast("string")), "run_id", "k", "v")


@query("SELECT count(*) AS n_records, sum(ceil(strlen(coalesce(text, '')) / 8.0) * 8)::BIGINT AS used, (1000000000000 - sum(ceil(strlen(coalesce(text, '')) / 8.0) * 8))::BIGINT AS free, sum(ceil(strlen(coalesce(text, '')) / 8.0) * 8)::BIGINT * 100.0::DOUBLE / 1000000000000 AS used_percent FROM documents")
def pool_statistics(spark, sf_dir):
    return integrity.pool_statistics(_sized(spark, sf_dir), 1_000_000_000_000)


@query("SELECT event_id FROM events WHERE event_id % 13 = 5")
def guard_violations(spark, sf_dir):
    front = F.col("event_id") * 7919
    rows = read(spark, sf_dir, "events").select("event_id", front.alias("front"), hashing.guard(front).alias("rear"))
    damaged = rows.withColumn("rear", F.when(F.col("event_id") % 13 == 5, F.col("rear") + 1).otherwise(F.col("rear")))
    return integrity.guard_violations(damaged, "front", "rear").select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id + strlen(coalesce(text, '')) > 2000")
def records_beyond_file(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return integrity.beyond(rows, "doc_id", "n", F.lit(2000)).select("doc_id")
