"""Queries on keyed state: points, scans, cursors and seeks over the write-ahead log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import lww as L
from tidelog.operators import scans as S
from tidelog.operators.ordered import asof, running
from tidelog.schema import is_reserved
from tidelog.sources.tables import table

BY = ("store_id", "key")
ORDER = ("ts", "seq", "file_name", "file_offset")
OUT = ["store_id", "key", "ts", "seq", "hex(value) AS value_hex"]
RANGE = ("cart:", "metric:m")
PREFIX = "user:0000"
FAR = 9_999_999_999


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_records").select("store_id", "key", "value", "tombstone", "ts", "seq", "file_name", "file_offset")


def kv_snapshot(spark, d):
    """The live state of every store."""
    return L.live(log(spark, d), BY, ORDER).selectExpr(*OUT)


def kv_tombstones(spark, d):
    """Keys whose newest record is a delete."""
    return L.lww(log(spark, d), BY, ORDER).where("tombstone").select("store_id", "key", "ts", "seq")


def kv_get(spark, d):
    """One key, in every store."""
    return L.get(log(spark, d), "user:00000000", BY, ORDER).selectExpr(*OUT)


def kv_multi_get(spark, d):
    """The keys of the incoming records, found or not."""
    keys = table(spark, d, "incoming_records").where("key IS NOT NULL")
    return L.multi_get(log(spark, d), keys, BY, ORDER).select("store_id", "key", F.hex("value").alias("value_hex"), "present")


def kv_put_overlay(spark, d):
    """The state after the incoming records are written too."""
    return L.live(L.overlay(log(spark, d), table(spark, d, "incoming_records")), BY, ORDER).selectExpr(*OUT)


def kv_delete_overlay(spark, d):
    """The state after every cart is deleted."""
    base = log(spark, d)
    gone = base.where(S.prefix_filter("cart:")).select("store_id", "key").distinct()
    gone = gone.withColumn("tombstone", F.lit(True)).withColumn("ts", F.lit(FAR)).withColumn("seq", F.lit(FAR))
    return L.live(L.overlay(base, gone), BY, ORDER).selectExpr(*OUT)


def kv_range_scan(spark, d):
    return S.range_scan(log(spark, d), *RANGE, BY, ORDER).selectExpr(*OUT)


def kv_range_scan_page(spark, d):
    return S.page(S.range_scan(log(spark, d), *RANGE, BY, ORDER).select("key", "store_id", F.hex("value").alias("value_hex")), 3, 25, ("key", "store_id"))


def kv_prefix_scan(spark, d):
    return S.prefix_scan(log(spark, d), PREFIX, BY, ORDER).selectExpr(*OUT)


def kv_prefix_scan_page(spark, d):
    return S.page(S.prefix_scan(log(spark, d), PREFIX, BY, ORDER).select("key", "store_id", F.hex("value").alias("value_hex")), 2, 30, ("key", "store_id"))


AFTER = {"key": "cart:0", "store_id": 0}


def kv_range_scan_after(spark, d):
    """The 25 entries that follow a key of a range, whatever page that is."""
    got = S.range_scan(log(spark, d), *RANGE, BY, ORDER).select("key", "store_id", F.hex("value").alias("value_hex"))
    return S.page_after(got, AFTER, 25, ("key", "store_id"))


def kv_range_iterate(spark, d):
    """The order in which a cursor over a range gives each store's entries."""
    got = S.range_scan(log(spark, d), *RANGE, BY, ORDER).select("store_id", "key")
    return running(got, ["store_id", "key"], None, ["store_id"]).select("store_id", "key", "idx")


def kv_prefix_iterate(spark, d):
    got = S.prefix_scan(log(spark, d), "user:", BY, ORDER).select("store_id", "key")
    return running(got, ["store_id", "key"], None, ["store_id"]).select("store_id", "key", "idx")


def kv_reserved_filter(spark, d):
    """Live keys of each store, reserved and not."""
    return L.live(log(spark, d), BY, ORDER).groupBy("store_id", is_reserved(F.col("key")).alias("reserved")).agg(F.count(F.lit(1)).alias("keys"))


def _probes(spark, d):
    return table(spark, d, "incoming_records").where("key IS NOT NULL").select("store_id", "key").distinct()


def kv_seek_ceiling(spark, d):
    """For each incoming key the first live key of its store at or after it."""
    return asof(_probes(spark, d), L.live(log(spark, d), BY, ORDER), ["store_id"], "key", backward=False)


def kv_seek_floor(spark, d):
    """For each incoming key the last live key of its store at or before it."""
    return asof(_probes(spark, d), L.live(log(spark, d), BY, ORDER), ["store_id"], "key")


def kv_first(spark, d):
    """The first live user key over all stores."""
    return S.first(L.user_keys(L.live(log(spark, d), BY, ORDER))).select("key")


QUERIES = {f.__name__: f for f in (kv_snapshot, kv_tombstones, kv_get, kv_multi_get, kv_put_overlay, kv_delete_overlay, kv_range_scan, kv_range_scan_page, kv_range_scan_after, kv_prefix_scan, kv_prefix_scan_page, kv_range_iterate, kv_prefix_iterate, kv_reserved_filter, kv_seek_ceiling, kv_seek_floor, kv_first)}

_COLS = "store_id, key, value, tombstone, ts, seq, file_name, file_offset"
RESERVED_SQL = "(key = '__TB_RATE_LIMIT__' OR starts_with(key, '__BF_') OR starts_with(key, '__CMS_') OR starts_with(key, '__HLL_') OR starts_with(key, '__SH_'))"


def newest_sql(source: str = "wal_records", where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT {_COLS}, row_number() OVER (PARTITION BY store_id, key
  ORDER BY ts DESC NULLS LAST, seq DESC NULLS LAST, file_name DESC NULLS LAST, file_offset DESC NULLS LAST) AS rn
  FROM {source} WHERE key IS NOT NULL AND {where}) WHERE rn = 1"""


def live_sql(source: str = "wal_records", where: str = "true") -> str:
    return f"SELECT * FROM ({newest_sql(source, where)}) WHERE NOT tombstone"


_OUT = "SELECT store_id, key, ts, seq, hex(value) AS value_hex FROM"
_BETWEEN = f"key BETWEEN '{RANGE[0]}' AND '{RANGE[1]}' AND NOT {RESERVED_SQL}"
_LIKE = f"starts_with(key, '{PREFIX}') AND NOT {RESERVED_SQL}"
_PUT = f"(SELECT {_COLS} FROM wal_records UNION ALL SELECT store_id, key, value, tombstone, ts, seq, NULL, NULL FROM incoming_records)"
_DEL = f"(SELECT {_COLS} FROM wal_records UNION ALL SELECT DISTINCT store_id, key, NULL::BLOB, true, {FAR}, {FAR}, NULL, NULL FROM wal_records WHERE starts_with(key, 'cart:'))"
_IDX = "row_number() OVER (PARTITION BY store_id ORDER BY key) - 1 AS idx"
_PROBES = "(SELECT DISTINCT store_id, key FROM incoming_records WHERE key IS NOT NULL)"
ORACLE = {
    "kv_snapshot": f"{_OUT} ({live_sql()})",
    "kv_tombstones": f"SELECT store_id, key, ts, seq FROM ({newest_sql()}) WHERE tombstone",
    "kv_get": f"{_OUT} ({live_sql(where="key = 'user:00000000'")})",
    "kv_multi_get": f"SELECT p.store_id, p.key, hex(l.value) AS value_hex, l.key IS NOT NULL AS present FROM {_PROBES} p LEFT JOIN ({live_sql()}) l ON l.store_id = p.store_id AND l.key = p.key",
    "kv_put_overlay": f"{_OUT} ({live_sql(_PUT)})",
    "kv_delete_overlay": f"{_OUT} ({live_sql(_DEL)})",
    "kv_range_scan": f"{_OUT} ({live_sql(where=_BETWEEN)})",
    "kv_range_scan_page": f"SELECT key, store_id, hex(value) AS value_hex FROM ({live_sql(where=_BETWEEN)}) ORDER BY key, store_id LIMIT 25 OFFSET 50",
    "kv_range_scan_after": f"SELECT key, store_id, hex(value) AS value_hex FROM ({live_sql(where=_BETWEEN)}) WHERE key > '{AFTER['key']}' OR (key = '{AFTER['key']}' AND store_id > {AFTER['store_id']}) ORDER BY key, store_id LIMIT 25",
    "kv_prefix_scan": f"{_OUT} ({live_sql(where=_LIKE)})",
    "kv_prefix_scan_page": f"SELECT key, store_id, hex(value) AS value_hex FROM ({live_sql(where=_LIKE)}) ORDER BY key, store_id LIMIT 30 OFFSET 30",
    "kv_range_iterate": f"SELECT store_id, key, {_IDX} FROM ({live_sql(where=_BETWEEN)})",
    "kv_prefix_iterate": f"SELECT store_id, key, {_IDX} FROM ({live_sql(where=f"starts_with(key, 'user:') AND NOT {RESERVED_SQL}")})",
    "kv_reserved_filter": f"SELECT store_id, {RESERVED_SQL} AS reserved, count(*) AS keys FROM ({live_sql()}) GROUP BY ALL",
    "kv_seek_ceiling": f"SELECT p.store_id, p.key, e.key AS match FROM {_PROBES} p ASOF LEFT JOIN ({live_sql()}) e ON p.store_id = e.store_id AND p.key <= e.key",
    "kv_seek_floor": f"SELECT p.store_id, p.key, e.key AS match FROM {_PROBES} p ASOF LEFT JOIN ({live_sql()}) e ON p.store_id = e.store_id AND p.key >= e.key",
    "kv_first": f"SELECT min(key) AS key FROM ({live_sql(where=f'NOT {RESERVED_SQL}')})",
}
