"""Queries that read their table as a stream, until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import cms as K
from tidelog.operators.changefeed import EqualityDeleteTable
from tidelog.operators.lww import lww
from tidelog.plans.kv import BY, ORDER, live_sql
from tidelog.plans.sketches import CC, CR, SECONDS, SEED, TOKENS
from tidelog.plans.sketches import ORACLE as SKETCHES
from tidelog.session import shared_path
from tidelog.streaming import streams as T


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    return T.source(spark, path, spark.read.parquet(path).schema)


def _ended(spark, stream, name, mode):
    path = shared_path(spark, name)
    T.run_once(stream, path, path + ".checkpoint", mode)
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def stream_lww(spark, d):
    """Newest row of each key from the updates of a streaming aggregation."""
    rows = _stream(spark, d, "wal_records").select("store_id", "key", "tombstone", "ts", "seq", "file_name", "file_offset")
    got = _ended(spark, T.lww_state(rows, BY, ORDER), "stream-lww", "update")
    return lww(got, BY, (*ORDER, "batch")).where("NOT tombstone").select("store_id", "key", "ts", "seq")


def stream_upsert(spark, d):
    """Live state of an equality-delete table that a stream of changes was written to."""
    root = shared_path(spark, "stream-upsert")
    T.upsert_once(_stream(spark, d, "wal_records"), root, root + ".checkpoint")
    return EqualityDeleteTable(spark, root).read().select("store_id", "key", "ts", "seq", F.hex("value").alias("value_hex"))


def stream_cms(spark, d):
    """Count-Min cells after a stream of line items."""
    got = _ended(spark, T.cms_cells(_stream(spark, d, "lineitem"), "l_partkey", CR, CC, SEED), "stream-cms", "update")
    return got.groupBy("row", "col").agg(F.max("cnt").alias("cnt"))


def stream_token_bucket(spark, d):
    """Admitted events of each user and second, the buckets being streaming state."""
    rows = _stream(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return _ended(spark, T.token_bucket(rows, "user_id", "ts", TOKENS, SECONDS), "stream-bucket", "append").select("limiter", "ts", "n", "window_start", "allowed")


def stream_windows(spark, d):
    """Events of each type in tumbling hours."""
    rows = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    got = _ended(spark, T.windowed_counts(rows, "at", "event_type", late=None), "stream-windows", "update")
    return got.groupBy(F.unix_timestamp("window_start").alias("hour"), "event_type").agg(F.max("n").alias("n"))


QUERIES = {f.__name__: f for f in (stream_lww, stream_upsert, stream_cms, stream_token_bucket, stream_windows)}
ORACLE = {
    "stream_lww": f"SELECT store_id, key, ts, seq FROM ({live_sql()})",
    "stream_upsert": f"SELECT store_id, key, ts, seq, hex(value) AS value_hex FROM ({live_sql()})",
    "stream_cms": SKETCHES["cms_build"],
    "stream_token_bucket": SKETCHES["token_bucket_admit"],
    "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
