"""Streams in several triggers, and after a restart."""

from pyspark.sql import functions as F

from tidelog.operators.changefeed import EqualityDeleteTable
from tidelog.streaming import streams as T

SCHEMA = "store_id bigint, key string, value binary, tombstone boolean, ts bigint, seq bigint, file_name string, file_offset bigint"


def put(spark, path, rows):
    spark.createDataFrame([(1, k, bytearray(b"v"), t, ts, i, "a", i) for i, (k, t, ts) in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_upserts_over_triggers_and_restarts(spark, tmp_path):
    src, root, cp = (str(tmp_path / x) for x in ("src", "table", "cp"))
    put(spark, src, enumerate([("a", False, 1), ("b", False, 5)]))
    put(spark, src, enumerate([("b", True, 3), ("c", False, 1)], 2))
    T.upsert_once(T.source(spark, src, SCHEMA, 1), root, cp)
    read = lambda: sorted((r["key"], r["ts"]) for r in EqualityDeleteTable(spark, root).read().collect())
    assert read() == [("a", 1), ("b", 5), ("c", 1)]
    put(spark, src, enumerate([("c", True, 2), ("a", False, 0), (None, False, 9)], 4))
    T.upsert_once(T.source(spark, src, SCHEMA, 1), root, cp)
    assert read() == [("a", 1), ("b", 5)]


def test_bucket_state_outlives_a_trigger(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for n in range(2):
        put(spark, src, enumerate([("k", False, 100 + n)] * 2, 2 * n))
    T.run_once(T.token_bucket(T.source(spark, src, SCHEMA, 1), "key", "ts", 3, 1000), out, cp)
    got = spark.read.parquet(f"{out}/batch=*").agg(F.sum("n"), F.sum("allowed"), F.countDistinct("window_start")).first()
    assert tuple(got) == (4, 3, 1)


def test_windows_of_many_unordered_files_lose_nothing(spark, tmp_path):
    from tidelog.plans.streams import stream_windows

    at = str(tmp_path / "events.parquet")
    for i in range(12):  # the newest hours come first, in more files than a trigger takes
        spark.createDataFrame([(f"2024-01-01 {23 - i:02d}:30:00", "view")], "ts string, event_type string").coalesce(1).write.mode("append").parquet(at)
    got = stream_windows(spark, str(tmp_path)).agg(F.count("*"), F.sum("n")).first()
    assert tuple(got) == (12, 12)
