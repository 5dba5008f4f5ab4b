"""Point operations and scans on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import lww as L
from tidelog.operators import scans as S
from tidelog.schema import CHANGELOG, reserved

RANGE = "1@0 2@0 4@0T 3@3 5@0 8@0 1@0 2@0 3@5 1@0 5@4 8@3 3@2 6@1"
PREFIX = "aaa@15 aab@12T aabbc@13 aabbc@16 aabaa@0 aabaca@9 aabbccdd@10 aacda@14 csdasd@5 aab@5T aabcay@4 aabbs@3 aabacav@2 adsadf@1"
RESERVED = "__BF_mojfilter __HLL_mojhajperloglog __a __SH_mojsimhes __Hll __CMS_mojcms adasda babva 352523 dasda basd __TB_RATE_LIMIT__ _a_a _CMS"


def changelog(spark, text):
    rows = []
    for i, w in enumerate(text.split()):
        k, _, t = w.partition("@")
        rows.append((k, None, t.endswith("T"), int(t.rstrip("T") or 0), i))
    return spark.createDataFrame(rows, CHANGELOG)


def keys(df):
    return [f"{r['key']}@{r['ts']}" for r in df.orderBy("key").collect()]


def test_range_keeps_newest_and_tombstones(spark):
    df = changelog(spark, RANGE).where("key BETWEEN '2' AND '8'")
    assert keys(L.lww(df)) == ["2@0", "3@5", "4@0", "5@4", "6@1", "8@3"]
    assert keys(S.range_scan(changelog(spark, RANGE), "2", "8")) == ["2@0", "3@5", "5@4", "6@1", "8@3"]


def test_no_hits(spark):
    df = changelog(spark, RANGE)
    assert S.range_scan(df, "A", "F").count() == 0
    assert S.range_scan(df, "8", "2").count() == 0
    assert S.prefix_scan(df, "xyz").count() == 0


def test_prefix(spark):
    got = L.lww(changelog(spark, PREFIX).where(S.prefix_filter("aab")))
    assert keys(got) == ["aab@12", "aabaa@0", "aabaca@9", "aabacav@2", "aabbc@16", "aabbccdd@10", "aabbs@3", "aabcay@4"]


def test_reserved_keys_stay_out_of_scans(spark):
    df = changelog(spark, RESERVED)
    assert [k.split("@")[0] for k in keys(S.prefix_scan(df, "_"))] == ["_CMS", "__Hll", "__a", "_a_a"]
    assert len(keys(S.range_scan(df, "_", "b"))) == 5
    assert reserved("__SH_x") and not reserved("__Hll")


def test_ties_nulls_and_empty_values(spark):
    rows = [("a", b"1", False, 5, 1), ("a", b"2", False, 5, 2), (None, b"x", False, 9, 3), ("b", b"", False, 1, 4), ("c", b"v", None, None, 5), ("d", b"v", False, 2, 6), ("d", None, True, 2, 7)]
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, t, ts, s) for k, v, t, ts, s in rows], CHANGELOG)
    got = {r["key"]: bytes(r["value"]) for r in L.live(df).collect()}
    assert got == {"a": b"2", "b": b"", "c": b"v"}


def test_lww_does_not_depend_on_columns_that_clash(spark):
    df = changelog(spark, "a@1 a@2 b@1").withColumn("r", F.lit(1))
    assert keys(L.lww(df)) == ["a@2", "b@1"]


def test_empty_table(spark):
    df = spark.createDataFrame([], CHANGELOG)
    assert L.live(df).count() == 0 and S.page(S.prefix_scan(df, ""), 1, 5).count() == 0 and S.first(df).count() == 0


def test_multi_get_and_overlays(spark):
    df = changelog(spark, "a@1 b@1 b@2T c@1")
    asked = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "key string")
    assert {r["key"]: r["present"] for r in L.multi_get(df, asked).collect()} == {"a": True, "b": False, "z": False}
    gone = spark.createDataFrame([("a", True, 9, 9)], "key string, tombstone boolean, ts bigint, seq bigint")
    assert keys(L.live(L.overlay(df, gone))) == ["c@1"]


def test_pages(spark):
    df = L.live(changelog(spark, "a@1 b@1 c@1 d@1 e@1"))
    assert [r["key"] for r in S.page(df, 2, 2).collect()] == ["c", "d"]
    assert [r["key"] for r in S.page(df, 3, 2).collect()] == ["e"]
    assert S.page(df, 4, 2).count() == 0
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            S.page(df, *bad)


def test_cursor_ends_and_stops(spark):
    df = L.live(changelog(spark, "b@1 a@1 c@1"))
    c = S.Cursor(df)
    assert [c.next()[0] for _ in range(4)] == ["a", "b", "c", ""]
    c = S.Cursor(df)
    c.next()
    c.stop()
    assert c.next() == ("", None)
    assert [k for k, _ in S.Cursor(df)] == ["a", "b", "c"]


def test_seeks(spark):
    df = L.live(changelog(spark, "b@1 d@1 f@1"))
    assert S.ceiling(df, "c").first()["key"] == "d" and S.floor(df, "c").first()["key"] == "b"
    assert S.ceiling(df, "d").first()["key"] == "d" and S.ceiling(df, "g").count() == 0 and S.floor(df, "a").count() == 0
