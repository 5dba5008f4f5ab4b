"""Compaction, indexes, running values, dictionary and Merkle trees on small fixtures."""

import hashlib
import random
from collections import Counter, OrderedDict

import pytest
from pyspark.sql import functions as F

from tidelog.functions.encoding import le8, record_crc, record_size, uvarint_size
from tidelog.operators import compaction as C
from tidelog.operators import dictionary as D
from tidelog.operators import limiter, lru
from tidelog.operators import merkle as M
from tidelog.operators import skew
from tidelog.operators.ordered import asof, running

SCHEMA = "store_id bigint, level int, table_id int, key string, value string, tombstone boolean, ts bigint"


def runs(spark, *tables):
    rows = [(1, level, label, k, v, v is None, ts) for level, label, recs in tables for k, v, ts in recs]
    return spark.createDataFrame(rows, SCHEMA)


def test_level_precedence_and_lww(spark):
    df = runs(spark, (2, 1, [("key1", "value1", 1), ("key2", "value22", 3), ("key3", "value3", 4)]), (1, 1, [("key3", "value33", 5), ("key4", "value4", 6)]))
    want = {"key1": "value1", "key2": "value22", "key3": "value33", "key4": "value4"}
    assert {r["key"]: r["value"] for r in C.newest(df).collect()} == want
    assert {r["key"]: r["value"] for r in C.level_read(df).collect()} == want


def test_merge_same_and_disjoint_keys(spark):
    a = runs(spark, (1, 1, [("key1", "value1", 1), ("key2", "value2", 2)]))
    b = runs(spark, (1, 2, [("key2", "value3", 3), ("key3", "value4", 4)]))
    assert {r["key"]: r["value"] for r in C.merge(a, b).collect()} == {"key1": "value1", "key2": "value3", "key3": "value4"}


def test_size_tiered_cascade(spark):
    df = runs(spark, *[(1, i, [("key1", "a", 1), ("key2", "b", 2)]) for i in range(1, 5)])
    got = C.compact_size_tiered(df, 2, 3)
    assert {(r["level"], r["table_id"]) for r in got.collect()} == {(3, 1)} and got.count() == 2


def simulate(counts, most, levels):
    """Runs per level by doing one merge after the other."""
    n = dict(counts)
    level = 1
    while level < levels:
        here = n.get(level, 0)
        if here == 0 or level == 1 and (here == 1 or here < most):
            return n
        while n[level] >= most and n[level] != 1:
            n[level] -= 2
            n[level + 1] = n.get(level + 1, 0) + 1
        level += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_size_tiered_plan_equals_single_merges(spark, seed):
    rng = random.Random(seed)
    stores = {s: {lv: rng.choice([0, 1, 2, 3, 7, 8, 9, 20]) for lv in range(1, 5)} for s in range(12)}
    most = rng.choice([2, 3, 4, 8])
    rows = [(s, lv, i + 1) for s, c in stores.items() for lv, n in c.items() for i in range(n)]
    plan = C.size_tiered_plan(spark.createDataFrame(rows, "store_id bigint, level int, table_id int"), most, 4)
    got = {(r["store_id"], r["to_level"]): r["n"] for r in plan.groupBy("store_id", "to_level").agg(F.countDistinct("to_table").alias("n")).collect()}
    want = {(s, lv): n for s, c in stores.items() for lv, n in simulate(c, most, 4).items() if n}
    assert got == want


def test_leveled_budgets_and_disjoint_runs(spark):
    rng = random.Random(3)
    tables = [(lv, t, [(f"k{rng.randrange(400):04d}", rng.choice(["v", "w", None]), rng.randrange(10_000)) for _ in range(40)]) for lv, t in ((1, 1), (1, 2), (1, 3), (2, 1), (3, 1))]
    df = runs(spark, *tables).dropDuplicates(["level", "table_id", "key"]).withColumn("size", F.lit(10))
    got = C.compact_leveled(df, "size", first=100, fanout=3, max_level=4, block=150)
    live = lambda x: {(r["key"], r["ts"]) for r in C.newest(x).where("NOT tombstone").collect()}
    assert live(got) == live(df)
    size = {r["level"]: r["b"] for r in got.groupBy("level").agg(F.sum("size").alias("b")).collect()}
    assert size.get(1, 0) <= 100 and size.get(2, 0) <= 300 and size.get(3, 0) <= 900
    spans = {}
    for r in got.groupBy("level", "table_id").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.sum("size").alias("b")).collect():
        spans.setdefault(r["level"], []).append((r["a"], r["z"], r["b"]))
    for s in spans.values():
        s.sort()
        assert all(x[1] < y[0] for x, y in zip(s, s[1:]))
        assert all(b <= 160 for *_, b in s)


@pytest.mark.parametrize("upper", [(1, 2), (2, 2)])
def test_a_tombstone_stays_while_an_older_put_can_lie_outside_the_merge(spark, upper):
    """Level 3 goes to the last level; the put of k is older than the tombstone, but in a level above it."""
    late = (*upper, [("k", "late", 5)])
    df = runs(spark, (3, 1, [("a", "x", 1), ("k", None, 10), ("z", None, 10)]), (3, 2, [("zz", "y", 1)]), late).withColumn("size", F.lit(100))
    live = lambda x: {(r["key"], r["ts"]) for r in C.newest(x).where("NOT tombstone").collect()}
    got = C.compact_leveled(df, "size", first=100, fanout=1, max_level=4, block=150)
    assert live(got) == live(df) == {("a", 1), ("zz", 1)}
    assert {r["key"] for r in got.where("tombstone").collect()} == {"k"}  # that of z is gone


def test_union_of_ranges():
    assert C.union_of_ranges([(5, 6), (1, 2), (2, 4), (8, 8), (1, 1)]) == [(1, 4), (5, 6), (8, 8)]
    runs_ = [{"s": a, "e": z} for a, z in ((1, 2), (4, 6), (7, 9))]
    assert C._meeting(runs_, [{"s": 2, "e": 3}, {"s": 9, "e": 12}]) == [runs_[0], runs_[2]] and C._meeting(runs_, []) == []


def test_overlap_counts_equal_pairs(spark):
    rng = random.Random(5)
    rows = []
    for lv in (1, 2, 3):
        for t in range(15):
            a, b = sorted(rng.randrange(50) for _ in range(2))
            rows.append((1, lv, t, f"{a:02d}", f"{b:02d}", rng.randrange(9)))
    df = spark.createDataFrame(rows, "store_id bigint, level int, table_id int, start_key string, end_key string, bytes bigint")
    got = {(r["level"], r["table_id"]): (r["overlaps"], r["overlap_bytes"]) for r in C.overlap_counts(df).collect()}
    for _, lv, t, a, b, _ in rows:
        hit = [x for x in rows if x[1] == lv + 1 and x[3] <= b and x[4] >= a]
        assert got[lv, t] == (len(hit), sum(x[5] for x in hit))


def test_running_sums_by_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(9) if i % 7 else None) for i in range(5000)]
    got = running(spark.createDataFrame(rows, "g string, i int, v bigint").repartition(7), ["g", "i"], "v", ["g"]).collect()
    at = {(r["g"], r["i"]): (r["idx"], r["before"], r["group_rows"]) for r in got}
    for g in "ab":
        total = 0
        mine = [x for x in rows if x[0] == g]
        for n, (_, i, v) in enumerate(mine):
            assert at[g, i] == (n, total, len(mine))
            total += v or 0


def test_running_repeats_only_heavy_groups(spark, monkeypatch):
    # as with more groups than may be broadcast
    monkeypatch.setattr(skew, "at_most", lambda df, rows: False)
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 400}", i) for i in range(1200)] + [(None, 1)]
    df = running(spark.createDataFrame(rows, "g string, i int").repartition(7), ["g", "i"], None, ["g"])
    got = {(r["g"], r["i"]): (r["idx"], r["group_rows"]) for r in df.collect()}
    assert got == {(g, i): (i, 3000) if g == "hot" else (i // 400, 3) for g, i in rows if g}
    assert "explode(CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()


def test_running_on_nothing(spark):
    assert running(spark.createDataFrame([], "g string, v bigint"), ["g"], "v", ["g"]).count() == 0


@pytest.mark.parametrize("backward", [True, False])
def test_asof(spark, backward):
    rng = random.Random(2)
    entries = [(rng.choice("xy"), rng.randrange(300)) for _ in range(200)]
    probes = [(rng.choice("xyz"), rng.choice([None, rng.randrange(320)])) for _ in range(400)]
    mk = lambda r: spark.createDataFrame(r, "g string, k int").repartition(5)
    got = sorted(((r["g"], r["k"], r["match"]) for r in asof(mk(probes), mk(entries), ["g"], "k", backward).collect()), key=str)
    want = []
    for g, k in probes:
        ks = [] if k is None else [e for h, e in entries if h == g and (e <= k if backward else e >= k)]
        want.append((g, k, (max if backward else min)(ks) if ks else None))
    assert got == sorted(want, key=str)


def test_record_encoding(spark):
    df = spark.createDataFrame([("key1", bytearray(b"value1"), False, 1), ("key2", None, True, 2)], "key string, value binary, tombstone boolean, ts bigint")
    got = df.select(record_crc(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("c"), record_size(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("s")).collect()
    assert [r["c"] for r in got] == [2628099071, 3327733903] and got[0]["s"] == 18
    sizes = spark.createDataFrame([(0,), (127,), (128,), (16383,), (16384,), (1 << 62,), ((1 << 63) - 1,)], "x bigint")
    assert [r[0] for r in sizes.select(uvarint_size(F.col("x"))).collect()] == [1, 1, 2, 2, 3, 9, 9]
    assert bytes(sizes.limit(2).select(le8(F.col("x"))).collect()[1][0]) == (127).to_bytes(8, "little")


def test_dictionary(spark):
    rows = [("b", 1), ("a", 2), ("b", 3), (None, 4), ("c", 2)]
    df = spark.createDataFrame(rows, "key string, seq bigint")
    dic = D.build(df)
    assert {r["key"]: r["idx"] for r in dic.collect()} == {"b": 0, "a": 1, "c": 2}
    more = df.unionByName(spark.createDataFrame([("zz", 9)], "key string, seq bigint"))
    coded = D.encode(more, dic)
    assert Counter((r["seq"], r["idx"]) for r in coded.collect()) == Counter([(1, 0), (2, 1), (3, 0), (4, None), (2, 2), (9, -1)])
    back = sorted(((r["seq"], r["key"]) for r in D.decode(coded, dic).collect()), key=str)
    assert back == sorted(((s, None if k == "zz" else k) for k, s in [*rows, ("zz", 9)]), key=str)


def merkle(chunks):
    level = [hashlib.sha1(hashlib.sha1(c).digest()).digest() for c in chunks]
    nodes, k = {(0, i): h for i, h in enumerate(level)}, 0
    while k == 0 or len(level) > 1:
        level = [hashlib.sha1(level[i] + (level[i + 1] if i + 1 < len(level) else bytes(20))).digest() for i in range(0, len(level), 2)]
        k += 1
        nodes |= {(k, i): h for i, h in enumerate(level)}
    return nodes


@pytest.mark.parametrize("n", [1, 2, 3, 9, 33])
def test_merkle_tree(spark, n, monkeypatch):
    monkeypatch.setattr(M, "HEIGHT", 2)
    chunks = [f"chunk {i}".encode() * (i + 1) for i in range(n)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(chunks)], "idx bigint, chunk binary")
    nodes = M.tree(df)
    want = merkle(chunks)
    assert {(r["level"], r["idx"]): bytes(r["hash"]) for r in nodes.collect()} == want
    top = max(want)
    assert M.root(nodes).first()["root"] == want[top].hex()
    assert M.diff(nodes, M.tree(df)).count() == 0
    other = M.tree(df.withColumn("chunk", F.when(F.col("idx") == n - 1, F.lit(b"x")).otherwise(F.col("chunk"))))
    assert M.diff(nodes, other).count() == top[0] + 1
    assert M.contains(nodes, nodes.limit(1).select("hash")).count() == 1


def test_merkle_of_nothing(spark):
    df = spark.createDataFrame([], "idx bigint, chunk binary")
    assert M.tree(df).count() == 0 and M.root(M.tree(df)).count() == 0


def test_token_bucket(spark):
    rows = [("a", 100)] * 11 + [("a", 101)] + [("b", 5), ("b", 6), (None, 7), ("b", None)]
    got = {(r["limiter"], r["ts"]): (r["n"], r["window_start"], r["allowed"]) for r in limiter.admit(spark.createDataFrame(rows, "k string, t bigint"), "k", "t", 10, 1).collect()}
    assert got == {("a", 100): (11, 100, 10), ("a", 101): (1, 101, 1), ("b", 5): (1, 5, 1), ("b", 6): (1, 6, 1)}
    each = limiter.admit_each(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, t bigint, s int"), "k", "t", "s", 10, 1)
    assert [r["seq"] for r in each.where("NOT allowed").collect()] == [10]


def test_admit_each_repeats_only_heavy_seconds(spark, monkeypatch):
    monkeypatch.setattr(skew, "at_most", lambda df, rows: False)
    rows = [("a", 5, i) for i in range(500)] + [(f"k{i}", 7, i) for i in range(300)]
    df = limiter.admit_each(spark.createDataFrame(rows, "k string, t bigint, s int"), "k", "t", "s", 10, 1)
    assert sorted((r["limiter"], r["seq"], r["allowed"]) for r in df.collect()) == sorted((k, s, k != "a" or s < 10) for k, _, s in rows)
    # the groups of the places, and the seconds
    assert df._jdf.queryExecution().optimizedPlan().toString().count("explode(CASE WHEN") == 2


@pytest.mark.parametrize("capacity", [1, 3, 10])
def test_lru_hits(spark, capacity):
    rng = random.Random(capacity)
    seq = [rng.choice(["a", "b", "c", "d", f"k{rng.randrange(20)}", None]) for _ in range(2000)]
    got = lru.hits(spark.createDataFrame(list(enumerate(seq)), "i int, k string"), "k", ["i"], capacity, chunk=64, fan=2 if capacity == 3 else 64)
    cache, want = OrderedDict(), []
    for k in (x for x in seq if x is not None):
        want.append(k in cache)
        cache[k] = True
        cache.move_to_end(k)
        if len(cache) > capacity:
            cache.popitem(last=False)
    assert [r["hit"] for r in got.orderBy("idx").collect()] == want


def test_lru_of_nothing(spark):
    assert lru.hits(spark.createDataFrame([], "i int, k string"), "k", ["i"], 2).count() == 0


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_token_bucket_over_batches(spark, batch):
    """Windows that go on over batches, against one event after the other."""
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(200)) for _ in range(900)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["limiter"], r["ts"]): (r["window_start"], r["allowed"]) for r in limiter.admit(spark.createDataFrame(rows, "k string, t bigint"), "k", "t", 7, 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for k in "abc":
        begin, left = None, 0
        for t in sorted(t for x, t in rows if x == k):
            if begin is None or begin + 20 <= t:
                begin, left = t, 7
            want[k, t] = (begin, want.get((k, t), (0, 0))[1] + (left > 0))
            left -= left > 0
    assert got == want


def test_lru_cache():
    c = lru.Cache(3)
    for i, k in enumerate(("one", "two", "three", "four")):
        c.put(k, i)
    assert c.get("one") is None and c.get("four") == 3 and c.keys() == ["two", "three", "four"]
