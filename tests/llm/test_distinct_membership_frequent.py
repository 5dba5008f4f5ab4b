"""Distinct counts, membership and frequent items against exact versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import distinct as D
from tidelog.llm import frequent as Q
from tidelog.llm import membership as M

LOG = "store_id bigint, ts bigint, key string, day string"
DAY = 86_400


def log(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LOG)


def test_cells(spark):
    rows = [(1, 0, "a:b:c"), (1, DAY - 1, "plain"), (1, DAY, ":x"), (1, -1, "a:"), (1, None, "a:b"), (1, 5, None), (1, 5, "")]
    got = Counter((r["day"], r["namespace"]) for r in D.with_cells(log(spark, rows)).collect())
    assert got == Counter({("1970-01-01", "a"): 1, ("1970-01-01", ""): 2, ("1970-01-02", ""): 1, ("1969-12-31", "a"): 1})


def test_estimates_and_merges(spark):
    rows = [(s, DAY * d, f"n{i % 3}:{i}") for s in (1, 2) for d in (0, 1) for i in range(3000)]
    cells = D.with_cells(log(spark, rows))
    regs = D.registers(cells, ["store_id", "key"], D.DIMS)
    exact = {(None, None, None): 6000, ("1970-01-01", None, None): 6000, (None, "1", None): 3000, (None, None, "n0"): 2000, ("1970-01-01", "1", "n0"): 1000}
    got = {(r["day"] if r["over"][0] == "0" else None, r["store_id"] if r["over"][1] == "0" else None, r["namespace"] if r["over"][2] == "0" else None): r for r in D.estimates(D.cube(regs, D.DIMS), [*D.DIMS, "over"]).collect()}
    assert len(got) == 3 * 3 * 4
    for cell, n in exact.items():
        assert abs(got[cell]["estimate"] - n) < 4 * D.standard_error() * n
    assert got[None, None, None]["rows"] == 12_000
    halves = [D.registers(cells.where(c), ["store_id", "key"], D.DIMS) for c in ("key < 'n1:2'", "key >= 'n1:2'")]
    assert D.merge(halves[0].unionByName(halves[1]), D.DIMS).exceptAll(regs.select(*D.DIMS, "bucket", "rank", "rows")).count() == 0


@pytest.mark.parametrize("p", [4, 10, 16])
def test_error_is_as_stated(spark, p):
    n = 50_000
    df = spark.range(n).select(F.lit("g").alias("g"), "id")
    r = D.estimates(D.registers(df, ["id"], ["g"], p), ["g"], p).first()
    assert abs(r["estimate"] - n) < 4 * r["std_error"] and r["std_error"] == pytest.approx(r["estimate"] * D.standard_error(p))
    with pytest.raises(ValueError):
        D.registers(df, ["id"], ["g"], 17)


def test_mostly_distinct_at_its_edge(spark):
    rows = []
    for cell, (n, k) in enumerate([(30, 24), (30, 23), (29, 29), (1000, 800), (1000, 799), (5000, 4999), (400, 10)]):
        rows += [(cell, 0, f"a:{i % k}") for i in range(n)]
    rows += [(50, 0, f"{i % 2}x:{i}") for i in range(40)] + [(51, 0, f"*:{i}") for i in range(31)]
    df = log(spark, rows)
    regs = D.registers(D.with_cells(df), ["store_id", "key"], D.DIMS)
    got = sorted((r["store_id"], r["namespace"]) for r in D.mostly_distinct(df, regs).collect())
    assert got == sorted([(c, ns) for c in (0, 3, 5) for ns in ("a", "*")] + [(50, "*"), (51, "*"), (51, "*")])
    empty = log(spark, [])
    assert D.mostly_distinct(empty, D.registers(D.with_cells(empty), ["store_id", "key"], D.DIMS)).count() == 0


@pytest.mark.parametrize("broadcast_words", [1 << 20, 0])
@pytest.mark.parametrize("bits", [16, 1])
def test_seen_before_equals_brute_force(spark, broadcast_words, bits):
    rng = random.Random(bits)
    known = [(rng.randrange(3), f"k{rng.randrange(300)}".encode()) for _ in range(500)] + [(1, b"hot")] * 300
    new = [(rng.randrange(3), f"k{rng.randrange(900)}", i) for i in range(1500)]
    new += [(0, "hot", 1500 + i) for i in range(700)] + [(0, None, 9000), (0, None, 9001), (0, "", 9002), (0, "", 9003), (1, "HOT", 9004), (1, "hot ", 9005), (2, "tie", 9100), (2, "tie", 9100)]
    rng.shuffle(new)
    k = spark.createDataFrame([(s, bytearray(x), "x") for s, x in known], "store_id bigint, key binary, seq string")
    n = spark.createDataFrame(new, "store_id bigint, key string, seq bigint")
    got = M.seen_before(k, n, bits, broadcast_words)
    old = set(known)
    want = sorted(q for s, x, q in new if x is not None and ((s, x.encode()) in old or any(t == s and y == x and r < q for t, y, r in new)))
    assert sorted(r["seq"] for r in got.found.collect()) == want
    counts = Counter((s, x) for s, x, _ in new if x is not None)
    member = {(s, x) for s, x in counts if (s, x.encode()) in old or counts[s, x] > 1}
    wrong = got.verified.where("NOT in_filter").count()
    assert got.verified.where("in_filter").count() == sum(counts[m] for m in member)
    assert got.incoming == sum(counts.values()) and (wrong < 0.05 * got.incoming if bits == 16 else wrong > 0)


def test_seen_before_with_empty_sides(spark):
    k = spark.createDataFrame([], "store_id bigint, key binary")
    n = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "store_id bigint, key string, seq bigint")
    assert [r["seq"] for r in M.seen_before(k, n).found.collect()] == [2]
    assert M.seen_before(k, n.limit(0)).found.count() == 0


def test_batches_against_an_index_on_disk(spark, tmp_path, monkeypatch):
    """Batch after batch equals one look at everything; a batch reads only the buckets of its positives, also after parts are put together."""
    monkeypatch.setattr(M, "MOST_PARTS", 2)
    rng = random.Random(1)
    known = [(rng.randrange(3), f"k{rng.randrange(200)}".encode()) for _ in range(300)]
    index = M.KeyIndex(spark, str(tmp_path / "i")).create(spark.createDataFrame([(s, bytearray(x)) for s, x in known], "store_id bigint, key binary"))
    have = set(known)
    for n in range(4):
        batch = [(rng.randrange(3), rng.choice([None, f"k{rng.randrange(600)}"]), 1000 * n + i) for i in range(200)]
        got = index.seen(spark.createDataFrame(batch, "store_id bigint, key string, seq bigint"))
        want = []
        for s, x, q in batch:
            if x is not None:
                if (s, x.encode()) in have:
                    want.append(q)
                have.add((s, x.encode()))
        assert sorted(r["seq"] for r in got.found.collect()) == want
        index.absorb(got)
        index = M.KeyIndex(spark, str(tmp_path / "i"))
    assert len(index.list["keys"]) <= 2 and index._keys().select(*M.ON).distinct().count() == index._keys().count() == len(have)
    one = index.seen(spark.createDataFrame([(0, bytes(next(k for s, k in have if s == 0)).decode(), 1)], "store_id bigint, key string, seq bigint"))
    assert len(one.read_buckets) == 1
    files = index._keys(one.read_buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in files and f"(bucket#" in files
    nothing = index.seen(spark.createDataFrame([(0, "never seen before", 1)], "store_id bigint, key string, seq bigint"))
    assert nothing.found.count() == 0 and (nothing.read_buckets == [] or nothing.verified.count() == 1)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_heads_keep_the_most_frequent(spark, k):
    rng = random.Random(k)
    rows = [(rng.randrange(4), rng.choice(["hot", "warm", f"c{int(rng.paretovariate(0.6)) % 500}", "", "ü", None])) for _ in range(6000)]
    df = spark.createDataFrame([(g, i, "x") for g, i in rows], "g bigint, item string, n string").repartition(9)
    counts = Counter((g, i) for g, i in rows if i is not None)
    got = Q.top_items(df, "g", "item", k).collect()
    for g in range(4):
        mine = sorted(((n, i.encode()) for (h, i), n in counts.items() if h == g), reverse=True)[:k]
        assert [(r["n"], bytes(r["item"])) for r in sorted((r for r in got if r["grp"] == g), key=lambda r: r["rank"])] == mine


def test_share_of_rows(spark):
    rows = [(1, "a")] * 2 + [(1, f"b{i}") for i in range(98)] + [(1, None)] * 50 + [(2, "only")] + [(None, "z")] * 9
    got = Q.frequent_items(spark.createDataFrame(rows, "g bigint, item string"), "g", "item").collect()
    assert {(r["grp"], bytes(r["item"]).decode(), r["n"], r["total"]) for r in got} == {(1, "a", 2, 100), (2, "only", 1, 1)}
    assert Q.frequent_items(spark.createDataFrame([], "g bigint, item string"), "g", "item").count() == 0


def test_runs_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i % 2, f"k{i % 5}") for i in range(500)]
        got = {(r["grp"], bytes(r["item"]).decode()): r["n"] for r in Q.top_items(spark.createDataFrame(rows, "g bigint, item string"), "g", "item", 9).collect()}
        assert got == Counter(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
