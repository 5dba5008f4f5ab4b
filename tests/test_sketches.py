"""Hashes and sketches against plain versions."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.functions.hashing import FNV_PRIME, fnv1a64, fnv_array, md5_64, seeded_state, trailing_zeros, umod
from tidelog.operators import bloom as B
from tidelog.operators import cms as K
from tidelog.operators import hll as H
from tidelog.operators import simhash as S
from tidelog.operators import skew

# Two texts whose fingerprints' distance is known.
APPLE = "If you wish to make an apple pie from scratch, you must first invent the universe."
PECAN = "If you wish to make a pecan pie from scratch, you must first invent the universe."
OTHER = "A completely different sentence about rivers, bridges and the price of copper in autumn."


def fnv(data, seed):
    h = seeded_state(seed)
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def test_fnv():
    words = ["", "hello", "ünïcode", "a" * 500, *[f"key{i}" for i in range(200)]]
    assert [int(x) for x in fnv_array(pa.array(words), seeded_state(14022003))] == [fnv(w.encode(), 14022003) for w in words]
    assert fnv(b"hello", 14022003) == 5323054163398605912 and seeded_state(14022003) == 2836210340306864768


def test_hash_columns(spark):
    df = spark.createDataFrame([("hello",), (None,)], "k string")
    a, b = df.select(fnv1a64(F.col("k"), 14022003).alias("h"), md5_64(F.col("k"), 1).alias("m")).collect()
    assert a["h"] == 5323054163398605912 and b["h"] is None and b["m"] is None


def test_unsigned_arithmetic(spark):
    xs = [0, 1, -1, 2, -(1 << 63), (1 << 63) - 1, 6, -8, 1 << 40]
    got = spark.createDataFrame([(x,) for x in xs], "h bigint").select(umod(F.col("h"), 1000).alias("m"), trailing_zeros(F.col("h")).alias("z")).collect()
    for x, r in zip(xs, got):
        u = x % (1 << 64)
        assert r["m"] == u % 1000 and r["z"] == (64 if u == 0 else (u & -u).bit_length() - 1)


def test_sizings():
    assert B.sizing(1000, 0.1) == (4793, 4) and K.sizing(0.01, 0.01) == (6, 272)
    for bad in ((0, 0.1), (10, 0), (10, 1)):
        with pytest.raises(ValueError):
            B.sizing(*bad)


def test_bloom_has_no_false_negatives(spark):
    m, k = B.sizing(1000, 0.01)
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    bits = B.build(spark.range(1000).select(F.col("id").cast("string").alias("key")), "key", m, k)
    got = {int(r["key"]): r["maybe"] for r in B.probe(df, "key", bits, m, k).collect()}
    assert all(got[i] for i in range(1000)) and sum(got[i] for i in range(1000, 2000)) <= 20
    joined = {int(r["key"]): r["maybe"] for r in B.probe(df, "key", bits, m, k, most_bits=0).collect()}
    assert joined == got
    blob = B.serialize(m, k, 1000, 1, B.bitmap(bits, m))
    assert B.deserialize(blob)[:4] == (m, k, 1000, list(range(1, k + 1)))


def test_joined_probe_repeats_only_heavy_keys(spark, monkeypatch):
    # as with more keys than may be broadcast
    monkeypatch.setattr(skew, "at_most", lambda df, rows: False)
    m, k = B.sizing(100, 0.01)
    keys = spark.createDataFrame([("hot",)] * 900 + [(None,)] * 50 + [(str(i),) for i in range(300)], "key string")
    bits = B.build(spark.createDataFrame([("hot",), *[(str(i),) for i in range(99)]], "key string"), "key", m, k)
    df = B.probe(keys, "key", bits, m, k, most_bits=0)
    assert Counter(df.collect()) == Counter(B.probe(keys, "key", bits, m, k).collect())
    assert "explode(CASE WHEN (__n" in df._jdf.queryExecution().optimizedPlan().toString()


def test_bloom_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "key string")
    bits = B.build(none, "key", 100, 3)
    assert bits.count() == 0 and B.probe(none, "key", bits, 100, 3).first()["maybe"] is False


def test_bloom_union(spark):
    a, b = (spark.createDataFrame([(k,)], "key string") for k in "ab")
    assert B.union(B.build(a, "key", 64, 3), B.build(b, "key", 64, 3)).exceptAll(B.build(a.union(b), "key", 64, 3)).count() == 0


def test_cms_never_underestimates(spark):
    rng = random.Random(1)
    items = [f"i{min(rng.randrange(100), rng.randrange(100))}" for _ in range(3000)] + [None]
    df = spark.createDataFrame([(i,) for i in items], "k string")
    rows, cols = K.sizing(0.05, 0.05)
    sketch = K.build(df, "k", rows, cols)
    got = {r["item"]: r["estimate"] for r in K.estimate(df.withColumnRenamed("k", "item"), sketch, rows, cols).collect()}
    for i in set(items) - {None}:
        assert items.count(i) <= got[i] <= items.count(i) + 0.05 * 3000
    halves = [spark.createDataFrame([(i,) for i in part], "k string") for part in (items[:1000], items[1000:])]
    assert K.merge(*[K.build(h, "k", rows, cols) for h in halves]).exceptAll(sketch).count() == 0
    blob = K.serialize(sketch, rows, cols, 1)
    assert K.deserialize(blob)[0:2] == (rows, cols)


def test_cms_wraps_only_on_request(spark):
    df = spark.createDataFrame([("x",)] * 300, "item string")
    sketch = K.build(df, "item", 6, 272)
    assert K.estimate(df, sketch, 6, 272).first()["estimate"] == 300
    assert K.estimate(df, sketch, 6, 272, wrap=256).first()["estimate"] == 44


def test_hll(spark):
    twelve = spark.createDataFrame([(f"name{i % 12}",) for i in range(600)], "k string")
    assert round(H.estimate(H.registers(twelve, "k", 16), 16).first()[0]) == 12
    many = spark.range(20_000).select(F.col("id").alias("k"))
    est = H.estimate(H.registers(many, "k", 12), 12).first()[0]
    assert abs(est / 20_000 - 1) < 3 * H.standard_error(12)
    parts = H.union(H.registers(many.where("k < 9000"), "k", 12), H.registers(many.where("k >= 5000"), "k", 12))
    assert H.estimate(parts, 12).first()[0] == est
    assert H.estimate(H.registers(many.where("k < 0"), "k", 12), 12).first()[0] == 0
    with pytest.raises(ValueError):
        H.registers(many, "k", 3)
    assert H.deserialize(H.serialize({3: 5}, 4, 9)) == (4, {3: 5}, 9)


def test_simhash(spark):
    docs = spark.createDataFrame([(1, APPLE), (2, PECAN), (3, OTHER), (4, ""), (5, None), (6, "12 34"), (7, APPLE)], "doc_id bigint, text string")
    got = {r["id"]: r["fingerprint"] for r in S.fingerprints(docs).collect()}
    d = lambda a, b: ((got[a] ^ got[b]) % (1 << 64)).bit_count()
    assert d(1, 7) == 0 and d(1, 2) <= d(1, 3) and got[4] is got[5] is got[6] is None
    w = S.words(APPLE)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    feats = spark.createDataFrame([(1, signed(fnv(k.encode(), S.SEED)), n) for k, n in w.items()], "id bigint, hash bigint, weight bigint")
    assert S.weighted(feats).first()["fingerprint"] == got[1]


def test_near_pairs_are_complete(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = list({p ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for p in base for _ in range(3)})
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in (x % (1 << 64) for x in prints)]
    df = spark.createDataFrame(list(enumerate(signed)) + [(10_000, signed[0])], "id bigint, fingerprint bigint")
    cls = S.classes(df)
    assert {r["class_id"]: r["members"] for r in cls.collect()}[0] == 2
    got = {(r["a"], r["b"]): r["distance"] for r in S.near_pairs(cls).collect()}
    want = {(i, j): n for i in range(len(signed)) for j in range(i + 1, len(signed)) if (n := ((signed[i] ^ signed[j]) % (1 << 64)).bit_count()) <= 3}
    assert got == want
