"""Encoding against the tokenizer itself; apportionment and mixes against plain versions."""

import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import mixing as X
from tidelog.llm import tokens as T

HARD = [
    "", " ", "\n", "a", "  a", "a  ", "don't we'll I'VE", "'s 'll ''re", "a\n\n\n b   c", "x" * 3000, " " * 500 + "x", "word " * 900, "12345678901234567890", "a1b2c3", "<|endoftext|>", "日本語のテキスト。" * 200,
    "ไทยไม่มีช่องว่าง" * 50, "👩‍🔧🇪🇺😀" * 40, "é" * 300, " nbsp  x", "​‍﻿", "tab\t\ttab\r\n\r\n", "!!!???...,,,", "\x00\x01", "mixed текст with 中文 and عربى " * 60,
]


@pytest.fixture(scope="module")
def small():
    return T.Encoder(T.vocabulary(), leaf=5, window=1)


@pytest.mark.parametrize("i", range(len(HARD)))
def test_tree_equals_flat(small, i):
    assert small.encode(HARD[i]) == small.flat(HARD[i])
    assert small.decode(small.encode(HARD[i])) == HARD[i]


@lru_cache
def tiny():
    return T.Encoder(T.vocabulary(), leaf=3, window=1)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'’.,sdtlrevm0123aZéß中の。-")), st.characters(codec="utf-8")), max_size=200))
def test_tree_equals_flat_on_anything(text):
    enc = tiny()
    assert enc.encode(text) == enc.flat(text)
    assert enc.decode(enc.flat(text)) == text


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(100, None, "x"), (101, "again", "x"), (101, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(4)
    enc = T.encoder(T.vocabulary())
    for segment in (T.SEGMENT, 50):
        got = sorted((r["doc_id"], list(r["ids"])) for r in T.encode(df, segment=segment).collect())
        assert got == sorted((i, enc.flat(t) if t else []) for i, t, _ in rows)
    assert T.encode(df.limit(0)).count() == 0
    counts = {r["doc_id"]: r["tokens"] for r in T.token_counts(df, keep=("doc_id",)).collect()}
    assert counts[100] == 0 and counts[13] == len(enc.flat(HARD[13]))


def slow(weights, caps, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if weights[i] > 0 and got[i] < caps[i]), key=lambda i: (weights[i] / (2 * got[i] + 1), -i), default=None)
        if best is None:
            break
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(30))
def test_sainte_lague(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 8)
    weights = [rng.choice([0.0, 0.1, 0.25, 0.5, 1.0, rng.random()]) for _ in range(n)]
    caps = [rng.choice([0, 1, 5, 40, 1000]) for _ in range(n)]
    seats = rng.choice([0, 1, 7, 100, 3000])
    assert X.sainte_lague(weights, caps, seats) == slow(weights, caps, seats)


def mixed(spark, sizes, targets, **kw):
    s = spark.createDataFrame(sizes, "doc_id bigint, source string, tokens bigint")
    return X.mix(s, spark.createDataFrame(targets, "source string, weight double, max_repeats int"), **kw)


def test_mix_reaches_its_shares(spark):
    rng = random.Random(9)
    sizes = [(i, "big", rng.randrange(1, 60)) for i in range(3000)] + [(10_000 + i, "mid", rng.randrange(1, 60)) for i in range(900)] + [(20_000 + i, "tiny", 20) for i in range(10)]
    sizes += [(30_000 + i, None, 50) for i in range(20)] + [(40_000 + i, "outside", 50) for i in range(20)] + [(50_000, "big", 0)]
    targets = [("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.05, 2), ("absent", 0.05, 4), (None, 0.3, 1)]
    m = mixed(spark, sizes, targets, block=50, blocks_per_shard=100)
    report = {r["source"]: r for r in m.report.collect()}
    total = sum(t for _, s, t in sizes if s in ("big", "mid", "tiny"))
    repeats = {"big": 1, "mid": 3, "tiny": 2, "absent": 4}
    weights = {"big": 0.5, "mid": 0.4, "tiny": 0.05, "absent": 0.05}
    for s, r in report.items():
        own = sum(t for _, x, t in sizes if x == s)
        assert r["short"] == (repeats[s] * own < weights[s] * total)
    picked = m.selection().collect()
    by_id = {(d, s): t for d, s, t in sizes}
    assert all(1 <= r["times"] <= repeats[r["source"]] and by_id[r["doc_id"], r["source"]] == r["tokens"] for r in picked)
    assert len({r["doc_id"] for r in picked}) == len(picked)
    share = {r["source"]: r["share"] for r in X.shares(m).collect()}
    assert share["absent"] == 0 and share["tiny"] == pytest.approx(400 / total, rel=0.1) and share["big"] == pytest.approx(0.55, abs=0.03)
    again = mixed(spark, sizes, targets, block=50, blocks_per_shard=100).selection()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, picked))


@pytest.mark.parametrize("seed", range(40))
def test_quotas_of_shards(seed):
    """The few steps give what one seat after the other gives among all shards."""
    rng = random.Random(seed)
    per, blocks = rng.choice([1, 3, 10]), rng.randrange(1, 60)
    seats = rng.randrange(0, 3 * blocks + 1)
    sizes = [per] * (blocks // per) + ([blocks % per] if blocks % per else [])
    want = slow([float(x) for x in sizes], [10**9] * len(sizes), seats)
    each, more, last = X.shard_quotas(blocks, per, seats)
    full = blocks // per
    assert [each + (i < more) for i in range(full)] + [last] * (len(sizes) - full) == want


@pytest.mark.parametrize("seed", range(4))
def test_shares_are_the_best_that_repeats_allow(spark, seed):
    """Each source has its quota to within a block, sources of many shards, of one block and with long documents too."""
    rng = random.Random(seed)
    sizes, i, block = [], 0, 100
    for s, n, longest in (("big", 4000, 60), ("mid", 700, 90), ("thin", 40, 9), ("long", 30, 95), ("one", 1, 30)):
        for _ in range(n):
            sizes.append((i, s, rng.randrange(0, longest)))
            i += 1
    ws = [rng.random() for _ in range(5)]
    targets = [(s, w / sum(ws), rng.randrange(1, 4)) for s, w in zip(("big", "mid", "thin", "long", "one"), ws)]
    m = mixed(spark, sizes, targets, block=block, blocks_per_shard=rng.choice([7, 50, 1024]))
    own = {s: sum(t for _, x, t in sizes if x == s) for s, _, _ in targets}
    total = sum(own.values())
    # water filling: what the capped ones lack goes to the others by weight
    best, left, open_ = {}, float(total), {s: (w, k * own[s]) for s, w, k in targets}
    while open_:
        scale = left / sum(w for w, _ in open_.values())
        full = [s for s, (w, cap) in open_.items() if w * scale >= cap]
        for s in full or list(open_):
            w, cap = open_.pop(s)
            best[s] = min(cap, w * scale)
        left = total - sum(best.values()) if full else 0.0
    got = {r["source"]: r["mix_tokens"] for r in X.shares(m).collect()}
    # a block by the rounding of seats and one by the last piece of each capped source, which the others' seats make good
    assert all(abs(got[s] - best[s]) <= 2 * block for s in best), (got, best)
    quotas = {r["source"]: r["quota_tokens"] for r in m.quotas.collect()}
    assert all(abs(got[s] - q) <= block for s, q in quotas.items()), (got, quotas)


def test_a_thin_source_over_many_shards(spark):
    """Few tokens beside many: the repeats give 20,000 tokens and all of them are used."""
    sizes = [(i, "big", 1000) for i in range(10_000)] + [(100_000 + i, "small", 5) for i in range(2000)]
    m = mixed(spark, sizes, [("big", 0.98, 2), ("small", 0.02, 2)], block=4096, blocks_per_shard=25)
    got = {r["source"]: r for r in X.shares(m).collect()}
    assert got["small"]["mix_tokens"] == 20_000 and got["small"]["documents"] == 2000 and got["small"]["short"]
    assert abs(got["big"]["mix_tokens"] - (10_010_000 - 20_000)) <= 2 * 4096 and not got["big"]["short"]


@pytest.mark.parametrize("off", [-1, 0, 1])
def test_short_at_its_edge(spark, off):
    sizes = [(1, "a", 50_000 + off), (2, "b", 150_000 - off)]
    m = mixed(spark, sizes, [("a", 0.5, 2), ("b", 0.5, 2)], block=100)
    assert {r["source"] for r in m.report.where("short").collect()} == ({"a"} if off < 0 else set())


def test_mix_of_nothing(spark):
    m = mixed(spark, [], [("a", 1.0, 2)])
    assert m.selection().count() == 0 and m.report.where("short").count() == 0
    assert X.shares(m).first()["share"] == 0
    assert mixed(spark, [(1, "a", 5)], []).report.count() == 0
