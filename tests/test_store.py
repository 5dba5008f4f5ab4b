"""The store, its console and settings."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog import cli, config
from tidelog.config import Config
from tidelog.operators import merkle
from tidelog.schema import CHANGELOG
from tidelog.sources import files
from tidelog.sources.runs import Runs
from tidelog.store import RateLimitReached, Store


@pytest.fixture
def db(spark, tmp_path):
    return Store(spark, str(tmp_path / "db"))


def test_points(spark, db, tmp_path):
    db.put("key", b"value")
    assert db.get("key") == b"value" and db.get("missing") is None
    db.put("empty", b"")
    assert db.get("empty") == b""
    db.delete("key")
    db.delete("never there")
    assert db.get("key") is None
    with pytest.raises(ValueError):
        db.put("__BF_x", b"1")
    db.close()
    again = Store(spark, str(tmp_path / "db"))
    assert again.get("key") is None and again.get("empty") == b""
    again.put("key", b"second")
    assert again.get("key") == b"second"


def test_batches_flush_and_size_tiers(spark, tmp_path):
    c = Config()
    c.LSMTree.SizeTiered.maxLsmNodesPerLevel, c.LSMTree.maxLevel = 2, 3
    db = Store(spark, str(tmp_path / "db"), c)
    for n in range(4):
        db.put_batch(spark.createDataFrame([(f"k{i}", f"{n}".encode()) for i in range(n, 20)], "key string, value binary"))
        db.flush()
    assert db.get("k0") == b"0" and db.get("k3") == b"3"
    assert db.compact() == 1  # the cascade of three merges is written as one
    assert [(r.level, r.table_id) for r in db.runs.list()] == [(3, 1)]
    assert db.get("k0") == b"0" and db.get("k19") == b"3" and len(db.prefix_scan("k", 1, 100)) == 20
    with pytest.raises(ValueError):
        db.put_batch(spark.createDataFrame([("__BF_a", b"1")], "key string, value binary"))


def test_leveled(spark, tmp_path):
    c = Config()
    c.LSMTree.compactionAlgorithm = "Leveled"
    c.LSMTree.Leveled = config.Leveled(dataBlockSize=300, firstLevelTotalDataSize=200, fanoutSize=3)
    db = Store(spark, str(tmp_path / "db"), c)
    for n in range(2):
        db.put_batch(spark.createDataFrame([(f"k{i:03d}", b"x" * 10) for i in range(n * 20, n * 20 + 30)], "key string, value binary"))
        db.flush()
    db.compact()
    runs = db.runs.list()
    assert all(r.level > 1 for r in runs) and len(db.prefix_scan("k", 1, 100)) == 50
    for lv in {r.level for r in runs}:
        at = [r for r in runs if r.level == lv]
        assert all(a.end_key < b.start_key for a, b in zip(at, at[1:])) and [r.table_id for r in at] == sorted({r.table_id for r in at})


def test_leveled_keeps_a_tombstone_over_an_older_put(spark, tmp_path):
    """The tombstone reaches the last level while an older put of its key is in a run outside the merge."""
    runs = Runs(spark, str(tmp_path / "r"))
    mk = lambda *rows: spark.createDataFrame([(k, None if v is None else bytearray(v), v is None, ts, i) for i, (k, v, ts) in enumerate(rows)], CHANGELOG)
    low = runs._write(mk(("a", b"x" * 40, 1), ("k", None, 10), ("z", None, 10)), 2, 1)
    late = runs._write(mk(("k", b"late", 5)), 1, 1)
    runs.list()
    runs._commit([low, late])
    runs.compact_leveled(first=40, fanout=1, max_level=3, block=1000)
    assert sorted((r.level, r.start_key) for r in runs.list()) == [(1, "k"), (3, "a")]
    assert sorted((r["key"], r["tombstone"]) for r in runs.read().collect()) == [("a", False), ("k", False), ("k", True)]


def test_manifest_outlives_a_failure_and_a_second_writer(spark, tmp_path, monkeypatch):
    a, b = Runs(spark, str(tmp_path / "r")), Runs(spark, str(tmp_path / "r"))
    df = spark.createDataFrame([("k", bytearray(b"v"), False, 1, 0)], CHANGELOG)
    a.add(df)
    b.list()
    a.add(df)
    with pytest.raises(RuntimeError):
        b._commit([])
    with monkeypatch.context() as m:
        m.setattr(files, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            a.add(df)
    assert len(b.list()) == 2 and b.read().count() == 2
    for _ in range(3):
        b.add(df)
    assert len(b.list()) == 5 and len(b._numbers()) == 2


def test_runs_are_checked_scanned_and_rebuilt(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "r"), merkle_chunk=64)
    df = spark.createDataFrame([(f"k{i:02d}", None if i % 5 == 0 else bytearray(b"v" * i), i % 5 == 0, i, i) for i in range(23)], CHANGELOG)
    run = runs.add(df)
    assert runs.sound(run) and runs.rebuild(run) == run and runs.list() == [run]
    blocks = runs.blocks(run)
    assert [r["key"] for r in blocks["index"].orderBy("key").collect()] == ["k00", "k05", "k10", "k15", "k20", "k22"]
    assert [r["key"] for r in blocks["summary"].orderBy("key").collect()] == ["k00", "k22"] and blocks["filter"].count() > 23 and merkle.root(blocks["metadata"]).first()["root"] == run.merkle_root
    assert [r["key"] for r in runs.range_scan(run, "k03", "k99", 3).orderBy("key").collect()] == ["k03", "k04", "k05"]
    assert runs.prefix_scan(run, "k1").count() == 10 and runs.prefix_scan(run, "k1", 0).count() == 0
    c = runs.cursor(run, "k04", "k06")
    assert [c.next() for _ in range(4)] == [("k04", b"vvvv"), ("k05", None), ("k06", b"v" * 6), ("", None)]
    other = runs.read().withColumn("value", F.when(F.col("key") == "k03", F.lit(b"bad")).otherwise(F.col("value"))).withColumn("crc", F.when(F.col("key") == "k03", F.lit(1)).otherwise(F.lit(None).cast("bigint")))
    other.write.parquet(str(tmp_path / "bad"))
    run.path = str(tmp_path / "bad")
    assert runs.damaged(run) == 1 and not runs.sound(run)


def test_dictionary_of_the_store(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    for k in ("long key number one", "long key number two"):
        db.put(k, b"v")
    db.flush()
    for k in ("a third long key", "long key number one"):
        db.put(k, b"w")
    db.flush()
    assert {r["key"]: r["idx"] for r in db.dictionary().collect()} == {"long key number one": 0, "long key number two": 1, "a third long key": 2}
    plain, packed = db.space()
    assert packed < plain and plain == sum(db.runs.space().values())
    db.put("lost", b"1")
    db.clear_memtables()
    assert db.get("lost") is None and db.get("a third long key") == b"w"
    c = Config()
    c.SSTable.compression = False
    off = Store(spark, str(tmp_path / "off"), c)
    off.put("k", b"v")
    off.flush()
    assert off.dictionary().count() == 0


def test_scans(db):
    for k in "abcde":
        db.put(k, k.encode())
    db.delete("c")
    assert [k for k, _ in db.range_scan("b", "d")] == ["b", "d"]
    assert [k for k, _ in db.prefix_scan("", 2, 2)] == ["d", "e"]
    assert list(db.range_iterate("a", "b")) == [("a", b"a"), ("b", b"b")] and [k for k, _ in db.prefix_iterate("e")] == ["e"]


def test_rate_limit(spark, tmp_path):
    c, now = Config(), [1000.0]
    c.TokenBucket.maxTokenSize, c.TokenBucket.interval = 3, 100
    db = Store(spark, str(tmp_path / "db"), c, rate_limited=True, clock=lambda: now[0])
    db.put("a", b"1")
    db.get("a")
    db.delete("a")
    with pytest.raises(RateLimitReached, match="rate limit reached"):
        db.get("a")
    now[0] += 100
    assert db.get("a") is None


def test_sketches(spark, db):
    db.new_bf("f", 100, 0.01)
    db.bf_add("f", "x")
    db.bf_add_all("f", spark.createDataFrame([(f"v{i}",) for i in range(50)], "v string"), "v")
    assert db.bf_has_key("f", "x") and db.bf_has_key("f", "v7") and not db.bf_has_key("f", "nothing like it")
    db.new_cms("c", 0.01, 0.01)
    db.cms_add("c", "x")
    db.cms_add_all("c", spark.createDataFrame([("x",)] * 300, "v string"), "v")
    assert db.cms_get("c", "x") == 301 and db.cms_get("c", "y") == 0
    db.new_hll("h", 12)
    db.hll_add("h", "n0")
    db.hll_add_all("h", spark.createDataFrame([(f"n{i}",) for i in range(12)] * 3, "v string"), "v")
    assert round(db.hll_estimate("h")) == 12
    db.sh_add_fingerprint("s", "make an apple pie")
    db.sh_add_fingerprint("t", "make an apple pie")
    assert db.sh_hamming_distance("s", "t") == 0
    with pytest.raises(ValueError):
        db.sh_add_fingerprint("u", "12")
    db.delete_bf("f"), db.delete_cms("c"), db.delete_hll("h"), db.sh_delete_fingerprint("s")
    for gone in (lambda: db.bf_has_key("f", "x"), lambda: db.cms_get("c", "x"), lambda: db.hll_estimate("h"), lambda: db.sh_hamming_distance("s", "t")):
        with pytest.raises(KeyError):
            gone()
    assert db.prefix_scan("") == []


def test_console(db, tmp_path):
    said = []
    (tmp_path / "v").write_bytes(b"from file")
    lines = ["PUT k 'it is'", 'put q "two words"', "get k", "get q", f"put f -s {tmp_path}/v", f"get f -d {tmp_path}/o", f"get f /A /d {tmp_path}/o", f"get f -d {tmp_path}/o -a", "RangeScan a z", "prefixscan q 1 5", "newbf b 10 0.1", "bfadd b x", "bfhaskey b x", f"bfadd b -s {tmp_path}/v", 'bfhaskey b "from file"', "bfhaskey b -s", "newcms c 0.1 0.1", f"cmsadd c /S {tmp_path}/v", 'cmsget c "from file"', "newhll h 4", f"hlladd h -s {tmp_path}/v x", "nonsense", "get", "delete k", "get k", "help", "quit", "never read"]
    cli.main(db, lines, said.append)
    assert said.count("true") == 2 and said.count("false") == 1 and "1" in said
    assert "'it is'" in said and "two words" in said and "true" in said and "Error: invalid command" in said and "Error: invalid arguments" in said
    assert (tmp_path / "o").read_bytes() == b"from file" * 3
    assert any("Record 0 - K: f  V: from file" in s for s in said)
    assert cli.split("""a "b c" "d e" "" 'f g'""") == ["a", '"b c"', "d e", '""', "'f g'"]


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"LSMTree": {"maxLevel": 7}, "SSTable": {"filterPrecision": 0.2}, "unknown": 1}))
    c = config.load(str(p))
    assert c.LSMTree.maxLevel == 7 and c.SSTable.filterPrecision == 0.2 and c.Cache.maxSize == 1024
    config.save(c, str(p))
    assert config.load(str(p)) == c
    for bad in ({"SSTable": {"filterPrecision": 1}}, {"Memtable": {"structure": "List"}}, {"LSMTree": {"Leveled": {"fanoutSize": 1}}}, {"Cache": {"maxSize": 0}}):
        p.write_text(json.dumps(bad))
        with pytest.warns(UserWarning):
            assert config.load(str(p)) == Config()
    with pytest.warns(UserWarning):
        assert config.load(str(tmp_path / "none")) == Config()
