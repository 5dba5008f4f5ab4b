"""Small files, change capture and equality-delete state on hard cases."""

import os
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.operators import incremental as P
from tidelog.operators import small_files as S
from tidelog.operators.changefeed import EqualityDeleteTable
from tidelog.operators.incremental import PLAN_SCHEMA, ChangeCapture, last_success
from tidelog.operators.skew import heavy_join, lookup_join
from tidelog.sources import files

LISTING = "store_id bigint, toc_filename string, block string, size bigint, listed_at timestamp, extra string"
RECORDS = "store_id bigint, level int, table_id int, crc bigint, tombstone boolean, key binary, value binary, ts bigint"


def toc(n, level=1, style="data/L{:03d}/TOC/usertable-{:05d}-TOC.txt"):
    return style.format(level, n)


def day(n):
    return datetime(2025, 1, n)


def listing(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LISTING)


def small(spark, rows, limit=100):
    return {(r["store_id"], r["level"], r["table_id"]): r["bytes"] for r in S.small_tables(listing(spark, rows), limit).collect()}


def test_latest_known_size_counts_once(spark):
    rows = [
        (1, toc(1), "Data", 500, day(1)), (1, toc(1), "Data", 50, day(2)), (1, toc(1), "Data", None, day(3)), (1, toc(1), "Data", 50, day(2)),
        (1, toc(1), "Index", 40, day(1)), (1, toc(1), "Metadata", None, day(1)),
        (1, toc(2), "Data", 60, day(1)), (1, toc(2), "Index", 40, day(1)),
        (1, toc(3), "Data", None, day(1)), (1, toc(4), "Data", None, day(1)), (1, toc(4), "Filter", 5, day(1)),
    ]
    assert small(spark, rows) == {(1, 1, 1): 90, (1, 1, 4): 5}


@pytest.mark.parametrize("style", ["./data/L{:03d}/TOC/usertable-{:05d}-TOC.txt", "data//L{:03d}/TOC/usertable-{:05d}-TOC.txt", "data\\L{:03d}\\TOC\\usertable-{:05d}-TOC.txt", "/var/kv/store1/data/L{:03d}/TOC/usertable-{:05d}-TOC.txt"])
def test_paths_in_any_writing(spark, style):
    rows = [(1, toc(7, 2), "Data", 60, day(1)), (1, toc(7, 2, style), "Data", 10, day(2)), (1, "nonsense", "Data", 1, day(1))]
    assert small(spark, rows) == {(1, 2, 7): 10}


def test_no_listing(spark):
    assert small(spark, []) == {}


def write_records(spark, path, n, files):
    rng = random.Random(n)
    rows = [(1, 1, rng.randrange(1, 6), None if i % 5 == 0 else i, i % 3 == 0, bytearray(f"k{i % 40}".encode()), None if i % 3 == 0 else bytearray(b"v" * (i % 7)), i) for i in range(n)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, RECORDS)
    df.repartition(files).write.parquet(path)
    return df


def test_records_come_out_exactly_as_often(spark, tmp_path):
    src = write_records(spark, str(tmp_path / "records"), 400, 40)
    listing(spark, [(1, toc(t), "Data", 10 if t < 4 else 10**6, day(1)) for t in range(1, 6)]).write.parquet(str(tmp_path / "files"))
    out = S.consolidate(spark, str(tmp_path / "files"), str(tmp_path / "records"), str(tmp_path / "out"))
    got = spark.read.parquet(out.path)
    want = src.where("table_id < 4")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and out.rows == want.count()
    assert out.files < 40 and out.plan.count() == 3
    assert not os.path.exists(f"{tmp_path}/out.staging")
    with pytest.raises(FileExistsError):
        S.compact(want, str(tmp_path / "out"), 1)


def test_splits_are_packed_and_the_session_is_left_alone(spark, tmp_path):
    write_records(spark, str(tmp_path / "r"), 300, 60)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    packed = S.packed_read(spark, str(tmp_path / "r"))
    assert packed.rdd.getNumPartitions() < 30
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_no_records_give_a_readable_folder(spark, tmp_path):
    out = str(tmp_path / "empty")
    S.compact(spark.createDataFrame([], RECORDS), out, 0)
    assert spark.read.parquet(out).count() == 0


def test_a_difference_is_not_published(spark, tmp_path, monkeypatch):
    df = spark.range(10)
    counts = iter([df.limit(9), df])
    monkeypatch.setattr(S, "multiset", lambda _, real=S.multiset: real(next(counts)))
    with pytest.raises(RuntimeError):
        S.compact(df, str(tmp_path / "x"), 1)
    assert not os.path.exists(tmp_path / "x")


LOG = "store_id bigint, seq bigint, file_name string, file_offset bigint, crc bigint, ts bigint, tombstone boolean, key string, value binary"
RUNS = "run_id bigint, store_id bigint, status string, latest_file_name string, byte_offset bigint"


def log(spark, rows):
    return spark.createDataFrame([(st, seq, f, o, 0, ts, tomb, k, bytearray(v) if v is not None else None) for st, seq, f, o, ts, tomb, k, v in rows], LOG)


BASE = [
    (1, 1, "a", 0, 10, False, "k", b"v"),  # read, never again
    (1, 2, "a", 50, 10, False, "k", b"v"), (1, 2, "b", 10, 10, False, "k", b"v"),  # delivered again, unchanged
    (1, 3, "a", 60, 10, False, None, b"v"), (1, 3, "b", 20, 10, False, None, b"w"),  # changed
    (1, 4, "b", 30, 10, True, None, None), (1, 4, "b", 30, 10, True, None, None), (1, 4, "b", 40, 10, True, None, None),  # new, loaded twice, delivered twice
    (1, 5, "a", 70, 10, True, None, None), (1, 5, "b", 50, 10, True, None, None),  # unchanged with nulls
    (1, 6, "b", 5, 10, False, "at", b""),  # at the offset
    (2, 1, "a", 0, 10, False, "k", b"v"),  # a store without a successful run
]
POSITIONS = [(1, 1, "success", "a", 40), (3, 1, " SUCCESS ", "b", 5), (3, 1, " SUCCESS ", "b", 5), (4, 1, "failed", "b", 99), (9, 2, "running", "z", 9)]


def test_last_success(spark):
    got = {r["store_id"]: (r["from_file"], r["from_offset"]) for r in last_success(spark.createDataFrame(POSITIONS, RUNS)).collect()}
    assert got == {1: ("b", 5)}


def changes(df):
    return sorted({(r["store_id"], r["seq"]) for r in df.collect()})


def test_new_and_changed_records(spark, tmp_path):
    c = ChangeCapture(spark, str(tmp_path / "c"))
    c.capture(log(spark, BASE), spark.createDataFrame(POSITIONS, RUNS))
    assert changes(c.sink()) == [(1, 3), (1, 4), (1, 6), (2, 1)]
    assert c.sink().groupBy("store_id", "seq").count().where("count > 1").count() == 0


def test_batches_neither_skip_nor_repeat(spark, tmp_path):
    c = ChangeCapture(spark, str(tmp_path / "c"))
    c.capture(log(spark, BASE), spark.createDataFrame(POSITIONS, RUNS))
    more = BASE + [(1, 7, "c", 0, 11, False, "n", b"1"), (1, 4, "c", 9, 10, True, None, None), (3, 1, "a", 0, 1, False, "z", b"1")]
    assert c.capture(log(spark, more)) == 1
    assert changes(c.sink(1)) == [(1, 7), (3, 1)]
    assert c.capture(log(spark, more)) == 2 and c.sink(2).count() == 0


def test_a_failed_batch_is_replayed_as_planned(spark, tmp_path):
    c = ChangeCapture(spark, str(tmp_path / "c"))
    runs = spark.createDataFrame(POSITIONS, RUNS)
    assert c.plan(log(spark, BASE), runs) == 0
    c.run(log(spark, BASE), 0)  # and then it dies before the commit
    grown = log(spark, BASE + [(1, 8, "c", 0, 11, False, "n", b"1")])
    again = ChangeCapture(spark, str(tmp_path / "c"))
    assert again.capture(grown, runs) == 0
    assert changes(again.sink()) == [(1, 3), (1, 4), (1, 6), (2, 1)]
    again.capture(grown)
    assert changes(again.sink()) == [(1, 3), (1, 4), (1, 6), (1, 8), (2, 1)]
    with pytest.raises(ValueError):
        ChangeCapture(spark, str(tmp_path / "none")).sink()


def test_two_runners_of_one_plan(spark, tmp_path):
    a, b = ChangeCapture(spark, str(tmp_path / "c")), ChangeCapture(spark, str(tmp_path / "c"))
    rows, runs = log(spark, BASE), spark.createDataFrame(POSITIONS, RUNS)
    assert a.plan(rows, runs) == b.plan(rows, runs) == 0
    fa, fb = a.run(rows, 0), b.run(rows, 0)
    assert b.commit(0, fb) and not a.commit(0, fa)
    assert changes(a.sink()) == [(1, 3), (1, 4), (1, 6), (2, 1)] and a.sink().count() == 4
    assert all(fb in f for f in a.sink().inputFiles())


def test_deliveries_without_a_place(spark, tmp_path):
    """Where null file, offset or store leave its place open, a delivery is taken once, and again only if its content differs."""
    c = ChangeCapture(spark, str(tmp_path / "c"))
    stray = [(1, 50, None, 3, 1, False, "s", None), (1, 51, "b", None, 1, False, None, b"v"), (1, 53, "a", None, 1, False, None, b"v"), (None, 52, "a", 1, 1, True, "s", b"v")]
    c.capture(log(spark, BASE + stray * 2), spark.createDataFrame(POSITIONS, RUNS))
    assert sorted(r["seq"] for r in c.sink().where("seq >= 50").collect()) == [50, 51, 52] and c.sink().count() == 7
    c.capture(log(spark, BASE + stray + [(1, 50, None, 3, 1, False, "s", b"new"), (1, 9, "d", 0, 1, False, "n", b"")]))
    assert changes(c.sink(1)) == [(1, 9), (1, 50)]


def test_an_overlapping_batch_repeats_nothing(spark, tmp_path):
    c = ChangeCapture(spark, str(tmp_path / "c"))
    c.capture(log(spark, BASE), spark.createDataFrame(POSITIONS, RUNS))
    folder = str(tmp_path / "plan")
    spark.createDataFrame([(1, 1, "b", 5, "c", 1), (1, 2, None, None, "a", 1)], PLAN_SCHEMA).write.parquet(folder)
    files.publish(spark, f"{tmp_path}/c/plans/1", folder)
    c.capture(log(spark, BASE + [(1, 7, "c", 0, 11, False, "n", b"1")]))
    assert changes(c.sink(1)) == [(1, 7)]


@pytest.mark.parametrize("bound", [100_000, 2])
def test_cost_follows_the_batch_and_not_the_log(spark, tmp_path, monkeypatch, bound):
    """Ten times as much log before the offset, and no more of it passes to the comparison than is delivered again."""
    monkeypatch.setattr(P, "may_meet", lambda rows, keys, on, real=P.may_meet: met.append(real(rows, keys, on, bound)) or met[-1])
    met: list = []
    old = [(1, i, "a", i, 1, False, f"k{i}", b"v") for i in range(3000)]
    new = [(1, i, "b", i, 1, False, f"k{i}", b"v" if i % 2 else b"w") for i in (*range(0, 40), *range(5000, 5100))]
    c = ChangeCapture(spark, str(tmp_path / "c"))
    c.capture(log(spark, old + new), spark.createDataFrame([(1, 1, "success", "b", 0)], RUNS))
    assert changes(c.sink()) == [(1, i) for i in (*range(0, 40, 2), *range(5000, 5100))]
    assert 40 <= met[0].count() <= 60


def test_null_position_and_empty_tables(spark, tmp_path):
    c = ChangeCapture(spark, str(tmp_path / "c"))
    c.capture(log(spark, BASE[:2]), spark.createDataFrame([(1, 1, "success", None, None)], RUNS))
    assert changes(c.sink()) == [(1, 1), (1, 2)]
    e = ChangeCapture(spark, str(tmp_path / "e"))
    e.capture(log(spark, []), spark.createDataFrame([], RUNS))
    assert e.sink().count() == 0


FEED = [
    (1, 1, "a", 0, 10, False, "k", b"old"), (1, 2, "a", 1, 20, False, "k", b"new"), (1, 1, "b", 0, 10, False, "k", b"old"),  # the old one again
    (1, 3, "a", 2, 10, False, "gone", b"x"), (1, 4, "a", 3, 11, True, "gone", b"y"),  # deleted, with a value
    (1, 5, "a", 4, 30, True, "back", None), (1, 6, "a", 5, 31, False, "back", b""),  # back with an empty value
    (1, 8, "a", 7, 40, True, "late", None), (1, 7, "a", 6, 39, False, "late", b"z"),  # the put came after the delete but is older
    (1, 9, "a", 8, 50, False, "tie", b"1"), (1, 10, "a", 9, 50, True, "tie", None),  # one second: the greater seq
    (1, 11, "a", 10, 60, False, "same", b"1"), (1, 11, "c", 1, 60, True, "same", None),  # one seq: the later place
    (1, 12, "a", 11, 70, False, None, b"1"), (2, 13, "a", 0, 10, False, "gone", b"other store"), (1, 14, "a", 12, 5, False, "", b"e"),
    (1, 15, "a", 13, 5, False, "__BF_x", b"r"), (1, 15, "a", 13, 5, False, "__BF_x", b"r"),
]
STATE = {(1, "k"): (2, b"new"), (1, "back"): (6, b""), (2, "gone"): (13, b"other store"), (1, ""): (14, b"e"), (1, "__BF_x"): (15, b"r")}


@pytest.mark.parametrize("seed", range(3))
def test_state_in_whatever_order_and_batches(spark, tmp_path, seed):
    rows = FEED * 2
    random.Random(seed).shuffle(rows)
    t = EqualityDeleteTable(spark, str(tmp_path / "t"))
    edges = [0, *([9, 20] if seed else []), len(rows)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        t.append(log(spark, rows[a:b]).withColumn("r", F.lit(1)), i)
    t.append(log(spark, rows), 99)
    t.append(log(spark, rows), 99)
    got = {(r["store_id"], r["key"]): (r["seq"], bytes(r["value"])) for r in t.read().collect()}
    assert got == STATE
    assert t.read(values=False).count() == len(STATE)
    t.fold(100)
    assert {(r["store_id"], r["key"]): (r["seq"], bytes(r["value"])) for r in t.read().collect()} == STATE
    t.fold(102)
    t.append(log(spark, [(1, 3, "a", 2, 10, False, "gone", b"late")]), 101)  # still older than its delete
    assert {(r["store_id"], r["key"]): (r["seq"], bytes(r["value"])) for r in t.read().collect()} == STATE


def state(t):
    return {(r["store_id"], r["key"]): (r["seq"], bytes(r["value"])) for r in t.read().collect()}


class Died(Exception):
    pass


@pytest.mark.parametrize("after", [0, 1, 2])
@pytest.mark.parametrize("step", ["append", "fold"])
def test_state_outlives_a_failure_after_any_write(spark, tmp_path, monkeypatch, step, after):
    """Stopped before the first, after one or after both tables of a batch are written, nothing of it is seen; then it is run again."""
    t = EqualityDeleteTable(spark, str(tmp_path / "t"))
    t.append(log(spark, FEED[:9]), 0)
    t.append(log(spark, FEED[9:]), 1)
    before = state(t)
    newer = log(spark, [(1, 90, "z", 0, 99, False, "k", b"newer"), (1, 91, "z", 1, 99, True, "back", None)])
    run = (lambda: t.append(newer, 2)) if step == "append" else (lambda: t.fold(2))
    from pyspark.sql.readwriter import DataFrameWriter

    done = []

    def parquet(self, path, *a, real=DataFrameWriter.parquet, **k):
        if len(done) == after:
            raise Died
        done.append(path)
        return real(self, path, *a, **k)

    def publish(*_):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", parquet)
        m.setattr(files, "publish", publish)
        with pytest.raises(Died):
            run()
    assert len(done) == after and state(t) == before == state(EqualityDeleteTable(spark, str(tmp_path / "t")))
    run()
    want = dict(before)
    if step == "append":
        want[1, "k"] = (90, b"newer")
        del want[1, "back"]
    assert state(t) == want


def test_what_is_appended_during_a_fold_stays(spark, tmp_path, monkeypatch):
    t = EqualityDeleteTable(spark, str(tmp_path / "t"))
    t.append(log(spark, FEED), 0)
    late = log(spark, [(1, 90, "z", 0, 99, False, "during", b"1"), (1, 92, "z", 2, 99, True, "k", None)])
    read = EqualityDeleteTable._state

    def slow(self, folders, values):
        got = read(self, folders, values)
        if values and not done:
            done.append(1)
            self.append(late, 7)
        return got

    done = []
    monkeypatch.setattr(EqualityDeleteTable, "_state", slow)
    t.fold(8)
    want = {k: v for k, v in STATE.items() if k != (1, "k")} | {(1, "during"): (90, b"1")}
    assert done and state(t) == want
    t.append(log(spark, FEED), 0)  # the stream replays a batch that the fold took in
    assert state(t) == want
    t.fold(9)
    t.fold(10)
    assert state(t) == want and len(files.names(spark, f"{tmp_path}/t/batches")) == 2


def test_state_of_nothing(spark, tmp_path):
    assert EqualityDeleteTable(spark, str(tmp_path / "never")).read().count() == 0
    t = EqualityDeleteTable(spark, str(tmp_path / "t"))
    t.append(log(spark, []), 0)
    assert t.read().count() == 0


@pytest.mark.parametrize("bound", [1000, 2])
def test_lookup_join_on_either_side_of_its_bound(spark, bound):
    left = spark.createDataFrame([(i % 4 if i % 9 else None, i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, w string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert lookup_join(left, right, ["k"], how, bound, 4).exceptAll(left.join(right, "k", how)).count() == 0
        assert lookup_join(left, right, ["k"], how, bound, 4).count() == left.join(right, "k", how).count()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_never_broadcasts_the_repeated_side(spark, how):
    # the engine, whose bound is 10 MB here, takes the 16 copies of the right side for one
    left = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("a"))
    right = spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("b"))
    got = lookup_join(left, right, ["k"], how, max_rows=10)
    assert Counter(got.collect()) == Counter(left.join(right, "k", how).collect())
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_heavy_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)], "k string, v int")
    state = left.groupBy("k").agg(F.count("v").alias("n"))
    assert heavy_join(left, state, ["k"], "n", 1000, 10).exceptAll(left.join(state, "k")).count() == 0
    assert heavy_join(left, state, ["k"], "n", 1000, 10).count() == 1000
