"""Compaction of sorted runs: planned on the manifest, carried out as one aggregation.

records are rows of runs (store_id, level, table_id, key, value, tombstone, ts, ...); the newest row
of a key is the one with the greatest ts, then of the lowest level, then of the highest table.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.lww import lww
from tidelog.operators.ordered import running
from tidelog.operators.skew import BROADCAST_ROWS, at_most, lookup_join
from tidelog.session import cut

RUN = ["store_id", "level", "table_id"]


def with_order(records: DataFrame) -> DataFrame:
    """records with nearness, greater for lower levels, for the order of equal ts."""
    return records.withColumn("nearness", -F.col("level"))


ORDER = ("ts", "nearness", "table_id")


def newest(records: DataFrame, by: tuple[str, ...] = ("store_id", "key")) -> DataFrame:
    """The newest row of each key over all runs, tombstones kept."""
    return lww(with_order(records), by, ORDER).drop("nearness")


def merge(*runs: DataFrame, by: tuple[str, ...] = ("store_id", "key")) -> DataFrame:
    """Runs merged into one, tombstones kept."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return newest(out, by)


def level_read(records: DataFrame, by: tuple[str, ...] = ("store_id", "key")) -> DataFrame:
    """What a read level by level finds: the first level that holds a key wins, there the greatest ts."""
    return lww(with_order(records), by, ("nearness", "ts", "table_id")).drop("nearness")


def _tiers(max_tables: int, max_level: int):
    """Where the runs of one store end up; one row a run."""

    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by([("level", "ascending"), ("table_id", "ascending")])
        at = np.array(t.column("level").to_pylist(), dtype=np.int64)
        place = np.zeros(len(at), dtype=np.int64)
        for lv in np.unique(at):
            place[at == lv] = np.arange(1, (at == lv).sum() + 1)
        for level in range(1, max_level):
            here = at == level
            n, m = len(np.unique(place[here])), len(np.unique(place[at == level + 1]))
            if n == 0 or level == 1 and (n == 1 or n < max_tables):
                break
            # merges until fewer than max_tables, or one, are left
            pairs = min((n - max_tables + 2) // 2, n // 2) if n >= max(2, max_tables) else 0
            moved = here & (place <= 2 * pairs)
            place[here & ~moved] -= 2 * pairs
            place[moved] = m + (place[moved] + 1) // 2
            at[moved] = level + 1
        return t.append_column("to_level", pa.array(at, pa.int32())).append_column("to_table", pa.array(place, pa.int32()))

    return go


def size_tiered_plan(tables: DataFrame, max_tables: int = 8, max_level: int = 4) -> DataFrame:
    """(store_id, level, table_id, to_level, to_table): where the records of each run end up.

    While a level below the last has max_tables runs or more (and two at least), its two oldest are
    merged into a new run of the next level, then the next level is looked at; an empty level ends
    it. How many pairs that makes follows from the counts, so the cascade is one step a level. The
    plan works on one row per run, a store's in one task: a table of runs, not of records. to_table
    counts from 1 in each level, oldest first.
    """
    if max_tables < 1 or max_level < 1:
        raise ValueError("max_tables and max_level must be at least 1")
    one = tables.select(F.col("store_id").cast("bigint").alias("store_id"), F.col("level").cast("int").alias("level"), F.col("table_id").cast("int").alias("table_id")).distinct()
    return one.groupBy("store_id").applyInArrow(_tiers(max_tables, max_level), "store_id bigint, level int, table_id int, to_level int, to_table int")


def compact_size_tiered(records: DataFrame, max_tables: int = 8, max_level: int = 4) -> DataFrame:
    """Records after size-tiered compaction, with their new level and table; tombstones are kept.

    Whatever the cascade, a record is shuffled once: to the run in which it ends and its key.
    """
    plan = cut(size_tiered_plan(records.select(*RUN), max_tables, max_level), "plan")
    moved = lookup_join(with_order(records), plan, RUN, "inner", spread=F.xxhash64("key", "ts"))
    got = lww(moved, ("store_id", "to_level", "to_table", "key"), ORDER)
    return got.select(*[c for c in got.columns if c not in ("level", "table_id", "to_level", "to_table", "nearness")], F.col("to_level").alias("level"), F.col("to_table").alias("table_id"))


def level_budgets(sizes: DataFrame, first: int = 1_000_000, fanout: int = 10, max_level: int = 4) -> DataFrame:
    """(store_id, level, bytes, budget, over) from sizes (store_id, level, bytes); the last level is never over."""
    got = sizes.groupBy("store_id", "level").agg(F.sum("bytes").alias("bytes"))
    budget = (F.lit(first) * F.pow(F.lit(float(fanout)), F.col("level") - 1)).cast("bigint")
    return got.withColumn("budget", budget).withColumn("over", (F.col("bytes") > F.col("budget")) & (F.col("level") < max_level))


def overlap_counts(tables: DataFrame, start: str = "start_key", end: str = "end_key", size: str = "bytes") -> DataFrame:
    """Each run of (store_id, level, table_id, start, end, size) with the runs of the next level that it overlaps: overlaps, overlap_bytes.

    Runs overlap where start <= other end and end >= other start. Counted by ranks, not by pairs:
    those that start no later than this one ends, less those that end before it starts.
    """
    base = tables.select(*RUN, F.col(start).alias("s"), F.col(end).alias("e"), F.coalesce(F.col(size), F.lit(0)).alias("z"))
    none = [F.lit(None).cast("int").alias("table_id"), F.lit(None).cast("string").alias("what")]
    w = F.col("z").cast("bigint")
    zero = F.lit(0).cast("bigint")
    lower = (F.col("level") - 1).cast("int")
    rows = (
        # starts sort before a probe of the same key, ends after it
        base.select("store_id", lower.alias("level"), F.col("s").alias("k"), F.lit(0).alias("o"), *none, F.lit(1).alias("n1"), w.alias("z1"), F.lit(0).alias("n2"), zero.alias("z2"))
        .unionByName(base.select("store_id", lower.alias("level"), F.col("e").alias("k"), F.lit(3).alias("o"), *none, F.lit(0).alias("n1"), zero.alias("z1"), F.lit(1).alias("n2"), w.alias("z2")))
        .unionByName(base.select("store_id", F.col("level").cast("int").alias("level"), F.col("e").alias("k"), F.lit(1).alias("o"), "table_id", F.lit("end").alias("what"), F.lit(0).alias("n1"), zero.alias("z1"), F.lit(0).alias("n2"), zero.alias("z2")))
        .unionByName(base.select("store_id", F.col("level").cast("int").alias("level"), F.col("s").alias("k"), F.lit(2).alias("o"), "table_id", F.lit("start").alias("what"), F.lit(0).alias("n1"), zero.alias("z1"), F.lit(0).alias("n2"), zero.alias("z2")))
    )
    run = Window.partitionBy("store_id", "level").orderBy("k", "o").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("store_id", "level", "table_id", "what", *[F.sum(c).over(run).alias(c) for c in ("n1", "z1", "n2", "z2")]).where("what IS NOT NULL")
    at_end, at_start = F.col("what") == "end", F.col("what") == "start"
    return seen.groupBy(*RUN).agg(
        (F.max(F.when(at_end, F.col("n1"))) - F.max(F.when(at_start, F.col("n2")))).cast("bigint").alias("overlaps"),
        (F.max(F.when(at_end, F.col("z1"))) - F.max(F.when(at_start, F.col("z2")))).cast("bigint").alias("overlap_bytes"),
    )


def _choice(level: int, budget: int):
    """What one store's level gives to the next: the runs that take part, and the key ranges of all that don't."""

    def go(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["level"], r["table_id"]))
        here = [r for r in rows if r["level"] == level]
        over = sum(r["bytes"] for r in here) - budget
        given = []
        while over > 0 and here and (level == 1 or sum(r["bytes"] for r in given) < over):
            given.append(here.pop(0))
        below = [r for r in rows if r["level"] == level + 1]
        met = _meeting(below, given)
        taken = given + met
        inside = {(r["level"], r["table_id"]) for r in taken}
        cover = union_of_ranges([(r["s"], r["e"]) for r in rows if (r["level"], r["table_id"]) not in inside])
        n = len(taken) + (1 if taken else 0)
        kind = t.schema.field("s").type
        cols = {
            "store_id": pa.array([t.column("store_id")[0].as_py()] * n, pa.int64()),
            "level": pa.array([r["level"] for r in taken] + [None] * (n > 0), pa.int32()),
            "table_id": pa.array([r["table_id"] for r in taken] + [None] * (n > 0), pa.int32()),
            "cover": pa.array([None] * len(taken) + [[{"s": a, "e": z} for a, z in cover]] * (n > 0), pa.list_(pa.struct([("s", kind), ("e", kind)]))),
            "top": pa.array([None] * len(taken) + [max((r["table_id"] for r in below), default=0)] * (n > 0), pa.int32()),
        }
        return pa.table(cols)

    return go


def _meeting(runs: list[dict], others: list[dict]) -> list[dict]:
    """The runs whose key range meets that of one of the others."""
    cover = union_of_ranges([(r["s"], r["e"]) for r in others])
    starts = [a for a, _ in cover]
    # the last range that starts no later than the run ends is the only one that can reach furthest
    return [r for r in runs if (i := bisect_right(starts, r["e"])) and cover[i - 1][1] >= r["s"]]


def union_of_ranges(ranges: list[tuple]) -> list[tuple]:
    """Closed ranges as disjoint ones, ascending."""
    out: list[tuple] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*RUN).agg(F.sum("__size").alias("bytes"), F.min("key").alias("s"), F.max("key").alias("e"))


def compact_leveled(records: DataFrame, size: str, first: int = 1_000_000, fanout: int = 10, max_level: int = 4, block: int = 160_000) -> DataFrame:
    """Records after leveled compaction, with new level and table.

    Level by level from the first: of a level over its budget, as many of its oldest runs as bring
    it under (all of the first level's, whose runs overlap) are merged with those runs of the next
    level that they overlap, for all stores in one pass. What is merged is planned on the manifest, one
    row per run; only the records of runs that take part are read and written, the others stay where
    they are. The result is cut into runs of more than `block` bytes at most by one record.

    A tombstone is dropped where the target is the last level, there are more than two, and no run of
    its store outside the merge has its key in its range: a put of an older ts may still lie in a
    higher level, and would come back.
    """
    state = with_order(records).withColumn("store_id", F.col("store_id").cast("bigint")).withColumn("level", F.col("level").cast("int")).withColumn("table_id", F.col("table_id").cast("int"))
    state = state.withColumn("__size", F.col(size).cast("bigint"))
    columns, kind = state.columns, dict(state.dtypes)["key"]
    parts, manifest = [state], cut(_stats(state), "manifest")
    chosen_schema = f"store_id bigint, level int, table_id int, cover array<struct<s:{kind},e:{kind}>>, top int"
    for level in range(1, max_level):
        plan = cut(manifest.groupBy("store_id").applyInArrow(_choice(level, first * fanout ** (level - 1)), chosen_schema), "chosen")
        chosen, covers = plan.where("level IS NOT NULL").select(*RUN), plan.where("level IS NULL").select("store_id", "cover", "top")
        if chosen.isEmpty():
            continue
        meet = _meets(chosen)
        taken = reduce(DataFrame.unionByName, [meet(p, "left_semi") for p in parts])
        merged = lookup_join(lww(taken, ("store_id", "key"), ORDER), covers, ["store_id"], "inner", spread=F.xxhash64("key"))
        if max_level > 2 and level + 1 == max_level:
            elsewhere = F.exists("cover", lambda c: (c["s"] <= F.col("key")) & (F.col("key") <= c["e"]))
            merged = merged.where(~F.coalesce("tombstone", F.lit(False)) | elsewhere)
        cutting = running(merged.select(*columns, "top"), ["store_id", "key"], "__size", ["store_id"])
        new = cutting.withColumn("level", F.lit(level + 1)).withColumn("nearness", F.lit(-(level + 1))).withColumn("table_id", (F.col("top") + 1 + F.expr(f"before div {block}")).cast("int"))
        new = cut(new.select(*columns), "leveled")
        parts = [meet(p, "left_anti") for p in parts] + [new]
        manifest = cut(meet(manifest, "left_anti").unionByName(_stats(new)), "manifest")
    return reduce(DataFrame.unionByName, parts).select(*records.columns)


def _meets(chosen: DataFrame):
    """Joins of records to some runs: these are broadcast where they are few, else the records are dealt evenly."""
    few = at_most(chosen, BROADCAST_ROWS)
    return lambda df, how: df.join(F.broadcast(chosen), RUN, how) if few else lookup_join(df, chosen, RUN, how, max_rows=0)
