"""Running values over sorted data without putting a group, or everything, into one task.

Rows are range-partitioned and sorted; each task computes its running values in a stream; the few
totals of the tasks, one row per partition, then shift them. A group with a third of all rows is
spread over as many partitions as its rows deserve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import cut


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra


def _numbered(value_at: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = np.ones(b.num_rows, dtype=np.int64) if value_at is None else b.column(value_at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = total + np.concatenate([[0], np.cumsum(v)[:-1]])
            idx = np.arange(n, n + b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(idx), pa.array(before), pa.array(v)], [*b.schema.names, "__part", "__idx", "__before", "__v"])
            n, total = n + b.num_rows, total + int(v.sum())

    return go


def running(df: DataFrame, order: list[str], value: str | None = None, group: list[str] | None = None) -> DataFrame:
    """df with idx, the place of each row from 0, and before, the sum of `value` over the rows before it.

    order should make the order total. With group, a leading part of the order, both start again in
    each group. A null value counts as 0. The result is a table; it is not sorted.
    """
    at = df.columns.index(value) if value else None
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = cut(sorted_rows.mapInArrow(_numbered(at), _schema(df, "__part int, __idx bigint, __before bigint, __v bigint")), "running")
    # one row per partition
    parts = t.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("s"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__s0"))
    out = t.join(F.broadcast(shift), "__part").withColumn("idx", F.col("__idx") + F.col("__n0")).withColumn("before", F.col("__before") + F.col("__s0"))
    out = out.select(*df.columns, "idx", "before")
    if not group:
        return out
    from tidelog.operators.skew import lookup_join

    start = out.groupBy(*group).agg(F.min("idx").alias("__i0"), F.min("before").alias("__b0"), F.count(F.lit(1)).alias("group_rows"))
    led = lookup_join(out, start, group, "inner", spread=F.col("idx"), rows="group_rows")
    return led.select(*df.columns, (F.col("idx") - F.col("__i0")).alias("idx"), (F.col("before") - F.col("__b0")).alias("before"), "group_rows")


def changes_of_group(columns: list[pa.Array], before: list | None) -> tuple[np.ndarray, list]:
    """Whether each row has another group than the row before it, `before` being that of the last batch; and the last row's group."""
    n = len(columns[0]) if columns else 0
    last = [c[n - 1].as_py() for c in columns]
    new = np.zeros(n, dtype=bool)
    for c in columns:
        here, there = c.slice(1), c.slice(0, n - 1)
        same = pc.equal(here, there).fill_null(False)
        both_null = pc.and_(pc.is_null(here), pc.is_null(there))
        new[1:] |= ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
    new[0] = before is None or [c[0].as_py() for c in columns] != before
    return new, last


def _carried(group_at: list[int], value_at: int):
    """Per row the last value at or before it in its group, and whether the group began in this partition."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, held, began = TaskContext.get().partitionId(), None, None, False
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            value = b.column(value_at)
            if group_at:
                new, last = changes_of_group([b.column(i) for i in group_at], group)
            else:
                new, last = np.zeros(n, dtype=bool), []
            at = np.arange(n)
            # the row of the last start, and of the last value, at or before each row
            start = np.maximum.accumulate(np.where(new, at, -1))
            source = np.maximum.accumulate(np.where(value.is_valid().to_numpy(zero_copy_only=False), at, -1))
            known = (source >= 0) & (source >= start)
            out = value.take(pa.array(np.where(known, source, 0), mask=~known))
            if held is not None:
                # rows before the first start and value of the batch go on from the one before
                on = (start < 0) & (source < 0)
                out = pc.if_else(pa.array(on), pa.scalar(held, value.type), out)
            # the group of a partition's very first row may have begun in the partition before
            own = np.where(start >= 0, (start > 0) | (group is not None), began)
            yield pa.RecordBatch.from_arrays([*b.columns, out, pa.array(own), pa.array(np.full(n, part, dtype=np.int32))], [*b.schema.names, "carried", "__own", "__part"])
            group, held, began = last, out[n - 1].as_py(), bool(own[-1])

    return go


def carry(df: DataFrame, order: list[str], value: str, group: list[str]) -> DataFrame:
    """df with carried: the last non-null `value` at or before each row within its group, by order.

    group is a leading part of the order. Where a group goes on from the partition before, the value
    comes from the last of the earlier partitions that has one; there is one such row per partition,
    for only the first group of a partition can have begun before it. That bound is checked by a count.
    """
    from tidelog.operators.skew import lookup_join

    kind = dict(df.dtypes)[value]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = cut(rows.mapInArrow(_carried([df.columns.index(g) for g in group], df.columns.index(value)), _schema(df, f"carried {kind}, __own boolean, __part int")), "carried")
    need = cut(t.where(F.col("carried").isNull() & ~F.col("__own")).select(*group, "__part").distinct(), "borders")
    # the last value of a partition's last group; the groups of the borders alone can need it
    last = lookup_join(t.where(F.col("carried").isNotNull()), need.select(*group).distinct(), group, "left_semi") if group else t.where(F.col("carried").isNotNull())
    last = last.groupBy(*group, "__part").agg(F.max_by("carried", F.struct(*[c for c in order if c not in group])).alias("v"))
    found = need.alias("n").join(last.alias("l"), [F.col(f"n.{g}") == F.col(f"l.{g}") for g in group] + [F.col("l.__part") < F.col("n.__part")])
    found = found.groupBy(*[F.col(f"n.{g}") for g in group], F.col("n.__part")).agg(F.max_by("l.v", "l.__part").alias("__v"))
    return lookup_join(t, found, [*group, "__part"], "left").withColumn("carried", F.coalesce("carried", "__v")).select(*df.columns, "carried")


def asof(probes: DataFrame, entries: DataFrame, group: list[str], key: str, backward: bool = True) -> DataFrame:
    """Each probe (group, key) with match: the greatest entry key at or before it, or the least at or after.

    A sorted merge of both sides in one pass; repeated probes come out as often as they are there,
    repeated entries change nothing, null keys match nothing. Ties count as matches.
    """
    cols = [*group, key]
    e = entries.select(*cols).where(F.col(key).isNotNull()).select(*cols, F.col(key).alias("__entry"), F.lit(0 if backward else 1).alias("__side"))
    p = probes.select(*cols).select(*cols, F.lit(None).cast(dict(e.dtypes)["__entry"]).alias("__entry"), F.lit(1 if backward else 0).alias("__side"))
    both = e.unionByName(p)
    if backward:
        merged = carry(both, [*cols, "__side"], "__entry", group)
    else:
        merged = _carry_back(both, cols, group)
    return merged.where(F.col("__entry").isNull()).select(*cols, F.when(F.col(key).isNotNull(), F.col("carried")).alias("match"))


def _carry_back(both: DataFrame, cols: list[str], group: list[str]) -> DataFrame:
    """carry in descending order of the key: the rank of each row counts down."""
    ranked = running(both, [*cols, "__side"], None, group)
    down = ranked.withColumn("__down", F.col("group_rows") - F.col("idx")).drop("idx", "before", "group_rows")
    return carry(down, [*group, "__down"], "__entry", group)
