"""Most frequent items among billions.

Method: external sort and run-length counting. Each task sorts its rows (spilling as it must) and
writes runs with their lengths to the shared folder; the runs are range-partitioned by value, merged
in order with combined lengths, and each range keeps a bounded heap per group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut


def _starts(cols: list[pa.Array], n: int) -> np.ndarray:
    """Places where a new run begins; the columns have no nulls."""
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in cols:
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, item, n) of sorted (grp, item); a run that goes on in the next batch is written twice."""
    for b in batches:
        if b.num_rows:
            at = _starts([b.column(0), b.column(1)], b.num_rows)
            n = np.diff(np.append(at, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(n)], ["grp", "item", "n"])


def _heads(k: int):
    """From sorted runs, the k greatest combined ones of each group in this range."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[int, bytes]] = []
        group = open_item = None
        open_n = 0

        def push(n: int, item: bytes) -> None:
            if len(heap) < k:
                heapq.heappush(heap, (n, item))
            elif (n, item) > heap[0]:
                heapq.heapreplace(heap, (n, item))

        def flush():
            if open_item is not None:
                push(open_n, open_item)
            if heap:
                top = sorted(heap, reverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(top), pa.int64()), pa.array([i for _, i in top], pa.binary()), pa.array([n for n, _ in top], pa.int64())], ["grp", "item", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            g, items, n = b.column(0), b.column(1), b.column(2).to_numpy()
            at = _starts([g, items], b.num_rows)
            sums = np.add.reduceat(n, at)
            groups = g.take(pa.array(at)).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(groups, prepend=groups[0] - 1)), len(at))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                first, here = lo, int(groups[lo])
                if here != group:
                    yield from flush()
                    heap.clear()
                    group, open_item, open_n = here, None, 0
                item = items[int(at[first])].as_py()
                if open_item is not None and item == open_item:
                    open_n += int(sums[first])
                    first += 1
                if first < hi:
                    if open_item is not None:
                        push(open_n, open_item)
                    # the last run stays open; of the others only the k greatest can enter
                    inner = np.arange(first, hi - 1)
                    if len(inner) > k:
                        edge = np.partition(sums[inner], len(inner) - k)[len(inner) - k]
                        inner = inner[sums[inner] >= edge]
                    if len(heap) == k:
                        inner = inner[sums[inner] >= heap[0][0]]
                    for i in inner:
                        push(int(sums[i]), items[int(at[i])].as_py())
                    open_item, open_n = items[int(at[hi - 1])].as_py(), int(sums[hi - 1])
        yield from flush()

    return go


SCHEMA = "grp bigint, item binary, n bigint"


def sorted_runs(df: DataFrame, group: str, item: str) -> DataFrame:
    """(grp, item, n): the sorted runs of each task, on disk. Rows with a null group or item are left out."""
    pairs = df.where(F.col(item).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("bigint").alias("grp"), F.col(item).cast("binary").alias("item"))
    return cut(pairs.sortWithinPartitions("grp", "item").mapInArrow(_runs, SCHEMA), "runs")


def heads(runs: DataFrame, k: int) -> DataFrame:
    """(grp, item, n) with at least the k most frequent items of each group, with exact counts.

    A hot item is one run a batch by then, so its range holds few rows. Memory is k items a task, for
    a group is finished before the next begins. Of items with equal counts the greater in byte order
    is kept first. Every item is in exactly one range, so its count is whole.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    return runs.repartitionByRange("grp", "item").sortWithinPartitions("grp", "item").mapInArrow(_heads(k), SCHEMA)


def frequent_items(df: DataFrame, group: str, item: str, one_in: int = 50) -> DataFrame:
    """(grp, item, n, total): the items with at least one in `one_in` of their group's rows.

    At most `one_in` items of a group can have so many, so heaps of that size lose none. An empty
    table gives no rows.
    """
    runs = sorted_runs(df, group, item)
    totals = runs.groupBy("grp").agg(F.sum("n").alias("total"))
    return heads(runs, one_in).join(totals, "grp").where(F.col("n") * one_in >= F.col("total"))


def top_items(df: DataFrame, group: str, item: str, k: int = 10) -> DataFrame:
    """(grp, item, n, rank): the k most frequent items of each group; ties in byte order, greater first."""
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy(F.desc("n"), F.desc("item"))
    return heads(sorted_runs(df, group, item), k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
