"""Token bucket: windows that begin with an event.

A bucket holds `most` tokens. An event at or after the window's begin plus the interval begins a new
window and refills the bucket; an event takes a token or is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import changes_of_group, running
from tidelog.operators.skew import lookup_join


def _windows(most: int, interval: int):
    """Rows come by limiter and ts; a window's rows are taken together, and what goes on is carried to the next batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        begin = left = 0
        for b in batches:
            if not b.num_rows:
                continue
            new, last = changes_of_group([b.column(0)], group)
            t, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            starts, allowed = np.empty(len(t), dtype=np.int64), np.empty(len(t), dtype=np.int64)
            edges = [*np.flatnonzero(new).tolist(), len(t)]
            for i, end in zip([0, *edges], edges):
                if i == end:
                    continue
                if new[i]:
                    begin, left = int(t[i]), most
                while i < end:
                    if begin + interval <= t[i]:
                        begin, left = int(t[i]), most
                    j = i + int(np.searchsorted(t[i:end], begin + interval))
                    taken = np.minimum(np.cumsum(n[i:j]), left)
                    starts[i:j], allowed[i:j] = begin, np.diff(taken, prepend=0)
                    left -= int(taken[-1])
                    i = j
            group = last
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(starts), pa.array(allowed)], ["limiter", "ts", "n", "window_start", "allowed"])

    return go


def admit(df: DataFrame, key: str, ts: str, most: int = 1024, interval: int = 60) -> DataFrame:
    """(limiter, ts, n, window_start, allowed): of the n events of a limiter in one second, how many are let through.

    The first event of a limiter begins its first window. Rows with a null key or ts are left out.
    Events are first counted by limiter and second, before and after one shuffle, so a limiter with a
    third of all rows has no more rows than seconds; each limiter's seconds are then gone through as
    a stream, in order, with three numbers of state.
    """
    if most < 1 or interval < 1:
        raise ValueError("most and interval must be at least 1")
    seconds = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key).cast("string").alias("limiter"), F.col(ts).cast("bigint").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    ordered = seconds.repartition("limiter").sortWithinPartitions("limiter", "ts")
    return ordered.mapInArrow(_windows(most, interval), "limiter string, ts bigint, n bigint, window_start bigint, allowed bigint")


def admit_each(df: DataFrame, key: str, ts: str, seq: str, most: int = 1024, interval: int = 60) -> DataFrame:
    """(limiter, ts, seq, allowed boolean): the single events, those of one second in the order of seq.

    Places within a second are numbered by many tasks, so one second of one limiter may hold any share of the rows.
    """
    each = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("limiter"), F.col(ts).cast("bigint").alias("ts"), F.col(seq).alias("seq"))
    got = admit(df, key, ts, most, interval).select("limiter", "ts", "n", F.col("allowed").alias("first"))
    placed = running(each, ["limiter", "ts", "seq"], None, ["limiter", "ts"])
    return lookup_join(placed, got, ["limiter", "ts"], "inner", spread=F.col("idx"), rows="n").select("limiter", "ts", "seq", (F.col("idx") < F.col("first")).alias("allowed"))
