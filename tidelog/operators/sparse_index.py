"""Sparse index and summary of sorted runs, and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import asof, running

RUN = ["store_id", "level", "table_id"]


def sparse_index(records: DataFrame, size: str, degree: int = 5, group: list[str] = RUN, order: tuple[str, ...] = ()) -> DataFrame:
    """(group, key, offset, idx, entries): every degree-th record of each run from the first, and its last.

    offset is the sum of `size` over the records before it. order breaks ties between equal keys. A
    run of any length is numbered by many tasks.
    """
    if degree < 1:
        raise ValueError("degree must be at least 1")
    columns = list(dict.fromkeys([*group, "key", *order, size]))
    r = running(records.select(*columns), [*group, "key", *order], size, group)
    picked = r.where((F.col("idx") % degree == 0) | (F.col("idx") == F.col("group_rows") - 1))
    return picked.select(*group, "key", F.col("before").alias("offset"), "idx", F.col("group_rows").alias("entries"))


def summary(index: DataFrame, degree: int = 5, group: list[str] = RUN) -> DataFrame:
    """(group, key, idx): every degree-th entry of the index; the last is not forced."""
    r = running(index.select(*group, "key", F.col("idx").alias("record")), [*group, "key", "record"], None, group)
    return r.where(F.col("idx") % degree == 0).select(*group, "key", "idx")


def ranges(records: DataFrame, group: list[str] = RUN) -> DataFrame:
    """(group, start_key, end_key, rows): the key range of each run."""
    return records.groupBy(*group).agg(F.min("key").alias("start_key"), F.max("key").alias("end_key"), F.count(F.lit(1)).alias("rows"))


def floor_lookup(probes: DataFrame, index: DataFrame, group: list[str]) -> DataFrame:
    """Each probe (group, key) with match, the last index key at or before it."""
    return asof(probes, index, group, "key", backward=True)
