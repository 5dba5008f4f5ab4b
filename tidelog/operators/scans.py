"""Ordered scans: ranges, prefixes, pages, cursors and seeks."""

from __future__ import annotations

from collections.abc import Iterator

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.lww import ORDER, live, lww, user_keys
from tidelog.schema import reserved


def prefix_filter(prefix: str | bytes, col: str = "key") -> Column:
    return F.startswith(F.col(col), F.lit(prefix))


def range_scan(df: DataFrame, low, high, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Live rows of user keys from low to high, both included; low > high gives none. Not sorted."""
    return live(user_keys(df.where(F.col("key").between(low, high))), by, order)


def prefix_scan(df: DataFrame, prefix, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Live rows of user keys with a prefix; the empty prefix means all. Not sorted."""
    return live(user_keys(df.where(prefix_filter(prefix))), by, order)


def first_records(df: DataFrame, max_records: int | None, by: tuple[str, ...] = ("key",), group: tuple[str, ...] = ()) -> DataFrame:
    """The first max_records rows of each group in key order, all for None or -1, none for 0.

    The engine limits each group within each task before anything is shuffled, so what moves is
    bounded by tasks times max_records.
    """
    if max_records is None or max_records == -1:
        return df
    if max_records < 0:
        raise ValueError("max_records must be at least 0, or -1 for all")
    if not group:
        return df.orderBy(*by).limit(max_records)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*by))
    return df.withColumn("__place", place).where(F.col("__place") <= max_records).drop("__place")


def range_records(df: DataFrame, low, high, max_records: int | None = None, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Newest rows of user keys from low to high, tombstones kept: what a scan of memtables or runs gives to its merge."""
    got = lww(user_keys(df.where(F.col("key").between(low, high))), by, order)
    return first_records(got, max_records, ("key",), tuple(c for c in by if c != "key"))


def prefix_records(df: DataFrame, prefix: str | bytes, max_records: int | None = None, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Newest rows of user keys with a prefix, tombstones kept; a reserved prefix gives none."""
    rows = df.where(prefix_filter(prefix)) if not reserved(prefix if isinstance(prefix, str) else prefix.decode("latin-1")) else df.where(F.lit(False))
    got = lww(user_keys(rows), by, order)
    return first_records(got, max_records, ("key",), tuple(c for c in by if c != "key"))


RUN = ("store_id", "level", "table_id")


def run_range_scan(records: DataFrame, low, high, max_records: int | None = None, run: tuple[str, ...] = RUN) -> DataFrame:
    """Each run's own records of user keys from low to high, its first max_records; tombstones and older versions kept."""
    return first_records(user_keys(records.where(F.col("key").between(low, high))), max_records, ("key",), run)


def run_prefix_scan(records: DataFrame, prefix: str | bytes, max_records: int | None = None, run: tuple[str, ...] = RUN) -> DataFrame:
    """Each run's own records of user keys with a prefix, its first max_records; tombstones and older versions kept."""
    return first_records(user_keys(records.where(prefix_filter(prefix))), max_records, ("key",), run)


def page_after(df: DataFrame, after: dict | None, size: int, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The page that follows the row `after` (the `by` columns), the first one for None.

    The place goes into the scan as a filter, so a page deep in a large scan costs no more than the first.
    """
    if size < 1:
        raise ValueError("page size starts at 1")
    if after:
        tests = [reduce(lambda a, b: a & b, [*(F.col(c) == after[c] for c in by[:i]), F.col(by[i]) > after[by[i]]]) for i in range(len(by))]
        df = df.where(reduce(lambda a, b: a | b, tests) & (F.col(by[0]) >= after[by[0]]))
    return df.orderBy(*by).limit(size)


def page(df: DataFrame, number: int, size: int, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Page `number`, from 1, in key order; the last one may be short, one beyond the end is empty.

    A top-k of number * size rows per task, not a sort of the whole scan; for pages far on see page_after.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*by).offset((number - 1) * size).limit(size)


class Cursor:
    """A lazy ordered cursor over a scan: partitions are fetched as they are reached."""

    def __init__(self, df: DataFrame, by: tuple[str, ...] = ("key",)):
        self._rows: Iterator | None = df.orderBy(*by).select("key", "value").toLocalIterator(prefetchPartitions=True)

    def next(self) -> tuple[str, bytes | None]:
        """The next entry; ('', None) at the end and after stop()."""
        row = next(self._rows, None) if self._rows is not None else None
        if row is None:
            self.stop()
            return "", None
        return row["key"], row["value"]

    def stop(self) -> None:
        self._rows = None

    def __iter__(self):
        while True:
            k, v = self.next()
            if self._rows is None:
                return
            yield k, v


def ceiling(df: DataFrame, key) -> DataFrame:
    """The row with the smallest key at or after `key`: a top-1, none if there is none."""
    return df.where(F.col("key") >= key).orderBy("key").limit(1)


def floor(df: DataFrame, key) -> DataFrame:
    """The row with the greatest key at or before `key`."""
    return df.where(F.col("key") <= key).orderBy(F.desc("key")).limit(1)


def first(df: DataFrame) -> DataFrame:
    """The row with the smallest key."""
    return df.where(F.col("key").isNotNull()).orderBy("key").limit(1)
