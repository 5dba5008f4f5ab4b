"""Last-write-wins state: point operations on a changelog.

A changelog is rows (key, value, tombstone, ts, seq) and possibly columns that name the store; the
order of writes is (ts, seq). Everything filters before it aggregates: a predicate on the key goes
into the scan, the tombstone filter comes after the newest row is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.skew import lookup_join
from tidelog.schema import is_reserved

ORDER = ("ts", "seq")


def lww(df: DataFrame, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """The newest row of each key, tombstones included.

    One shuffle on the key with partial aggregation before it, so a hot key costs one row a task. A
    null key is no entry. Equal order values are decided by the other columns, greatest last, so the
    result never depends on the order of the input.
    """
    rest = [c for c in df.columns if c not in by and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("r")
    keyed = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by]))
    return keyed.groupBy(*by).agg(newest).select(*[F.col("r." + c).alias(c) if c not in by else F.col(c) for c in df.columns])


def live(df: DataFrame, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """The newest row of each key that is not deleted; a null tombstone counts as none."""
    return lww(df, by, order).where(~F.coalesce("tombstone", F.lit(False)))


def user_keys(df: DataFrame) -> DataFrame:
    """Rows whose key is not reserved."""
    return df.where(~is_reserved(F.col("key")))


def get(df: DataFrame, key: str, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """The live row of one key, of each store; none if it is missing or deleted. The key goes to the scan."""
    return live(df.where(F.col("key") == key), by, order)


def multi_get(df: DataFrame, keys: DataFrame, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Each distinct row of keys (the `by` columns) with the value of its live row, null where there is none."""
    wanted = keys.select(*by).distinct()
    rows = lookup_join(df, wanted, list(by), "left_semi")
    return wanted.join(live(rows, by, order).select(*by, "value", F.lit(True).alias("present")), list(by), "left").withColumn("present", F.coalesce("present", F.lit(False)))


def overlay(df: DataFrame, changes: DataFrame) -> DataFrame:
    """The changelog with further puts and tombstones; columns by name, missing ones null."""
    return df.unionByName(changes, allowMissingColumns=True)
