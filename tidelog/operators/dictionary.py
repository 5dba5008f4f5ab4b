"""Key dictionary: keys to numbers in the order of their first appearance, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import running
from tidelog.operators.skew import heavy_left_join


def build(df: DataFrame, key: str = "key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(key, idx, n): idx from 0 by the first appearance of each non-null key, n how often it comes.

    Keys that first appear together are in key order. Numbered by many tasks, not one.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("n"))
    flat = first.select("key", *[F.col(f"f.{c}").alias(f"o{i}") for i, c in enumerate(order)], "n")
    return running(flat, [*[f"o{i}" for i in range(len(order))], "key"]).select("key", "idx", "n")


def encode(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """df with idx instead of key; -1 for keys that aren't in the dictionary, null for null. df is read once."""
    got = heavy_left_join(df, dictionary.select("key", "idx", "n"), "key", "n")
    return got.withColumn("idx", F.when(F.col("key").isNotNull(), F.coalesce("idx", F.lit(-1).cast("bigint")))).drop("key")


def decode(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """df with key instead of idx; null for a number that is not in the dictionary. df is read once."""
    return heavy_left_join(df, dictionary.select("idx", "key", "n"), "idx", "n").drop("idx")
