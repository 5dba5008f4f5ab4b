"""Count-Min sketches as relations (row, col, cnt)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import fnv1a64_many, umod
from tidelog.operators.skew import lookup_join


def sizing(epsilon: float, delta: float) -> tuple[int, int]:
    """(rows, cols) for an error of epsilon times the total with probability 1 - delta."""
    if epsilon <= 0 or delta <= 0:
        raise ValueError("epsilon and delta must be positive")
    return math.ceil(math.log(math.e / delta)), math.ceil(math.e / epsilon)


def _cells(keys: DataFrame, rows: int, cols: int, seed: int) -> DataFrame:
    h = fnv1a64_many(F.col("item"), [seed + i for i in range(rows)])
    return keys.select("*", F.posexplode(h).alias("row", "h")).withColumn("col", umod(F.col("h"), cols)).drop("h")


def build(df: DataFrame, key: str, rows: int, cols: int, seed: int = 1) -> DataFrame:
    """(row, col, cnt) over the non-null keys. Counts of distinct keys come first, so a hot key is hashed once."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return _cells(counts, rows, cols, seed).groupBy("row", "col").agg(F.sum("n").alias("cnt"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows of sketches with equal sizes and seed."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def estimate(items: DataFrame, sketch: DataFrame, rows: int, cols: int, seed: int = 1, wrap: int | None = None) -> DataFrame:
    """(item, estimate) for the distinct non-null items (column item, text): the least of its cells.

    wrap=256 gives what counters of one byte would say, at most 255. rows * cols bounds the sketch.
    """
    keys = items.select(F.col("item").cast("string").alias("item")).where("item IS NOT NULL").distinct()
    cnt = F.coalesce("cnt", F.lit(0))
    got = lookup_join(_cells(keys, rows, cols, seed), sketch, ["row", "col"], "left")
    return got.groupBy("item").agg(F.min(cnt % wrap if wrap else cnt).alias("estimate"))


def serialize(sketch: DataFrame, rows: int, cols: int, seed: int) -> bytes:
    """rows and cols as 4 bytes, a seed of 8 bytes a row, then one byte a cell, wrapped at 256; rows * cols bounds it."""
    table = np.zeros(rows * cols, dtype=np.uint8)
    for r in sketch.select("row", "col", (F.col("cnt") % 256).alias("c")).toLocalIterator():
        table[r["row"] * cols + r["col"]] = r["c"]
    return rows.to_bytes(4, "little") + cols.to_bytes(4, "little") + b"".join((seed + i).to_bytes(8, "little") for i in range(rows)) + table.tobytes()


def deserialize(blob: bytes) -> tuple[int, int, list[int], np.ndarray]:
    rows, cols = (int.from_bytes(blob[i : i + 4], "little") for i in (0, 4))
    seeds = [int.from_bytes(blob[8 + 8 * i : 16 + 8 * i], "little") for i in range(rows)]
    return rows, cols, seeds, np.frombuffer(blob[8 + 8 * rows :], dtype=np.uint8).reshape(rows, cols)
