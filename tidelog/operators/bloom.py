"""Bloom filters as relations of set bits; bit = hash(seed + i) mod m for i below k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import fnv1a64_many, fnv_array, seeded_state, umod

#: Bits up to which a filter is sent to the tasks as one bitmap (64 MB).
BITMAP_BITS = 1 << 29


def sizing(n: int, p: float) -> tuple[int, int]:
    """(m, k): bits and hashes for n keys and a rate p of false positives."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("n must be at least 1 and p between 0 and 1")
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def build(df: DataFrame, key: str, m: int, k: int, seed: int = 1) -> DataFrame:
    """(pos): the bits that the non-null keys set. Keys are made distinct before they are hashed."""
    keys = df.select(F.col(key).cast("string").alias("k")).where("k IS NOT NULL").distinct()
    return keys.select(F.explode(fnv1a64_many(F.col("k"), [seed + i for i in range(k)])).alias("h")).select(umod(F.col("h"), m).alias("pos")).distinct()


def union(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters with equal m, k and seed."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.distinct()


def bitmap(bits: DataFrame, m: int) -> np.ndarray:
    """The filter as bytes, bit pos being 1 << (pos & 7) of byte pos >> 3. m bounds what is collected."""
    if m > BITMAP_BITS:
        raise ValueError(f"a filter of {m} bits is not collected; probe() joins it")
    out = np.zeros((m + 7) // 8, dtype=np.uint8)
    t = bits.groupBy(F.shiftright("pos", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(pos % 8 as int))")).alias("v")).toArrow()
    out[t.column("byte").to_numpy()] = t.column("v").to_numpy()
    return out


def probe(df: DataFrame, key: str, bits: DataFrame, m: int, k: int, seed: int = 1, most_bits: int = BITMAP_BITS) -> DataFrame:
    """df with maybe: false means surely absent; null keys are absent.

    Up to most_bits the filter goes to the tasks as a bitmap of that size and the rows stay where they
    are. A larger one is joined: the distinct keys' places are shuffled to the bits, and the verdicts
    come back by key, hot ones salted.
    """
    if m <= most_bits:
        states, shared = [seeded_state(seed + i) for i in range(k)], df.sparkSession.sparkContext.broadcast(bitmap(bits, m))

        @F.arrow_udf("boolean")
        def has(a: pa.Array) -> pa.Array:
            table, ok = shared.value, ~a.is_null().to_numpy(zero_copy_only=False)
            for s in states:
                pos = fnv_array(a, s) % np.uint64(m)
                ok &= (table[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            return pa.array(ok)

        return df.withColumn("maybe", has(F.col(key).cast("string")))
    from tidelog.operators.skew import lookup_join

    keys = df.select(F.col(key).cast("string").alias("__k")).where("__k IS NOT NULL").groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    places = keys.select("__k", "__n", F.explode(fnv1a64_many(F.col("__k"), [seed + i for i in range(k)])).alias("h")).select("__k", "__n", umod(F.col("h"), m).alias("pos"))
    hits = places.join(bits.withColumn("hit", F.lit(True)), "pos", "left").groupBy("__k").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("maybe"), F.first("__n").alias("__n"))
    out = lookup_join(df.withColumn("__k", F.col(key).cast("string")), hits, ["__k"], "left", rows="__n").drop("__k", "__n")
    return out.withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def serialize(m: int, k: int, size: int, seed: int, table: np.ndarray) -> bytes:
    """m, k, size as 4 bytes each, k seeds of 8, then the length and bytes of the bitmap, least significant first."""
    head = b"".join(int(x).to_bytes(4, "little") for x in (m, k, size))
    return head + b"".join((seed + i).to_bytes(8, "little") for i in range(k)) + m.to_bytes(4, "little") + table.tobytes()


def deserialize(blob: bytes) -> tuple[int, int, int, list[int], np.ndarray]:
    """(m, k, size, seeds, bitmap)."""
    m, k, size = (int.from_bytes(blob[i : i + 4], "little") for i in (0, 4, 8))
    seeds = [int.from_bytes(blob[12 + 8 * i : 20 + 8 * i], "little") for i in range(k)]
    return m, k, size, seeds, np.frombuffer(blob[16 + 8 * k :], dtype=np.uint8)


def places(spark: SparkSession, table: np.ndarray) -> DataFrame:
    """(pos): the set bits of a bitmap."""
    at = np.flatnonzero(np.unpackbits(table, bitorder="little")).astype(np.int64)
    return spark.createDataFrame(pa.table({"pos": pa.array(at)}))


def native(df: DataFrame, key: str, n: int, p: float):
    """The engine's own filter, built in the JVM with treeAggregate; .mightContain(x) probes it."""
    return df._jdf.stat().bloomFilter(key, n, p)
