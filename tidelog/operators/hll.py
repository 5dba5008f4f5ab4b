"""HyperLogLog as a relation (bucket, reg), with the classic estimator.

The bucket is the top p bits of a 64-bit hash, the register 1 + the trailing zeros of the hash. The
default hash is md5, for FNV-1a hardly moves its top bits with the last bytes of a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import fnv1a64, md5_64, trailing_zeros

HASHES = {"md5": md5_64, "fnv1a": fnv1a64}


def registers(df: DataFrame, key: str, p: int = 12, seed: int = 1, by: tuple[str, ...] = (), family: str = "md5") -> DataFrame:
    """(by, bucket, reg) of the non-null keys; at most 2^p rows a group, after partial aggregation too."""
    if not 4 <= p <= 16:
        raise ValueError("p must be in 4..16")
    h = df.where(F.col(key).isNotNull()).select(*by, HASHES[family](F.col(key).cast("string"), seed).alias("h"))
    cells = h.select(*by, F.shiftrightunsigned("h", 64 - p).alias("bucket"), (trailing_zeros(F.col("h")) + 1).cast("int").alias("reg"))
    return cells.groupBy(*by, "bucket").agg(F.max("reg").alias("reg"))


def union(*parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Registers of the union of sets with equal p, seed and hash."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy(*by, "bucket").agg(F.max("reg").alias("reg"))


def estimator(inverse_sum: Column, empty: Column, m: int) -> Column:
    """From the sum of 2^-reg over the set registers and the number of empty ones."""
    alpha = 0.7213 / (1 + 1.079 / m)
    raw = F.lit(alpha * m * m) / (inverse_sum + empty)
    large = F.lit(-(2.0**32)) * F.log(1 - raw / F.lit(2.0**32))
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / empty)
    return F.when((raw <= 2.5 * m) & (empty > 0), linear).when(raw > 2.0**32 / 30, large).otherwise(raw)


def estimate(regs: DataFrame, p: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, estimate); without groups an empty set is 0."""
    m = 1 << p
    got = regs.groupBy(*by).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("reg"))), F.lit(0.0)).alias("s"), (F.lit(m) - F.count(F.lit(1))).cast("double").alias("v"))
    return got.select(*by, estimator(F.col("s"), F.col("v"), m).alias("estimate"))


def standard_error(p: int) -> float:
    return 1.04 / math.sqrt(1 << p)


def serialize(regs: dict[int, int], p: int, seed: int) -> bytes:
    """p, m and m registers as 4 bytes each, 8 zero bytes and the seed of 8."""
    m = 1 << p
    return p.to_bytes(4, "little") + m.to_bytes(4, "little") + b"".join(regs.get(i, 0).to_bytes(4, "little") for i in range(m)) + bytes(8) + seed.to_bytes(8, "little")


def deserialize(blob: bytes) -> tuple[int, dict[int, int], int]:
    """(p, registers that are set, seed)."""
    p, m = (int.from_bytes(blob[i : i + 4], "little") for i in (0, 4))
    regs = {i: r for i in range(m) if (r := int.from_bytes(blob[8 + 4 * i : 12 + 4 * i], "little"))}
    return p, regs, int.from_bytes(blob[16 + 4 * m : 24 + 4 * m], "little")
