"""Hashes: seeded FNV-1a 64 in Arrow batches, md5 as 64 bits, and unsigned arithmetic on BIGINT."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of FNV-1a 64.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def seeded_state(seed: int) -> int:
    """The FNV state after the eight bytes of the seed, least significant first."""
    h = FNV_BASIS
    for b in (seed & (1 << 64) - 1).to_bytes(8, "little"):
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def fnv_bytes(data: np.ndarray, offsets: np.ndarray, state: int) -> np.ndarray:
    """FNV-1a 64 of each slice of data, as uint64; one step per byte place over all slices that are so long."""
    n = len(offsets) - 1
    h = np.full(n, state, dtype=np.uint64)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    start, left = offsets[:-1][order], lengths[order]
    h_sorted = h[order]
    alive = n
    for i in range(int(left[0]) if n else 0):
        alive = int(np.searchsorted(-left[:alive], -i, side="left"))
        h_sorted[:alive] = (h_sorted[:alive] ^ data[start[:alive] + i]) * np.uint64(FNV_PRIME)
    h[order] = h_sorted
    return h


def fnv_array(a: pa.Array, state: int) -> np.ndarray:
    """uint64 hashes of a string or binary array; nulls are hashed as empty."""
    a = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return fnv_bytes(data, offsets, state)


def fnv1a64(col: Column, seed: int) -> Column:
    """Seeded FNV-1a 64 as a signed BIGINT; null for null. Hash distinct values where values repeat."""
    state = seeded_state(seed)

    @F.arrow_udf("bigint")
    def hashed(a: pa.Array) -> pa.Array:
        return pa.array(fnv_array(a, state).view(np.int64), mask=a.is_null().to_numpy(zero_copy_only=False))

    return hashed(col)


def fnv1a64_many(col: Column, seeds: list[int]) -> Column:
    """The hashes under each seed, an array<bigint> in the order of the seeds."""
    states = [seeded_state(s) for s in seeds]

    @F.arrow_udf("array<bigint>")
    def hashed(a: pa.Array) -> pa.Array:
        each = np.stack([fnv_array(a, s) for s in states], axis=1).view(np.int64)
        offsets = np.arange(0, (len(a) + 1) * len(states), len(states), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(each.reshape(-1)))

    return F.when(col.isNotNull(), hashed(col))


def md5_64(col: Column, seed: int) -> Column:
    """First 64 bits of md5(seed as 8 bytes, least significant first, then the value), signed. Inside codegen."""
    salt = F.lit((seed & (1 << 64) - 1).to_bytes(8, "little"))
    return F.conv(F.substring(F.md5(F.concat(salt, col.cast("binary"))), 1, 16), 16, -10).cast("bigint")


def umod(h: Column, m: int) -> Column:
    """h modulo m, h taken as unsigned."""
    wrap = (1 << 64) % m
    return F.when(h >= 0, h % F.lit(m)).otherwise(F.pmod(F.pmod(h, F.lit(m)) + F.lit(wrap), F.lit(m)))


def trailing_zeros(h: Column) -> Column:
    """Zero bits below the lowest one; 64 for 0."""
    low = F.bit_count(F.bitwise_not(h).bitwiseAND(h - 1))
    return F.when(h == 0, 64).when(h == F.lit(-(1 << 63)), 63).otherwise(low)
