"""Merkle trees over ordered chunks, as a relation (level, idx, hash).

Level 0 has sha1(sha1(chunk)) of each chunk; a parent is sha1 of its children's hashes, a missing
right child being 20 zero bytes, up to one node. A single chunk still gets a parent.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut

#: Levels that one task builds at a time, over 2^HEIGHT neighbours.
HEIGHT = 12
_NONE = bytes(20)


def leaves(chunks: DataFrame) -> DataFrame:
    """(level, idx, hash) of chunks (idx bigint from 0 without gaps, chunk binary or string)."""
    once = F.unhex(F.sha1(F.coalesce(F.col("chunk").cast("binary"), F.lit(b""))))
    return chunks.select(F.lit(0).alias("level"), "idx", F.unhex(F.sha1(once)).alias("hash"))


def _build(levels: int, base: int):
    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        at, row = t.column("idx")[0].as_py(), t.column("hash").to_pylist()
        out: list[tuple[int, int, bytes]] = []
        for k in range(1, levels + 1):
            row = [hashlib.sha1(row[i] + (row[i + 1] if i + 1 < len(row) else _NONE)).digest() for i in range(0, len(row), 2)]
            at >>= 1
            out += [(base + k, at + i, h) for i, h in enumerate(row)]
        lv, ix, hs = zip(*out)
        return pa.table({"level": pa.array(lv, pa.int32()), "idx": pa.array(ix, pa.int64()), "hash": pa.array(hs, pa.binary())})

    return go


def tree(chunks: DataFrame) -> DataFrame:
    """All nodes (level, idx, hash). No chunks, no nodes.

    Subtrees over 2^HEIGHT aligned neighbours are built by one task each, so a group is bounded and
    the levels cost one shuffle per HEIGHT of them.
    """
    level0 = cut(leaves(chunks), "merkle")
    out, base, n, here = level0, 0, level0.count(), level0
    if not n:
        return level0
    while True:
        height, width = 0, n
        while height < HEIGHT and (width > 1 or base + height == 0):
            width, height = (width + 1) // 2, height + 1
        group = F.shiftright("idx", height)
        built = cut(here.withColumn("g", group).groupBy("g").applyInArrow(_build(height, base), "level int, idx bigint, hash binary"), "merkle")
        out = out.unionByName(built)
        base, n = base + height, width
        if n == 1:
            return out
        here = built.where(F.col("level") == base)


def root(nodes: DataFrame) -> DataFrame:
    """(root, levels): the top node's hash in hex."""
    top = F.max(F.struct("level", "hash")).alias("t")
    return nodes.agg(top).where("t IS NOT NULL").select(F.lower(F.hex("t.hash")).alias("root"), F.col("t.level").cast("bigint").alias("levels"))


def contains(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """The hashes (hash) that are in the tree."""
    return hashes.join(nodes.select("hash"), "hash", "left_semi")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, idx, a_hash, b_hash) of all nodes that differ or are in one tree only."""
    l, r = a.select("level", "idx", F.lower(F.hex("hash")).alias("a_hash")), b.select("level", "idx", F.lower(F.hex("hash")).alias("b_hash"))
    return l.join(r, ["level", "idx"], "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))


def serialize(nodes: DataFrame) -> DataFrame:
    """(place, hash): nodes in level order from the root, left to right; place counts from 0."""
    from tidelog.operators.ordered import running

    n = nodes.select((-F.col("level")).alias("up"), F.col("idx").alias("at"), "hash")
    return running(n, ["up", "at"]).select(F.col("idx").alias("place"), F.lower(F.hex("hash")).alias("hash"))
