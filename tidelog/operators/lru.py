"""What an LRU cache of a given capacity would have hit, over a long sequence of accesses.

The cache after a stretch of accesses is its last `capacity` distinct keys, followed by what was
there before. So the sequence is cut into chunks; each chunk's last distinct keys are found in
parallel. These lists combine associatively, so a tree over them, FAN wide, gives the cache at each
chunk's beginning, and each chunk is then run from there.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import running
from tidelog.session import cut


#: Lists that one task combines.
FAN = 64


class Cache:
    """Least-recently-used cache of a number of entries."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        self._capacity, self._entries = capacity, OrderedDict()

    def get(self, key, default=None):
        if key not in self._entries:
            return default
        self._entries.move_to_end(key)
        return self._entries[key]

    def put(self, key, value) -> None:
        self._entries[key] = value
        self._entries.move_to_end(key)
        if len(self._entries) > self._capacity:
            self._entries.popitem(last=False)

    def __contains__(self, key) -> bool:
        return key in self._entries

    def keys(self) -> list:
        """From the least to the most recently used."""
        return list(self._entries)


def _last_keys(capacity: int):
    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        last = list(dict.fromkeys(reversed(t.column("item").to_pylist())))[:capacity]
        return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int64()), "keys": pa.array([last], pa.list_(pa.string()))})

    return go


def _on(keys: list, state: list, capacity: int) -> list:
    """The cache after a stretch with these last keys, which began with that state; most recent first."""
    return list(dict.fromkeys(keys + state))[:capacity]


def _folded(capacity: int):
    def go(t: pa.Table) -> pa.Table:
        t, state = t.sort_by("pos"), []
        for keys in t.column("keys").to_pylist():
            state = _on(keys, state, capacity)
        return pa.table({"pos": t.column("g")[:1], "keys": pa.array([state], pa.list_(pa.string()))})

    return go


def _members(capacity: int):
    """Cache at the beginning of each of the stretches of a node, given the one at the node's."""

    def go(l: pa.Table, r: pa.Table) -> pa.Table:
        l, out = l.sort_by("pos"), []
        state = r.column("state")[0].as_py() if r.num_rows else []
        for keys in l.column("keys").to_pylist():
            out.append(state)
            state = _on(keys, state, capacity)
        return pa.table({"pos": l.column("pos"), "state": pa.array(out, pa.list_(pa.string()))})

    return go


def _states(lists: DataFrame, n: int, capacity: int, fan: int) -> DataFrame:
    """(pos, state) of lists (pos from 0, keys): one task has at most `fan` of them, whatever n."""
    g = lists.withColumn("g", F.expr(f"pos div {fan}"))
    if n <= fan:
        above = lists.sparkSession.createDataFrame([], "g bigint, state array<string>")
    else:
        up = cut(g.groupBy("g").applyInArrow(_folded(capacity), "pos bigint, keys array<string>"), "lru")
        above = _states(up, -(-n // fan), capacity, fan).withColumnRenamed("pos", "g")
    return g.groupBy("g").cogroup(above.groupBy("g")).applyInArrow(_members(capacity), "pos bigint, state array<string>")


def _run(capacity: int):
    def go(l: pa.Table, r: pa.Table) -> pa.Table:
        l = l.sort_by("idx")
        cache = Cache(capacity)
        for k in reversed(r.column("state")[0].as_py() if r.num_rows else []):
            cache.put(k, True)
        hit = []
        for k in l.column("item").to_pylist():
            hit.append(cache.get(k, False))
            cache.put(k, True)
        return l.select(["idx", "item"]).append_column("hit", pa.array(hit, pa.bool_()))

    return go


def hits(df: DataFrame, item: str, order: list[str], capacity: int, chunk: int | None = None, fan: int = FAN) -> DataFrame:
    """(idx, item, hit) of every access with a non-null item, in order; a miss brings the item into the cache.

    chunk, the accesses a task runs at a time, is 16 times the capacity at least, so the lists are a sixteenth of the
    accesses at most.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    chunk = chunk or max(16 * capacity, 65_536)
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), *order)
    seq = running(rows, [*order, "item"]).select("item", "idx").withColumn("chunk", F.expr(f"idx div {chunk}"))
    last = cut(seq.groupBy("chunk").applyInArrow(_last_keys(capacity), "chunk bigint, keys array<string>"), "lru")
    chunks = last.agg(F.max("chunk")).first()[0]
    states = _states(last.withColumnRenamed("chunk", "pos"), 0 if chunks is None else chunks + 1, capacity, fan).withColumnRenamed("pos", "chunk")
    return seq.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(_run(capacity), "idx bigint, item string, hit boolean")
