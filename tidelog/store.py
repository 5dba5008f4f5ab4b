"""A key-value store over an append-only changelog and sorted runs, with sketches under reserved keys.

Single puts and deletes are buffered and appended as one file per bufferSize records; bulk puts are
one write. Reads see the buffer, the changelog that is not flushed yet, and the runs, and take the
newest record by (ts, seq). Flushing and compaction are calls of their own, or follow a put where
the memtable's size in the settings is reached.
"""

from __future__ import annotations

import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import Config, validate
from tidelog.functions.encoding import record_size
from tidelog.functions.hashing import fnv_array, seeded_state
from tidelog.operators import bloom, cms, hll, scans, simhash
from tidelog.operators.lww import live, multi_get
from tidelog.operators.lru import Cache
from tidelog.operators.ordered import running
from tidelog.schema import CHANGELOG, RESERVED_KEY, RESERVED_PREFIXES, reserved
from tidelog.sources import files
from tidelog.sources.runs import Runs


class RateLimitReached(RuntimeError):
    def __init__(self):
        super().__init__("rate limit reached")


class Store:
    """rate_limited=True guards each public call by the token bucket of the settings; otherwise it is left out.

    With SSTable.compression each flush adds its new keys to the store's dictionary; verified=True notes a
    Merkle root for each run. Memtable.structure and SSTable.singleFile name layouts of which the engine
    has one: a memtable is the unflushed part of the log, a run a folder of Parquet files.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, rate_limited: bool = False, clock=time.time, seed: int = 1, verified: bool = False):
        self.spark, self.root, self.config, self.clock, self.seed = spark, root.rstrip("/"), config or Config(), clock, seed
        validate(self.config)
        c = self.config.SSTable
        self.runs = Runs(spark, f"{self.root}/runs", c.filterPrecision, c.indexDegree, c.summaryDegree, c.merkleTreeChunkSize if verified else None)
        self.cache = Cache(self.config.Cache.maxSize)
        self.rate_limited = rate_limited
        self._buffer: list[tuple] = []
        self._batches = self._listed()
        self._unflushed = 0
        top = self._log().agg(F.max("seq")).first()[0] if self._batches else None
        self._seq = max(top if top is not None else -1, self.runs.flushed_seq()) + 1
        self._unflushed = self._log().count() if self._batches else 0

    # --- the log ---

    def _listed(self) -> list[str]:
        return [f"{self.root}/log/{n}" for n in files.names(self.spark, f"{self.root}/batches") if not n.startswith("_")]

    def _log(self) -> DataFrame:
        rows = self.spark.read.schema(CHANGELOG).parquet(*self._batches) if self._batches else self.spark.createDataFrame([], CHANGELOG)
        return rows.unionByName(self.spark.createDataFrame(self._buffer, CHANGELOG)) if self._buffer else rows

    def _append(self, df: DataFrame) -> None:
        """Write a batch, then its entry; without that it is not there."""
        name = f"{self._seq:020d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/log/{name}")
        if not files.publish(self.spark, f"{self.root}/batches/{name}", ""):
            raise RuntimeError(f"batch {name} is there already")
        self._batches.append(f"{self.root}/log/{name}")

    def empty_buffer(self) -> None:
        """Write the buffered records to the log."""
        if self._buffer:
            rows, self._buffer = self._buffer, []
            self._append(self.spark.createDataFrame(rows, CHANGELOG).coalesce(1))

    def changes(self, low: str = "", high: str | None = None) -> DataFrame:
        """Every record that a key from low to high may have: of the runs whose key range meets it, of log and buffer."""
        return self.runs.read(self.runs.holding(low, high)).unionByName(self._log())

    def _record(self, key: str, value: bytes | None, tombstone: bool) -> None:
        self._buffer.append((key, bytearray(value) if value is not None else None, tombstone, int(self.clock()), self._seq))
        self._seq += 1
        self._unflushed += 1
        if len(self._buffer) >= self.config.WAL.bufferSize:
            self.empty_buffer()
        if self._unflushed >= self.config.Memtable.maxSize * self.config.Memtable.instances:
            self.flush()
            self.compact()

    def flush(self):
        """Make a run of the log; None if there is nothing in it."""
        self.empty_buffer()
        if not self._batches:
            return None
        run = self.runs.add(self._log(), self._seq - 1)
        if self.config.SSTable.compression:
            self._learn_keys(self._log())
        self._drop_log()
        return run

    def _drop_log(self) -> None:
        old, self._batches, self._unflushed = self._batches, [], 0
        for p in old:
            files.remove(self.spark, f"{self.root}/batches/{p.rpartition('/')[2]}")
            files.remove(self.spark, p)

    def clear_memtables(self) -> None:
        """Give up every record that is not in a run yet."""
        self._buffer, self.cache = [], Cache(self.config.Cache.maxSize)
        self._drop_log()

    # --- the key dictionary ---

    def dictionary(self) -> DataFrame:
        """(key, idx) of every key that was ever flushed, numbered by first appearance."""
        parts = [f"{self.root}/dictionary/{n}" for n in files.names(self.spark, f"{self.root}/dictionary-parts") if not n.startswith("_")]
        return self.spark.read.schema("key string, idx bigint").parquet(*parts) if parts else self.spark.createDataFrame([], "key string, idx bigint")

    def _learn_keys(self, rows: DataFrame) -> None:
        """Number the keys that are new, behind those that are known, in the order in which they first appear."""
        known = self.dictionary()
        top = known.agg(F.max("idx")).first()[0]
        first = 0 if top is None else top + 1
        new = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("seq").alias("seq")).join(known, "key", "left_anti")
        folder = f"{first:020d}-{uuid.uuid4().hex}"
        running(new, ["seq", "key"]).select("key", (F.col("idx") + first).alias("idx")).write.parquet(f"{self.root}/dictionary/{folder}")
        files.publish(self.spark, f"{self.root}/dictionary-parts/{folder}", "")

    def space(self) -> tuple[int, int]:
        """Bytes of the runs with whole keys, and with numbers of the dictionary in their place; keys it lacks stay whole."""
        rows = self.runs.read().join(self.dictionary(), "key", "left")
        size = lambda *idx: record_size(F.col("key"), F.col("value"), F.coalesce("tombstone", F.lit(False)), F.col("ts"), *idx)
        packed = F.when(F.col("idx").isNull(), size()).otherwise(size(F.col("idx")))
        r = rows.agg(F.sum(size()).alias("plain"), F.sum(packed).alias("packed")).first()
        return r["plain"] or 0, r["packed"] or 0

    def compact(self) -> int:
        c = self.config.LSMTree
        if c.compactionAlgorithm == "Leveled":
            return self.runs.compact_leveled(c.Leveled.firstLevelTotalDataSize, c.Leveled.fanoutSize, c.maxLevel, c.Leveled.dataBlockSize)
        return self.runs.compact_size_tiered(c.SizeTiered.maxLsmNodesPerLevel, c.maxLevel)

    # --- guards ---

    def _guard(self, key: str | None = None) -> None:
        if self.rate_limited:
            self._take_token()
        if key is not None and reserved(key):
            raise ValueError("reserved key")

    def _take_token(self) -> None:
        """The bucket is a value of the store: most, left, interval, begin, 8 bytes each; its limits outlive the settings."""
        blob, now = self._get(RESERVED_KEY), int(self.clock())
        t = self.config.TokenBucket
        most, left, interval, begin = np.frombuffer(blob, dtype="<i8").tolist() if blob else (t.maxTokenSize, t.maxTokenSize, t.interval, now)
        if begin + interval <= now:
            begin, left = now, most
        allowed = left > 0
        self._put(RESERVED_KEY, np.array([most, left - allowed, interval, begin], dtype="<i8").tobytes())
        if not allowed:
            raise RateLimitReached

    # --- points ---

    def _get(self, key: str) -> bytes | None:
        if key in self.cache:
            return self.cache.get(key)
        got = scans_first(live(self.changes(key, key).where(F.col("key") == key)))
        value = None if got is None else bytes(got["value"] or b"")
        if got is not None:
            self.cache.put(key, value)
        return value

    def _put(self, key: str, value: bytes) -> None:
        self._record(key, value, False)
        self.cache.put(key, bytes(value))

    def _delete(self, key: str) -> None:
        self._record(key, None, True)
        self.cache.put(key, None)

    def get(self, key: str) -> bytes | None:
        """The value, or None if the key is missing or deleted."""
        self._guard(key)
        return self._get(key)

    def put(self, key: str, value: bytes) -> None:
        self._guard(key)
        self._put(key, value)

    def delete(self, key: str) -> None:
        """Also of a key that is not there."""
        self._guard(key)
        self._delete(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value, present) of each distinct key."""
        self._guard()
        return multi_get(self.changes(), keys).select("key", "value", "present")

    def put_batch(self, df: DataFrame, order: list[str] | None = None) -> None:
        """Write rows (key, value[, tombstone]) as one batch; later rows by `order` win among equal keys. Reserved and null keys are an error."""
        from tidelog.schema import is_reserved

        self._guard()
        order = order or ["key"]
        if not df.where(F.col("key").isNull() | is_reserved(F.col("key"))).isEmpty():
            raise ValueError("null or reserved key")
        rows = df if "tombstone" in df.columns else df.withColumn("tombstone", F.lit(False))
        placed = running(rows, list(dict.fromkeys([*order, "key"])))
        out = placed.select("key", F.col("value").cast("binary").alias("value"), "tombstone", F.lit(int(self.clock())).cast("bigint").alias("ts"), (F.col("idx") + self._seq).alias("seq"))
        self.empty_buffer()
        self._append(out)
        n = self.spark.read.parquet(self._batches[-1]).count()
        self._seq += n
        self._unflushed += n
        self.cache = Cache(self.config.Cache.maxSize)

    # --- scans ---

    def range_scan(self, low: str, high: str, page: int = 1, size: int = 30) -> list[tuple[str, bytes]]:
        self._guard()
        got = scans.page(scans.range_scan(self.changes(low, high), low, high).select("key", "value"), page, size)
        return [(r["key"], bytes(r["value"] or b"")) for r in got.collect()]

    def prefix_scan(self, prefix: str, page: int = 1, size: int = 30) -> list[tuple[str, bytes]]:
        self._guard()
        got = scans.page(scans.prefix_scan(self.changes(prefix), prefix).select("key", "value"), page, size)
        return [(r["key"], bytes(r["value"] or b"")) for r in got.collect()]

    def range_iterate(self, low: str, high: str) -> scans.Cursor:
        self._guard()
        return scans.Cursor(scans.range_scan(self.changes(low, high), low, high))

    def prefix_iterate(self, prefix: str) -> scans.Cursor:
        self._guard()
        return scans.Cursor(scans.prefix_scan(self.changes(prefix), prefix))

    # --- sketches ---

    def _sketch(self, kind: str, key: str, name: str) -> bytes:
        self._guard()
        blob = self._get(RESERVED_PREFIXES[kind] + key)
        if blob is None:
            raise KeyError(f"no {name} with given key")
        return blob

    def _drop(self, kind: str, key: str) -> None:
        self._guard()
        self._delete(RESERVED_PREFIXES[kind] + key)

    def new_bf(self, key: str, n: int, p: float) -> None:
        """A filter for n values; an older one under the key is replaced."""
        self._guard()
        m, k = bloom.sizing(n, p)
        self._put(RESERVED_PREFIXES["bloom"] + key, bloom.serialize(m, k, 0, self.seed, np.zeros((m + 7) // 8, np.uint8)))

    def delete_bf(self, key: str) -> None:
        self._drop("bloom", key)

    def _places(self, value: str | bytes, seeds: list[int], m: int) -> list[int]:
        import pyarrow as pa

        raw = value.encode() if isinstance(value, str) else value
        return [int(fnv_array(pa.array([raw], pa.binary()), seeded_state(s))[0] % np.uint64(m)) for s in seeds]

    def bf_add(self, key: str, value: str | bytes) -> None:
        m, k, size, seeds, table = bloom.deserialize(self._sketch("bloom", key, "bf"))
        table = table.copy()
        for pos in self._places(value, seeds, m):
            table[pos >> 3] |= 1 << (pos & 7)
        self._put(RESERVED_PREFIXES["bloom"] + key, bloom.serialize(m, k, size + 1, seeds[0], table))

    def bf_add_all(self, key: str, df: DataFrame, column: str) -> None:
        """Add a column's values in one aggregation."""
        m, k, size, seeds, table = bloom.deserialize(self._sketch("bloom", key, "bf"))
        new = bloom.bitmap(bloom.build(df, column, m, k, seeds[0]), m)
        self._put(RESERVED_PREFIXES["bloom"] + key, bloom.serialize(m, k, size + df.where(F.col(column).isNotNull()).count(), seeds[0], table | new))

    def bf_has_key(self, key: str, value: str | bytes) -> bool:
        m, k, _, seeds, table = bloom.deserialize(self._sketch("bloom", key, "bf"))
        return all(table[pos >> 3] >> (pos & 7) & 1 for pos in self._places(value, seeds, m))

    def new_cms(self, key: str, epsilon: float, delta: float) -> None:
        self._guard()
        rows, cols = cms.sizing(epsilon, delta)
        head = rows.to_bytes(4, "little") + cols.to_bytes(4, "little") + b"".join((self.seed + i).to_bytes(8, "little") for i in range(rows))
        self._put(RESERVED_PREFIXES["cms"] + key, head + bytes(8 * rows * cols))

    def delete_cms(self, key: str) -> None:
        self._drop("cms", key)

    def _cms(self, key: str):
        """Counters are 8 bytes wide here, so they do not wrap."""
        blob = self._sketch("cms", key, "cms")
        rows, cols = (int.from_bytes(blob[i : i + 4], "little") for i in (0, 4))
        seeds = [int.from_bytes(blob[8 + 8 * i : 16 + 8 * i], "little") for i in range(rows)]
        return blob[: 8 + 8 * rows], seeds, np.frombuffer(blob[8 + 8 * rows :], dtype="<i8").reshape(rows, cols).copy()

    def cms_add(self, key: str, value: str | bytes) -> None:
        head, seeds, table = self._cms(key)
        for i, c in enumerate(self._places(value, seeds, table.shape[1])):
            table[i, c] += 1
        self._put(RESERVED_PREFIXES["cms"] + key, head + table.tobytes())

    def cms_add_all(self, key: str, df: DataFrame, column: str) -> None:
        head, seeds, table = self._cms(key)
        for r in cms.build(df, column, *table.shape, seeds[0]).toLocalIterator():
            table[r["row"], r["col"]] += r["cnt"]
        self._put(RESERVED_PREFIXES["cms"] + key, head + table.tobytes())

    def cms_get(self, key: str, value: str | bytes) -> int:
        _, seeds, table = self._cms(key)
        return int(min(table[i, c] for i, c in enumerate(self._places(value, seeds, table.shape[1]))))

    def new_hll(self, key: str, p: int) -> None:
        self._guard()
        if not 4 <= p <= 16:
            raise ValueError("p must be in 4..16")
        self._put(RESERVED_PREFIXES["hll"] + key, hll.serialize({}, p, self.seed))

    def delete_hll(self, key: str) -> None:
        self._drop("hll", key)

    def hll_add(self, key: str, value: str | bytes) -> None:
        import hashlib

        p, regs, seed = hll.deserialize(self._sketch("hll", key, "hll"))
        raw = value.encode() if isinstance(value, str) else value
        h = int(hashlib.md5(seed.to_bytes(8, "little") + raw).hexdigest()[:16], 16)
        b, r = h >> (64 - p), (h & -h).bit_length() if h else 65
        self._put(RESERVED_PREFIXES["hll"] + key, hll.serialize(regs | {b: max(regs.get(b, 0), r)}, p, seed))

    def hll_add_all(self, key: str, df: DataFrame, column: str) -> None:
        p, regs, seed = hll.deserialize(self._sketch("hll", key, "hll"))
        for r in hll.registers(df, column, p, seed).toLocalIterator():
            regs[r["bucket"]] = max(regs.get(r["bucket"], 0), r["reg"])
        self._put(RESERVED_PREFIXES["hll"] + key, hll.serialize(regs, p, seed))

    def hll_estimate(self, key: str) -> float:
        p, regs, _ = hll.deserialize(self._sketch("hll", key, "hll"))
        rows = self.spark.createDataFrame(list(regs.items()), "bucket bigint, reg int")
        return hll.estimate(rows, p).first()["estimate"]

    def sh_add_fingerprint(self, key: str, text: str) -> None:
        self._guard()
        df = simhash.fingerprints(self.spark.createDataFrame([(0, text)], "doc_id bigint, text string")).first()
        if df["fingerprint"] is None:
            raise ValueError("the text has no words")
        self._put(RESERVED_PREFIXES["simhash"] + key, df["fingerprint"].to_bytes(8, "little", signed=True))

    def sh_delete_fingerprint(self, key: str) -> None:
        self._drop("simhash", key)

    def sh_hamming_distance(self, a: str, b: str) -> int:
        x, y = (int.from_bytes(self._sketch("simhash", k, "sh"), "little") for k in (a, b))
        return (x ^ y).bit_count()

    def close(self) -> None:
        self.empty_buffer()


def scans_first(df: DataFrame):
    rows = df.limit(1).collect()
    return rows[0] if rows else None
