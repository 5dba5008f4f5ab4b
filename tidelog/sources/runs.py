"""Sorted runs as Parquet folders, and the manifest that lists them.

A run is range-partitioned and sorted by key, with a Bloom filter on the key in its footers, so a
point read skips runs by filter and row groups by their least and greatest keys. Each record carries
its checksum, and the manifest the root of the run's Merkle tree where one is asked for.

The manifest is a numbered file that is made at once and never overwritten; the greatest number is in
force. A crash before it leaves the old list, and of two writers that start from one list only one
gets its number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.encoding import record_bytes, record_crc, record_size
from tidelog.operators import bloom, merkle, scans, sparse_index
from tidelog.operators.compaction import size_tiered_plan, union_of_ranges
from tidelog.operators.lww import lww
from tidelog.operators.ordered import running
from tidelog.schema import CHANGELOG
from tidelog.sources import files

#: Rows of a run that one file of it should hold.
FILE_ROWS = 4_000_000
#: Manifests that are kept: the one in force and the one before, for readers that hold it.
KEPT = 2


def _size():
    return record_size(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))


def _crc():
    return record_crc(F.col("key"), F.col("value"), F.coalesce("tombstone", F.lit(False)), F.col("ts"))


@dataclass
class Run:
    level: int
    table_id: int
    path: str
    start_key: str
    end_key: str
    rows: int
    bytes: int
    last_seq: int
    merkle_root: str | None = None


class Runs:
    """The runs under root. The manifest has one entry a run.

    merkle_chunk: bytes of a data block in a leaf of a run's Merkle tree; None leaves the trees out.
    """

    def __init__(self, spark: SparkSession, root: str, precision: float = 0.01, index_degree: int = 5, summary_degree: int = 5, merkle_chunk: int | None = None):
        self.spark, self.root, self.precision = spark, root.rstrip("/"), precision
        self.index_degree, self.summary_degree, self.merkle_chunk = index_degree, summary_degree, merkle_chunk
        self._version = -1

    def _numbers(self) -> list[int]:
        return sorted(int(n[9:29]) for n in files.names(self.spark, self.root) if n.startswith("MANIFEST-") and n.endswith(".json"))

    def _manifest(self, number: int) -> str:
        return f"{self.root}/MANIFEST-{number:020d}.json"

    def list(self) -> list[Run]:
        numbers = self._numbers()
        self._version = numbers[-1] if numbers else -1
        if not numbers:
            return []
        return sorted((Run(**r) for r in json.loads(files.read_text(self.spark, self._manifest(numbers[-1])))), key=lambda r: (r.level, r.table_id))

    def _commit(self, runs: list[Run]) -> None:
        """Put a new list in force that follows from the last one that was read; an error if another writer was faster."""
        if not files.publish(self.spark, self._manifest(self._version + 1), json.dumps([asdict(r) for r in runs])):
            raise RuntimeError("the list of runs has changed meanwhile")
        self._version += 1
        for n in self._numbers()[:-KEPT]:
            files.remove(self.spark, self._manifest(n))

    def flushed_seq(self) -> int:
        return max((r.last_seq for r in self.list()), default=-1)

    def _save(self, df: DataFrame, path: str, order: list[str], parts: int, partition_by: list[str]) -> None:
        rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        w = rows.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.precision))
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)

    def _write(self, df: DataFrame, level: int, table_id: int, last_seq: int | None = None) -> Run | None:
        path = f"{self.root}/L{level:03d}/{table_id:05d}-{uuid.uuid4().hex}"
        parts = max(1, -(-df.count() // FILE_ROWS))
        self._save(df.select(*CHANGELOG.fieldNames()).withColumn("crc", _crc()), path, ["key"], parts, [])
        s = self._measured(self.spark.read.schema(CHANGELOG).parquet(path)).first()
        if not s["n"]:
            files.remove(self.spark, path)
            return None
        return self._sealed(Run(level, table_id, path, s["a"], s["z"], s["n"], s["b"], s["q"] if last_seq is None else last_seq))

    def _measured(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count(F.lit(1)).alias("n"), F.sum(_size()).alias("b"), F.max("seq").alias("q"))

    def _sealed(self, run: Run) -> Run:
        if self.merkle_chunk:
            run.merkle_root = self.tree_root(run)
        return run

    # --- integrity, and blocks that follow from the data ---

    def tree(self, run: Run) -> DataFrame:
        """The Merkle tree over the run's data block in chunks of merkle_chunk bytes; a record belongs to the chunk it begins in."""
        chunk = self.merkle_chunk or 1024
        rows = self.read([run]).withColumn("bytes", record_bytes(F.col("key"), F.col("value"), F.coalesce("tombstone", F.lit(False)), F.col("ts"))).withColumn("size", F.octet_length("bytes"))
        at = running(rows.select("key", "ts", "bytes", "size"), ["key", "ts"], "size").withColumn("leaf", F.expr(f"before div {chunk}"))
        body = F.array_sort(F.collect_list(F.struct("idx", F.hex("bytes").alias("h"))))
        leaves = at.groupBy("leaf").agg(F.unhex(F.concat_ws("", F.transform(body, lambda x: x["h"]))).alias("chunk"))
        return merkle.tree(running(leaves, ["leaf"]).select("idx", "chunk"))

    def tree_root(self, run: Run) -> str:
        return merkle.root(self.tree(run)).first()["root"]

    def damaged(self, run: Run) -> int:
        """Records of a run whose checksum doesn't hold; 0 for a run that is sound."""
        schema = CHANGELOG.simpleString()[7:-1].replace(":", " ") + ", crc bigint"
        return self.spark.read.schema(schema).parquet(run.path).where(F.col("crc").isNotNull() & (F.col("crc") != _crc())).count()

    def sound(self, run: Run) -> bool:
        """Whether all checksums of a run hold and its tree has the root that was noted."""
        return self.damaged(run) == 0 and (run.merkle_root is None or self.tree_root(run) == run.merkle_root)

    def blocks(self, run: Run) -> dict[str, DataFrame]:
        """What belongs to a run and follows from its data alone: index, summary, filter and metadata."""
        rows = self.read([run]).select(F.lit(run.table_id).alias("table_id"), "key", "ts", _size().alias("size"))
        index = sparse_index.sparse_index(rows, "size", self.index_degree, ["table_id"], ("ts",))
        m, k = bloom.sizing(max(1, run.rows), self.precision)
        return {"index": index, "summary": sparse_index.summary(index, self.summary_degree, ["table_id"]), "filter": bloom.build(rows, "key", m, k), "metadata": self.tree(run)}

    def rebuild(self, run: Run) -> Run:
        """A run's entry made anew from its records, should the manifest's be in doubt."""
        s = self._measured(self.read([run])).first()
        return self._sealed(Run(run.level, run.table_id, run.path, s["a"], s["z"], s["n"], s["b"], s["q"]))

    # --- scans of one run ---

    def range_scan(self, run: Run, low: str, high: str, max_records: int | None = None) -> DataFrame:
        """The first max_records user records of a run from low to high, tombstones kept."""
        return scans.run_range_scan(self.read([run]), low, high, max_records, ())

    def prefix_scan(self, run: Run, prefix: str, max_records: int | None = None) -> DataFrame:
        """The first max_records user records of a run with a prefix, tombstones kept."""
        return scans.run_prefix_scan(self.read([run]), prefix, max_records, ())

    def cursor(self, run: Run, low: str | None = None, high: str | None = None, prefix: str = "") -> scans.Cursor:
        """A lazy ordered cursor over a run, over a range of it or a prefix, tombstones included."""
        rows = self.read([run]).where(scans.prefix_filter(prefix))
        rows = rows if low is None else rows.where(F.col("key") >= low)
        return scans.Cursor(rows if high is None else rows.where(F.col("key") <= high))

    def add(self, changes: DataFrame, last_seq: int | None = None) -> Run | None:
        """A new run of the first level: the newest row of each key of changes, tombstones too."""
        runs = self.list()
        label = max((r.table_id for r in runs if r.level == 1), default=0) + 1
        run = self._write(lww(changes.select(*CHANGELOG.fieldNames())), 1, label, last_seq)
        if run:
            self._commit([*runs, run])
        return run

    def read(self, runs: list[Run] | None = None) -> DataFrame:
        """The rows of runs, by default all."""
        runs = self.list() if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(*[r.path for r in runs])

    def compact_size_tiered(self, max_tables: int = 8, max_level: int = 4) -> int:
        """Merge by size tiers; the number of merged runs written. Runs that stay are only listed anew."""
        runs = self.list()
        if len([r for r in runs if r.level == 1]) < max_tables:
            return 0
        rows = [(0, r.level, r.table_id) for r in runs]
        plan = size_tiered_plan(self.spark.createDataFrame(rows, "store_id bigint, level int, table_id int"), max_tables, max_level).collect()
        to = {(p["level"], p["table_id"]): (p["to_level"], p["to_table"]) for p in plan}
        groups: dict[tuple[int, int], list[Run]] = {}
        for r in runs:
            groups.setdefault(to[r.level, r.table_id], []).append(r)
        return self._regroup(groups)

    def holding(self, low: str, high: str | None) -> list[Run]:
        """Runs whose key range meets low..high; high None is without end."""
        return [r for r in self.list() if (high is None or r.start_key <= high) and r.end_key >= low]

    def _regroup(self, groups: dict[tuple[int, int], list[Run]]) -> int:
        new, written, old = [], 0, []
        for (level, label), members in groups.items():
            if len(members) == 1:
                r = members[0]
                new.append(replace(r, level=level, table_id=label))
                continue
            merged = self._write(lww(self.read(members)), level, label, max(m.last_seq for m in members))
            new += [merged] if merged else []
            written += 1
            old += members
        self._commit(new)
        for r in old:
            files.remove(self.spark, r.path)
        return written

    def compact_leveled(self, first: int = 1_000_000, fanout: int = 10, max_level: int = 4, block: int = 160_000) -> int:
        """Merge by level budgets: a level over its budget gives its oldest runs (the first level all) to the next.

        Planned on the manifest; each merge reads only the runs that overlap. Merged rows are cut by key into
        runs of about `block` bytes, so runs of a level below the first never overlap. A tombstone goes
        where it reaches the last level, unless a run outside the merge has its key in its range.
        """
        written = 0
        for level in range(1, max_level):
            while True:
                runs = self.list()
                here = [r for r in runs if r.level == level]
                if sum(r.bytes for r in here) <= first * fanout ** (level - 1):
                    break
                chosen = here if level == 1 else here[:1]
                low, high = min(r.start_key for r in chosen), max(r.end_key for r in chosen)
                below = [r for r in runs if r.level == level + 1 and r.start_key <= high and r.end_key >= low]
                taken = chosen + below
                merged = lww(self.read(taken))
                others = [r for r in runs if r not in taken]
                if max_level > 2 and level + 1 == max_level:
                    elsewhere = reduce(lambda c, r: c | F.col("key").between(*r), union_of_ranges([(r.start_key, r.end_key) for r in others]), F.lit(False))
                    merged = merged.where(~F.coalesce("tombstone", F.lit(False)) | elsewhere)
                written += self._split(merged, level + 1, block, taken, others)
        return written

    def _split(self, merged: DataFrame, level: int, block: int, taken: list[Run], others: list[Run]) -> int:
        """Write merged rows as runs of about `block` bytes each: one write, and one aggregation that measures them all."""
        size = _size().alias("size")
        pieces = running(merged.select(*CHANGELOG.fieldNames(), size), ["key"], "size").withColumn("piece", F.expr(f"before div {block}"))
        path = f"{self.root}/L{level:03d}/split-{uuid.uuid4().hex}"
        rows = pieces.select(*CHANGELOG.fieldNames(), _crc().alias("crc"), "piece")
        parts = max(1, -(-sum(r.rows for r in taken) // FILE_ROWS))
        self._save(rows, path, ["piece", "key"], parts, ["piece"])
        seq = max(r.last_seq for r in taken)
        at_level = [r for r in others if r.level == level]
        schema = CHANGELOG.simpleString()[7:-1].replace(":", " ") + ", piece bigint"
        written = self._measured(self.spark.read.schema(schema).parquet(path), "piece").orderBy("piece").collect() if parts and files.names(self.spark, path) else []
        new = [self._sealed(Run(level, 0, f"{path}/piece={s['piece']}", s["a"], s["z"], s["n"], s["b"], seq)) for s in written]
        # labels follow the key order
        ordered = sorted(at_level + new, key=lambda r: r.start_key)
        for i, r in enumerate(ordered):
            r.table_id = i + 1
        self._commit([r for r in others if r.level != level] + ordered)
        for r in taken:
            files.remove(self.spark, r.path)
        return len(new)

    def space(self) -> dict[int, int]:
        """Encoded bytes of each level."""
        return reduce(lambda d, r: d | {r.level: d.get(r.level, 0) + r.bytes}, self.list(), {})
