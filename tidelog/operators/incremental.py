"""Processing only new or changed records of a log.

Method: log-based change capture. Each store is a partition of the log with an offset of its own,
(segment file, byte offset). Before a batch reads anything its plan, the offsets from and to, is
written ahead; a run that finds a plan without a commit replays exactly that plan; the sink takes
each change once, by key and offset.

Plans and commits are files that are made at once and never overwritten, each naming the folder of
its table. So nothing depends on what a committer leaves behind, and of two runners of one batch the
first to commit is the one that counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.prefilter import may_meet
from tidelog.operators.skew import lookup_join
from tidelog.session import cut
from tidelog.sources import files

CONTENT = ["ts", "tombstone", "key", "value"]
PLACE = ["store_id", "seq", "file_name", "file_offset"]
PLAN_SCHEMA = "batch_id bigint, store_id bigint, from_file string, from_offset bigint, to_file string, to_offset bigint"


def last_success(runs: DataFrame) -> DataFrame:
    """(store_id, from_file, from_offset): the position of each store's last successful run.

    Successful is status success in any case and with any white space around; last is the greatest
    run_id. Failed, aborted and running runs note positions that do not count. Repeated rows change
    nothing; of two rows of one run with different positions the later position counts. If the last
    successful run has no position, nothing counts as read; a store without one is absent.
    """
    ok = runs.where(F.lower("status").rlike(r"^\s*success\s*$"))
    best = F.max(F.struct("run_id", "latest_file_name", "byte_offset")).alias("r")
    return ok.groupBy("store_id").agg(best).select("store_id", F.col("r.latest_file_name").alias("from_file"), F.col("r.byte_offset").alias("from_offset"))


def at_or_after(file: Column, offset: Column, from_file: Column, from_offset: Column) -> Column:
    """Whether a delivery begins at or after a position; a null position is before everything."""
    after = (file > from_file) | ((file == from_file) & (offset >= from_offset))
    return F.coalesce(after, F.lit(True))


def pending(log: DataFrame, offsets: DataFrame) -> DataFrame:
    """The deliveries that carry something unread: at or after their store's offset and new in content.

    log is deliveries, offsets is (store_id, from_file, from_offset). A delivery is left out where a
    delivery of the same change (store_id, seq) before the offset has the same ts, tombstone, key and
    value, nulls being equal to nulls. Rows loaded twice come out once. A delivery that a null
    file, offset or store leaves without a place before or after the position counts as unread.

    The cost follows the unread deliveries and not the log. These are reduced to one row per change
    and content, with partial aggregation, in one shuffle. Of what was read, only changes that are
    delivered again matter: a change whose seq lies outside its store's range of read ones is new
    beyond doubt, and of the others the keys, or a set of bits of a bounded size, go to the read
    part (may_meet), of which only what passes is shuffled.
    """
    placed = lookup_join(log, offsets, ["store_id"], "left", spread=F.xxhash64("seq", "file_offset"))
    new = at_or_after(F.col("file_name"), F.col("file_offset"), F.col("from_file"), F.col("from_offset"))
    row = ["store_id", "seq", *CONTENT]
    # the first new delivery of a content stands for it
    first = F.min(F.struct("file_name", "file_offset")).alias("place")
    fresh = cut(placed.where(new).groupBy(*row).agg(first, F.max("crc").alias("crc")), "unread")
    read = placed.where(~new)
    spans = cut(read.groupBy("store_id").agg(F.min("seq").alias("__least"), F.max("seq").alias("__most")), "spans")
    ranged = lookup_join(fresh, spans, ["store_id"], "left", spread=F.col("seq"))
    again = F.coalesce(F.col("seq").between(F.col("__least"), F.col("__most")), F.lit(False))
    redelivered = cut(ranged.where(again).select(*fresh.columns), "redelivered")
    asked = cut(redelivered.select("store_id", "seq").distinct(), "asked")
    known = may_meet(read.select(*row), asked, ["store_id", "seq"]).select(*row, F.lit(None).cast("struct<file_name:string,file_offset:bigint>").alias("place"), F.lit(None).cast("bigint").alias("crc"), F.lit(True).alias("known"))
    # grouping takes nulls as equal; the read part is reduced by partial aggregation before it moves
    both = redelivered.withColumn("crc", F.col("crc").cast("bigint")).withColumn("known", F.lit(False)).unionByName(known)
    changed = both.groupBy(*row).agg(F.max("place").alias("place"), F.max("crc").alias("crc"), F.bool_or("known").alias("known")).where(~F.col("known")).drop("known")
    left = ranged.where(~again).select(*fresh.columns).unionByName(changed)
    return left.select("store_id", "seq", F.col("place.file_name").alias("file_name"), F.col("place.file_offset").alias("file_offset"), "crc", *CONTENT)


@dataclass
class ChangeCapture:
    """Change capture into a sink: plans, batches of the sink and commits under root.

    capture() runs one batch to its end. After a failure at any point, calling it again neither
    skips nor repeats a record: an uncommitted plan is replayed as written, even if the log has grown
    or the run table changed since, what an attempt left without a commit is never read, and rows that
    a committed batch holds under the same change and offset are not taken again. Deliveries without a
    place in the log belong to the batch that first meets them, and are told apart by their content.
    """

    spark: SparkSession
    root: str

    def _known(self, kind: str) -> dict[int, str]:
        """Batches that are planned or committed, with the folders of their tables."""
        return {int(n): files.read_text(self.spark, f"{self.root}/{kind}/{n}") for n in files.names(self.spark, f"{self.root}/{kind}") if n.isdigit()}

    def _folder(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    def _plan(self, batch: int) -> DataFrame:
        return self.spark.read.schema(PLAN_SCHEMA).parquet(self._known("plans")[batch])

    def plan(self, log: DataFrame, runs: DataFrame | None = None) -> int:
        """Number of the batch to run: an uncommitted plan's, or a new one's, whose plan is then on disk.

        The first batch starts at the offsets of `runs`; later ones where the batch before ended. A
        plan ends behind the last delivery that is there now. One row per store. If another runner
        has planned the batch meanwhile, its plan is the one that counts.
        """
        plans, commits = self._known("plans"), self._known("commits")
        open_plans = plans.keys() - commits.keys()
        if open_plans:
            return min(open_plans)
        batch = max(plans, default=-1) + 1
        if batch:
            last = self._plan(batch - 1)
            start = last.select("store_id", F.col("to_file").alias("from_file"), F.col("to_offset").alias("from_offset"))
        else:
            start = last_success(runs) if runs is not None else self.spark.createDataFrame([], "store_id bigint, from_file string, from_offset bigint")
        ends = log.where(F.col("file_name").isNotNull() & F.col("file_offset").isNotNull()).groupBy("store_id").agg(F.max(F.struct("file_name", "file_offset")).alias("e"))
        ends = ends.select("store_id", F.col("e.file_name").alias("to_file"), (F.col("e.file_offset") + 1).alias("to_offset"))
        both = start.join(ends, "store_id", "full")
        # a store without new deliveries keeps its offset
        end_file, end_offset = F.coalesce("to_file", "from_file"), F.when(F.col("to_file").isNull(), F.col("from_offset")).otherwise(F.col("to_offset"))
        plan = both.select(F.lit(batch).cast("bigint").alias("batch_id"), "store_id", "from_file", "from_offset", end_file.alias("to_file"), end_offset.alias("to_offset"))
        folder = self._folder("plan-tables")
        plan.write.parquet(folder)
        files.publish(self.spark, f"{self.root}/plans/{batch}", folder)
        return batch

    def _overlapping(self, batch: int) -> list[str]:
        """Sink folders of committed batches that read a stretch of the log of which this plan reads a part; usually none."""
        plans, commits = self._known("plans"), self._known("commits")
        others = [b for b in commits if b != batch]
        if not others:
            return []
        old = self.spark.read.schema(PLAN_SCHEMA).parquet(*[plans[b] for b in others]).alias("o")
        p = self._plan(batch).alias("p")
        place = lambda x: F.struct(F.col(f"{x}_file").alias("f"), F.col(f"{x}_offset").alias("o"))
        before = lambda a, b: F.col(f"{a}_file").isNull() | (place(a) < place(b))
        met = old.join(p, F.col("o.store_id").eqNullSafe(F.col("p.store_id")) & before("o.from", "p.to") & before("p.from", "o.to"))
        return [commits[r[0]] for r in met.select("o.batch_id").distinct().collect()]

    def run(self, log: DataFrame, batch: int) -> str:
        """Read what the plan of the batch names and write it to a folder of the sink, each change and offset once; the folder."""
        plan = self._plan(batch).drop("batch_id")
        spread = F.xxhash64("seq", "file_offset")
        ends = plan.where("store_id IS NOT NULL").select("store_id", "to_file", "to_offset")
        bounded = lookup_join(log, ends, ["store_id"], "left", spread=spread)
        nowhere = F.col("file_name").isNull() | F.col("file_offset").isNull() | F.col("store_id").isNull()
        before = F.col("to_file").isNotNull() & ~at_or_after(F.col("file_name"), F.col("file_offset"), F.col("to_file"), F.col("to_offset"))
        bounded = bounded.where(nowhere | before).drop("to_file", "to_offset")
        fresh = pending(bounded, plan.select("store_id", "from_file", "from_offset"))
        overlapping = self._overlapping(batch)
        if overlapping:
            taken = self.spark.read.schema(fresh.schema).parquet(*overlapping).select(*PLACE)
            fresh = fresh.join(taken, PLACE, "left_anti")
        committed = [f for b, f in self._known("commits").items() if b != batch]
        if committed:
            # few, if any; the filter reaches the scan
            strays = self.spark.read.schema(fresh.schema).parquet(*committed).where(nowhere).select("store_id", "seq", *CONTENT).distinct().alias("t")
            if not strays.isEmpty():
                f = fresh.alias("f")
                same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("store_id", "seq", *CONTENT)]
                fresh = f.where(~nowhere).unionByName(f.where(nowhere).alias("f").join(strays, same, "left_anti"))
        folder = self._folder("sink")
        fresh.write.parquet(folder)
        return folder

    def commit(self, batch: int, folder: str) -> bool:
        """Make a folder the batch's part of the sink; False if another runner has committed the batch."""
        return files.publish(self.spark, f"{self.root}/commits/{batch}", folder)

    def sink(self, batch: int | None = None) -> DataFrame:
        """What the committed batches hold, or one of them."""
        commits = self._known("commits")
        paths = [f for b, f in sorted(commits.items()) if batch is None or b == batch]
        if not paths:
            raise ValueError("no batch is committed")
        return self.spark.read.parquet(*paths)

    def capture(self, log: DataFrame, runs: DataFrame | None = None) -> int:
        batch = self.plan(log, runs)
        self.commit(batch, self.run(log, batch))
        return batch
