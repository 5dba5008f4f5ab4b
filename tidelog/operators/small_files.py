"""Far too many small files: find them, pack their splits, and write their records to few good files.

Method: split packing in the engine. The read is tuned by maximum partition bytes and file-open
cost so that one task reads many small files as one combined split; the result is coalesced without
a shuffle, written to a staging folder, verified there and only then published by a rename.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.skew import lookup_join
from tidelog.session import shared_path

#: A table whose blocks together have fewer bytes is small.
SMALL_BYTES = 16_384
#: Size that an output file should have.
TARGET_BYTES = 128 << 20
#: Bytes that a task reads at most where what it keeps of them is little.
READ_BYTES = 8 * TARGET_BYTES
#: What opening a file costs, in bytes that could be read meanwhile.
OPEN_COST = 4 << 20
BLOCKS = ("Data", "Index", "Summary", "Filter")
IDENTITY = ["store_id", "level", "table_id"]


@dataclass
class Published:
    """What a compaction left: the folder with the records, the plan, and the counts before and after."""

    path: str
    plan: DataFrame
    files: int
    rows: int
    fingerprint: str


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the data files under path, from the file system's content summary."""
    fs, p = _fs(spark, path)
    s = fs.getContentSummary(p)
    return max(1, int(s.getFileCount())), int(s.getLength())


def packed_read(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST) -> DataFrame:
    """Read a Parquet folder with combined splits.

    The splits' limits are session settings in Spark, so the read belongs to a session of its own
    with the caller's other settings; the caller's session is not changed. A file counts with its
    bytes plus open_cost, as the engine itself counts it. On a folder of small files the open cost
    is lowered to the mean file size, so that a split is filled with data and not with open costs;
    the limit never exceeds target_bytes, nor what keeps every core busy.
    """
    files, size = listed_files(spark, path)
    cost = max(64 << 10, min(open_cost, size // files))
    own = spark.newSession()
    for k, v in dict(spark.conf.getAll).items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    limit = min(target_bytes, max(cost, 1 << 20, math.ceil((size + files * cost) / cores)))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(limit))
    own.conf.set("spark.sql.files.openCostInBytes", str(cost))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own.read.parquet(path)


def table_identity(listing: DataFrame) -> DataFrame:
    """listing with level and table_id, both bigint, from the TOC's path, however it is written.

    Back slashes, doubled slashes and leading folders make no difference. A path without level or
    number gives nulls.
    """
    path = F.regexp_replace("toc_filename", r"\\", "/")
    return listing.withColumn("level", F.regexp_extract(path, r"(?:^|/)L0*(\d+)/+TOC/", 1).try_cast("bigint")).withColumn(
        "table_id", F.regexp_extract(path, r"-0*(\d+)-TOC\.[^/]*$", 1).try_cast("bigint")
    )


def small_tables(listing: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """(store_id, level, table_id, bytes) of the SSTables whose four blocks have fewer than `limit` bytes.

    A block counts once, with the size in its latest listing that has one; of two such listings of
    one moment the larger size counts. A block that never had a size adds nothing; a table none of
    whose blocks ever had one is of unknown size and is left out. Repeated rows change nothing; an
    empty listing gives no row. One shuffle, with partial aggregation before it.
    """
    newest = [
        F.max(F.when((F.col("block") == b) & F.col("size").isNotNull(), F.struct("listed_at", "size")))["size"].alias(b) for b in BLOCKS
    ]
    sizes = table_identity(listing).where(F.col("block").isin(*BLOCKS)).groupBy(*IDENTITY).agg(*newest)
    known = F.coalesce(*[F.col(b) for b in BLOCKS]).isNotNull()
    total = sum((F.coalesce(F.col(b), F.lit(0)) for b in BLOCKS), F.lit(0)).cast("bigint")
    return sizes.where(known & F.col("table_id").isNotNull() & F.col("level").isNotNull()).select(*IDENTITY, total.alias("bytes")).where(F.col("bytes") < limit)


def multiset(df: DataFrame) -> DataFrame:
    """One row: n and a fingerprint of df as a multiset of rows (sums of two row hashes, whatever the order)."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    both = [F.coalesce(F.sum(F.xxhash64(F.lit(s), nulls, *cols).cast("decimal(38,0)")), F.lit(0)).cast("string") for s in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("/", *both).alias("fingerprint"))


def compact(records: DataFrame, destination: str, kept_bytes: int, read_bytes: int | None = None, target_bytes: int = TARGET_BYTES) -> tuple[int, int, str]:
    """Write records to few files under destination, exactly as often as they come; files, rows, fingerprint.

    The number of files follows from the bytes that are kept and the target, by coalesce, without a
    shuffle: whole packed splits are put together, up to READ_BYTES of them where little of the
    read_bytes is kept. The files are first staged beside the destination, read
    back and compared with the source as a multiset; only then the folder is renamed. A run that
    fails leaves a staging folder and no destination, so it can simply be run again. An existing
    destination is an error. No records give an empty folder with the schema.
    """
    spark = records.sparkSession
    fs, final = _fs(spark, destination)
    if fs.exists(final):
        raise FileExistsError(destination)
    staged = f"{destination}.staging"
    before = multiset(records).first()
    files = max(1, math.ceil(kept_bytes / target_bytes), math.ceil((read_bytes or 0) / READ_BYTES))
    records.coalesce(files).write.mode("overwrite").parquet(staged)
    written = spark.read.schema(records.schema).parquet(staged)
    after = multiset(written).first()
    if tuple(before) != tuple(after):
        raise RuntimeError(f"staged output differs from its source: {before} and {after}")
    if not fs.rename(_fs(spark, staged)[1], final):
        raise RuntimeError(f"{staged} could not be published")
    files = len(spark.read.schema(records.schema).parquet(destination).inputFiles())
    return files, int(after["n"]), after["fingerprint"]


def consolidate(spark: SparkSession, listing_path: str, records_path: str, destination: str | None = None, limit: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES) -> Published:
    """Find the small SSTables of a listing and put their records into few files of good size.

    Tables without records keep their place in the plan. The plan is written before the records
    are read, so that a second attempt after a failure works on the same tables.
    """
    destination = destination or shared_path(spark, "compacted")
    plan_path = f"{destination}.plan"
    small_tables(packed_read(spark, listing_path, target_bytes), limit).write.mode("overwrite").parquet(plan_path)
    plan = spark.read.schema("store_id bigint, level bigint, table_id bigint, bytes bigint").parquet(plan_path)
    records = packed_read(spark, records_path, target_bytes)
    chosen = lookup_join(records, plan.select(*IDENTITY), IDENTITY, "left_semi")
    kept = plan.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    files, rows, fingerprint = compact(chosen.select(*records.columns), destination, kept, listed_files(spark, records_path)[1], target_bytes)
    return Published(destination, plan, files, rows, fingerprint)
