"""Queries of the general data-preparation operators: p1, p2 and p3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.changefeed import EqualityDeleteTable
from tidelog.operators.incremental import ChangeCapture
from tidelog.operators.small_files import IDENTITY, consolidate
from tidelog.session import shared_path
from tidelog.sources.tables import table


def _consolidated(spark: SparkSession, d: str):
    return consolidate(spark, f"{d}/sst_files.parquet", f"{d}/sst_records.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The SSTables that the consolidation took on, from its plan, once their records are published."""
    return _consolidated(spark, d).plan.select(*IDENTITY)


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of each consolidated table, counted in the published files."""
    out = _consolidated(spark, d)
    published = spark.read.parquet(out.path)
    return published.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("records"), F.count("crc").alias("with_crc"), F.sum(F.length("value")).alias("value_bytes"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """One row: tables consolidated, their blocks' bytes as listed, and the records in the published files."""
    out = _consolidated(spark, d)
    return out.plan.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("listed_bytes")).select("tables", "listed_bytes", F.lit(spark.read.parquet(out.path).count()).cast("bigint").alias("records"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: tables consolidated, their blocks' bytes as listed, files written, records in them."""
    out = _consolidated(spark, d)
    return out.plan.agg(F.count(F.lit(1)).alias("tables"), F.sum("bytes").alias("listed_bytes")).select(
        "tables", "listed_bytes", F.lit(out.files).cast("bigint").alias("files"), F.lit(out.rows).cast("bigint").alias("records")
    )


def _captured(spark: SparkSession, d: str) -> DataFrame:
    capture = ChangeCapture(spark, shared_path(spark, "capture"))
    capture.capture(table(spark, d, "wal_records"), table(spark, d, "wal_runs"))
    return capture.sink()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The changes that one batch of the capture brought, one row per change."""
    return _captured(spark, d).select("store_id", "seq").distinct()


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the batch brought, each change once: the content of its last new delivery."""
    row = F.max(F.struct("file_name", "file_offset", "ts", "tombstone", "key")).alias("r")
    return _captured(spark, d).groupBy("store_id", "seq").agg(row).select("store_id", "seq", "r.*")


def _state(spark: SparkSession, d: str) -> EqualityDeleteTable:
    t = EqualityDeleteTable(spark, shared_path(spark, "state"))
    t.append(table(spark, d, "wal_records"), 0)
    return t


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Live keys with the change that made them so."""
    return _state(spark, d).read(values=False).select("store_id", "key", "seq")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """The current state with its values."""
    return _state(spark, d).read().select("store_id", "key", "ts", "seq", F.hex("value").alias("value_hex"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_totals, p1_report, p2_found, p2_changes, p3_found, p3_state)}

_SMALL = """
WITH listed AS (
  SELECT store_id, block, size, listed_at,
    TRY_CAST(regexp_extract(replace(toc_filename, chr(92), '/'), '(^|/)L0*([0-9]+)/+TOC/', 2) AS BIGINT) AS level,
    TRY_CAST(regexp_extract(replace(toc_filename, chr(92), '/'), '-0*([0-9]+)-TOC[.][^/]*$', 1) AS BIGINT) AS table_id
  FROM sst_files WHERE block IN ('Data', 'Index', 'Summary', 'Filter') AND size IS NOT NULL),
latest AS (
  SELECT store_id, level, table_id, size,
    row_number() OVER (PARTITION BY store_id, level, table_id, block ORDER BY listed_at DESC, size DESC) AS rn FROM listed),
small AS (
  SELECT store_id, level, table_id, CAST(sum(size) AS BIGINT) AS bytes FROM latest WHERE rn = 1
  GROUP BY ALL HAVING sum(size) < 16384)
"""
_POSITION = """
WITH pos AS (
  SELECT store_id, latest_file_name AS pf, byte_offset AS po FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY run_id DESC, latest_file_name DESC, byte_offset DESC) AS rn
    FROM wal_runs WHERE lower(trim(status)) = 'success') WHERE rn = 1),
placed AS (
  SELECT w.*, coalesce(file_name > pf OR (file_name = pf AND file_offset >= po), true) AS unread
  FROM wal_records w LEFT JOIN pos USING (store_id)),
new AS (
  SELECT DISTINCT a.store_id, a.seq, a.file_name, a.file_offset, a.ts, a.tombstone, a.key, a.value FROM placed a
  WHERE a.unread AND NOT EXISTS (
    SELECT 1 FROM placed b WHERE NOT b.unread AND b.store_id = a.store_id AND b.seq = a.seq AND b.ts IS NOT DISTINCT FROM a.ts
      AND b.tombstone IS NOT DISTINCT FROM a.tombstone AND b.key IS NOT DISTINCT FROM a.key AND b.value IS NOT DISTINCT FROM a.value)),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, seq, ts, tombstone, key, value ORDER BY file_name, file_offset) AS fr FROM new) WHERE fr = 1)
"""
_NEWEST = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY ts DESC, seq DESC, file_name DESC, file_offset DESC) AS rn
  FROM wal_records WHERE key IS NOT NULL) WHERE rn = 1 AND NOT tombstone
"""
ORACLE = {
    "p1_found": _SMALL + "SELECT store_id, level, table_id FROM small",
    "p1_records": _SMALL
    + "SELECT r.store_id, r.level, r.table_id, count(*) AS records, count(crc) AS with_crc, CAST(sum(octet_length(value)) AS BIGINT) AS value_bytes FROM sst_records r JOIN small s ON r.store_id = s.store_id AND r.level = s.level AND r.table_id = s.table_id GROUP BY ALL",
    "p1_totals": _SMALL
    + "SELECT count(*) AS tables, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS listed_bytes, (SELECT count(*) FROM sst_records r JOIN small s ON r.store_id = s.store_id AND r.level = s.level AND r.table_id = s.table_id) AS records FROM small",
    "p2_found": _POSITION + "SELECT DISTINCT store_id, seq FROM new",
    "p2_changes": _POSITION
    + "SELECT store_id, seq, file_name, file_offset, ts, tombstone, key FROM (SELECT *, row_number() OVER (PARTITION BY store_id, seq ORDER BY file_name DESC, file_offset DESC) AS rn FROM firsts) WHERE rn = 1",
    "p3_found": f"SELECT store_id, key, seq FROM ({_NEWEST})",
    "p3_state": f"SELECT store_id, key, ts, seq, hex(value) AS value_hex FROM ({_NEWEST})",
}
