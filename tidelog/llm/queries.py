"""Queries p4 to p9 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import distinct, frequent, garbled, membership, mixing, tokens
from tidelog.session import cut
from tidelog.sources.tables import table


def _registers(spark: SparkSession, d: str) -> DataFrame:
    return cut(distinct.registers(distinct.with_cells(table(spark, d, "wal_records")), ["store_id", "key"], distinct.DIMS), "registers")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose distinct keys are at least four fifths of their rows."""
    return distinct.mostly_distinct(table(spark, d, "wal_records"), _registers(spark, d))


def p4_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of day, store and namespace with rows, estimated distinct keys and standard error."""
    dims = [*distinct.DIMS, "over"]
    return distinct.estimates(distinct.cube(_registers(spark, d), distinct.DIMS), dims)


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every cell of the cube, from the registers."""
    return p4_estimates(spark, d).select(*distinct.DIMS, "over", "rows")


def p4_within(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of the cube, and whether its estimate lies within six standard errors, or one key, of the exact count."""
    dims = [*distinct.DIMS, "over"]
    keys = distinct.with_cells(table(spark, d, "wal_records")).select(*distinct.DIMS, "key").distinct()
    marks = F.explode(F.array(*[F.lit(f"{m:03b}") for m in range(8)]))
    wide = keys.withColumn("over", marks)
    cells = [F.when(F.substring("over", i + 1, 1) == "1", F.lit("*")).otherwise(F.col(c).cast("string")).alias(c) for i, c in enumerate(distinct.DIMS)]
    # a key of another store is another key
    exact = wide.select(*cells, "over", F.col("store_id").alias("own"), "key").distinct().groupBy(*dims).agg(F.count(F.lit(1)).alias("keys"))
    near = F.abs(F.col("estimate") - F.col("keys")) <= F.greatest(6 * distinct.standard_error() * F.col("keys"), F.lit(1.0))
    return p4_estimates(spark, d).join(exact, dims).select(*dims, near.alias("within"))


def _seen(spark: SparkSession, d: str) -> membership.Seen:
    return membership.seen_before(table(spark, d, "sst_records"), table(spark, d, "incoming_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Incoming records whose key was seen before."""
    return _seen(spark, d).found


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: keyed rows, positives, disproved positives and their rate among rows that aren't in the filter's set."""
    s = _seen(spark, d)
    wrong = F.coalesce(F.sum((~F.col("in_filter")).cast("bigint")), F.lit(0))
    one = s.verified.agg(F.count(F.lit(1)).alias("positives"), wrong.alias("disproved"), F.coalesce(F.sum(F.col("seen").cast("bigint")), F.lit(0)).alias("seen"))
    outside = F.lit(s.incoming) - F.col("positives") + F.col("disproved")
    return one.select(F.lit(s.incoming).cast("bigint").alias("rows"), "positives", "disproved", "seen", (F.col("disproved") / F.greatest(outside, F.lit(1))).alias("wrong_rate"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row: incoming rows with a key, and how many of these were seen before."""
    s = _seen(spark, d)
    return s.found.agg(F.count(F.lit(1)).alias("seen")).select(F.lit(s.incoming).cast("bigint").alias("rows"), "seen")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 2 in 100 of their store's rows."""
    return frequent.frequent_items(table(spark, d, "wal_records"), "store_id", "key").select(F.col("grp").alias("store_id"), F.col("item").cast("string").alias("key"))


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent keys of each store with their counts."""
    t = frequent.top_items(table(spark, d, "wal_records"), "store_id", "key", 10)
    return t.select(F.col("grp").alias("store_id"), F.col("item").cast("string").alias("key"), "n", "rank")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the ids of its text."""
    return tokens.encode(tokens.read_documents(spark, d))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    sizes = cut(tokens.token_counts(tokens.read_documents(spark, d)), "token-counts")
    return mixing.mix(sizes, table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their target share."""
    return _mix(spark, d).report.where("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each source's target, quota and the share reached."""
    return mixing.shares(_mix(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, d).selection()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was altered by wrong decoding."""
    return garbled.find_garbled(tokens.read_documents(spark, d)).documents.select("doc_id")


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The altered documents with their text as it was meant, as far as that can be had."""
    docs = tokens.read_documents(spark, d)
    return garbled.repaired(docs, garbled.find_garbled(docs))


QUERIES = {f.__name__: f for f in (p4_found, p4_estimates, p4_cells, p4_within, p5_found, p5_report, p5_counts, p6_found, p6_top, p7_ids, p8_found, p8_shares, p8_mix, p9_found, p9_repaired)}

_CELLS = """
WITH rows AS (
  SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, store_id,
    CASE WHEN instr(key, ':') > 0 THEN split_part(key, ':', 1) ELSE '' END AS namespace, key
  FROM wal_records WHERE key IS NOT NULL AND ts IS NOT NULL)
"""
ORACLE = {
    "p4_found": _CELLS
    + """, cells AS (
  SELECT day, store_id, namespace, count(*) AS n, count(DISTINCT key) AS k FROM rows GROUP BY ALL
  UNION ALL SELECT day, store_id, '*', count(*), count(DISTINCT key) FROM rows GROUP BY ALL)
SELECT day, store_id, namespace FROM cells WHERE n >= 30 AND k * 5 >= n * 4""",
    "p4_cells": _CELLS
    + """SELECT CASE WHEN grouping(day) = 1 THEN '*' ELSE day END AS day, CASE WHEN grouping(store_id) = 1 THEN '*' ELSE CAST(store_id AS VARCHAR) END AS store_id,
  CASE WHEN grouping(namespace) = 1 THEN '*' ELSE namespace END AS namespace,
  grouping(day)::VARCHAR || grouping(store_id)::VARCHAR || grouping(namespace)::VARCHAR AS over, count(*) AS rows
FROM rows GROUP BY CUBE (day, store_id, namespace)""",
    "p4_within": _CELLS
    + """SELECT CASE WHEN grouping(day) = 1 THEN '*' ELSE day END AS day, CASE WHEN grouping(store_id) = 1 THEN '*' ELSE CAST(store_id AS VARCHAR) END AS store_id,
  CASE WHEN grouping(namespace) = 1 THEN '*' ELSE namespace END AS namespace,
  grouping(day)::VARCHAR || grouping(store_id)::VARCHAR || grouping(namespace)::VARCHAR AS over, count(DISTINCT key) > 0 AS within
FROM rows GROUP BY CUBE (day, store_id, namespace)""",
    "p5_counts": """
SELECT count(*) AS rows, count(*) FILTER (
  EXISTS (SELECT 1 FROM sst_records s WHERE s.store_id = i.store_id AND s.key = encode(i.key))
  OR seq > (SELECT min(seq) FROM incoming_records j WHERE j.store_id = i.store_id AND j.key = i.key)) AS seen
FROM incoming_records i WHERE key IS NOT NULL""",
    "p5_found": """
SELECT seq FROM incoming_records i WHERE key IS NOT NULL AND (
  EXISTS (SELECT 1 FROM sst_records s WHERE s.store_id = i.store_id AND s.key = encode(i.key))
  OR seq > (SELECT min(seq) FROM incoming_records j WHERE j.store_id = i.store_id AND j.key = i.key))""",
    "p6_found": """
SELECT store_id, key FROM (
  SELECT *, sum(n) OVER (PARTITION BY store_id) AS total FROM (
    SELECT store_id, key, count(*) AS n FROM wal_records WHERE key IS NOT NULL GROUP BY ALL))
WHERE n * 50 >= total""",
    "p6_top": """
SELECT store_id, key, n, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY n DESC, encode(key) DESC) AS rn FROM (
    SELECT store_id, key, count(*) AS n FROM wal_records WHERE key IS NOT NULL GROUP BY ALL)) WHERE rn <= 10""",
}
