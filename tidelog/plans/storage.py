"""Queries on runs, compaction, the log's layout, integrity and key dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.encoding import decode, record_bytes, record_crc, record_size, wal_record_bytes, wal_record_size
from tidelog.operators import compaction as C
from tidelog.operators import dictionary as D
from tidelog.operators import merkle as M
from tidelog.operators import scans as S
from tidelog.operators import sparse_index as X
from tidelog.operators.incremental import at_or_after, last_success
from tidelog.operators.lww import lww
from tidelog.operators.ordered import running
from tidelog.operators.skew import heavy_left_join, lookup_join
from tidelog.plans.kv import BY, ORDER, RESERVED_SQL, log, newest_sql
from tidelog.sources.tables import table

RUN = ["store_id", "level", "table_id"]
MEMTABLE, SEGMENT = 1024, 16_384


def runs(spark, d):
    """The records of the SSTables, each once."""
    return table(spark, d, "sst_records").select(*RUN, "key", "value", "tombstone", "ts").distinct()


def _size():
    return record_size(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))


def lsm_merge_runs(spark, d):
    """The newest record of each key over all runs."""
    return C.newest(runs(spark, d)).select("store_id", F.hex("key").alias("key_hex"), "ts", "level", "table_id")


def lsm_level_read(spark, d):
    """What a read level by level finds for each key."""
    return C.level_read(runs(spark, d)).select("store_id", F.hex("key").alias("key_hex"), "ts", "level", "table_id")


def memtable_flush_runs(spark, d):
    """Runs of 1024 log records each: the newest record of each key in each."""
    rows = log(spark, d).where("key IS NOT NULL").drop("value")
    placed = running(rows, ["store_id", "file_name", "file_offset"], None, ["store_id"]).withColumn("run_id", F.expr(f"idx div {MEMTABLE}"))
    return lww(placed.drop("idx", "before", "group_rows"), ("store_id", "run_id", "key"), ORDER).select("store_id", "run_id", "key", "seq", "tombstone")


def sst_record_size(spark, d):
    """Encoded bytes of each run."""
    return runs(spark, d).groupBy(*RUN).agg(F.count(F.lit(1)).alias("records"), F.sum(_size()).alias("bytes"))


def sst_ranges(spark, d):
    r = X.ranges(runs(spark, d))
    return r.select(*RUN, F.hex("start_key").alias("start_hex"), F.hex("end_key").alias("end_hex"), "rows")


def _index(spark, d):
    sized = runs(spark, d).withColumn("size", _size())
    return X.sparse_index(sized, "size", 5, RUN, ("ts", "size"))


def sst_sparse_index(spark, d):
    return _index(spark, d).select(*RUN, F.hex("key").alias("key_hex"), "offset", "idx")


def sst_summary(spark, d):
    return X.summary(_index(spark, d)).select(*RUN, F.hex("key").alias("key_hex"), "idx")


def sst_floor_lookup(spark, d):
    """For each incoming key and each level of its store the last key at or before it that the level's sparse index holds."""
    probes = table(spark, d, "incoming_records").where("key IS NOT NULL").select("store_id", F.col("key").cast("binary").alias("key")).distinct()
    index = _index(spark, d)
    levels = lookup_join(probes, index.groupBy("store_id").agg(F.collect_set("level").alias("levels")), ["store_id"], "inner", spread=F.xxhash64("key"))
    got = X.floor_lookup(levels.select("store_id", F.explode("levels").alias("level"), "key"), index, ["store_id", "level"])
    return got.select("store_id", "level", F.hex("key").alias("key_hex"), F.hex("match").alias("match_hex"))


def sst_point_read(spark, d):
    """Which incoming keys the runs of their store hold, and whether the newest record is a delete."""
    probes = table(spark, d, "incoming_records").where("key IS NOT NULL").select("store_id", F.col("key").cast("binary").alias("key")).distinct()
    hit = C.newest(lookup_join(runs(spark, d), probes, ["store_id", "key"], "left_semi"))
    return hit.select("store_id", F.hex("key").alias("key_hex"), "ts", "tombstone")


def record_checksums(spark, d):
    """Records of each store and level whose checksum is right, wrong or missing."""
    ok = F.col("crc") == record_crc(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))
    return table(spark, d, "sst_records").groupBy("store_id", "level").agg(
        F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("invalid"), F.count(F.when(F.col("crc").isNull(), 1)).alias("missing")
    )


def wal_checksums(spark, d):
    """Log records of each store whose checksum of the value is right and wrong."""
    ok = F.col("crc") == F.crc32(F.coalesce("value", F.lit(b"")))
    return table(spark, d, "wal_records").groupBy("store_id").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("invalid"))


def wal_segments(spark, d):
    """Deliveries, bytes and offsets of each segment."""
    rows = log(spark, d).select("store_id", "file_name", "file_offset", wal_record_size(F.col("key"), F.col("value")).alias("size")).distinct()
    return rows.groupBy("store_id", "file_name").agg(F.count(F.lit(1)).alias("deliveries"), F.sum("size").alias("bytes"), F.min("file_offset").alias("first"), F.max("file_offset").alias("last"))


def wal_layout(spark, d):
    """Where each delivery would begin in segments of 16 KiB with a header of 8 bytes, packed in log order."""
    rows = log(spark, d).select("store_id", "file_name", "file_offset", "seq", wal_record_size(F.col("key"), F.col("value")).alias("size")).distinct()
    at = running(rows, ["store_id", "file_name", "file_offset", "seq"], "size", ["store_id"])
    room = SEGMENT - 8
    return at.select("store_id", "file_name", "file_offset", "seq", F.expr(f"before div {room}").alias("segment"), (F.expr(f"before % {room}") + 8).alias("start"))


def wal_replay(spark, d):
    """State of each store after a replay of its log, counted."""
    got = lww(log(spark, d).drop("value"), BY, ORDER)
    return got.groupBy("store_id").agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(~F.col("tombstone"), 1)).alias("live"), F.max("ts").alias("newest"))


def wal_unflushed(spark, d):
    """Deliveries of each store at or after the position of its last successful run."""
    rows = log(spark, d).select("store_id", "file_name", "file_offset", "seq").distinct()
    placed = lookup_join(rows, last_success(table(spark, d, "wal_runs")), ["store_id"], "left", spread=F.col("file_offset"))
    new = at_or_after(F.col("file_name"), F.col("file_offset"), F.col("from_file"), F.col("from_offset"))
    return placed.where(new).groupBy("store_id").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("seq").alias("changes"))


def compact_size_tiered(spark, d):
    """Every record that size-tiered compaction leaves, with its run."""
    got = C.compact_size_tiered(runs(spark, d))
    return got.groupBy("store_id", "key").agg(F.max("ts").alias("ts")).select("store_id", F.hex("key").alias("key_hex"), "ts")


def compact_size_tiered_tables(spark, d):
    """Runs of each level after size-tiered compaction."""
    plan = C.size_tiered_plan(runs(spark, d).select(*RUN))
    return plan.groupBy("store_id", F.col("to_level").cast("bigint").alias("level")).agg(F.countDistinct("to_table").alias("tables"))


def _leveled(spark, d):
    return C.compact_leveled(runs(spark, d).withColumn("size", _size()), "size", first=20_000, fanout=4, block=8_000)


def compact_leveled(spark, d):
    """The live state that leveled compaction leaves."""
    return C.newest(_leveled(spark, d)).where(~F.col("tombstone")).select("store_id", F.hex("key").alias("key_hex"), "ts")


def compact_leveled_layout(spark, d):
    """Every run after leveled compaction: its records, bytes and keys' range."""
    got = _leveled(spark, d)
    return got.groupBy("store_id", "level", "table_id").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"), F.hex(F.min("key")).alias("start_hex"), F.hex(F.max("key")).alias("end_hex"))


def _manifest(spark, d):
    newest = F.max(F.struct("flushed_at", "start_key", "end_key", "rows", "bytes")).alias("r")
    return table(spark, d, "run_manifest").groupBy(*RUN).agg(newest).select(*RUN, "r.*")


def leveled_overlap(spark, d):
    """For each run the runs of the next level that it overlaps, and their bytes."""
    return C.overlap_counts(_manifest(spark, d)).select(*RUN, "overlaps", "overlap_bytes")


def level_budget(spark, d):
    b = C.level_budgets(_manifest(spark, d).select("store_id", "level", F.coalesce("bytes", F.lit(0)).alias("bytes")), first=20_000, fanout=4)
    return b.select("store_id", "level", "bytes", "budget", "over")


def space_by_level(spark, d):
    """Runs, records, bytes and distinct keys of each level."""
    return runs(spark, d).withColumn("size", _size()).groupBy("store_id", "level").agg(
        F.countDistinct("table_id").alias("tables"), F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"), F.countDistinct("key").alias("keys")
    )


def _dictionary(spark, d):
    return D.build(log(spark, d), "key", ("seq",))


def dict_build(spark, d):
    return _dictionary(spark, d).select("key", "idx", "n")


def dict_encode(spark, d):
    """The log with numbers for keys."""
    return D.encode(log(spark, d).select("store_id", "seq", "file_name", "file_offset", "key"), _dictionary(spark, d)).select("store_id", "seq", "file_name", "file_offset", "idx")


def dict_decode(spark, d):
    """Encoded and decoded again."""
    dic = _dictionary(spark, d)
    return D.decode(D.encode(log(spark, d).select("store_id", "seq", "file_name", "file_offset", "key"), dic), dic).select("store_id", "seq", "file_name", "file_offset", "key")


def dict_space(spark, d):
    """Bytes of the runs with keys and with numbers of a dictionary instead."""
    dic = D.build(runs(spark, d), "key", ("ts",)).select("key", "idx", "n")
    r = heavy_left_join(runs(spark, d), dic, "key", "n")
    packed = record_size(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"), F.col("idx"))
    return r.groupBy("store_id").agg(F.sum(_size()).alias("plain"), F.sum(packed).alias("packed"))


def _chunks(df, *order):
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return running(df.withColumn("chunk", text), list(order)).select("idx", "chunk")


def merkle_root(spark, d):
    """Root over the customers in key order, one chunk each."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return M.root(M.tree(_chunks(c, "c_custkey")))


def merkle_diff(spark, d):
    """Nodes that differ between the nations and the nations with one name changed."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    changed = n.withColumn("n_name", F.when(F.col("n_nationkey") == 7, "ELSEWHERE").otherwise(F.col("n_name")))
    return M.diff(M.tree(_chunks(n, "n_nationkey")), M.tree(_chunks(changed, "n_nationkey"))).select("level", "idx", "a_hash", "b_hash")


def merkle_serialize(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return M.serialize(M.tree(_chunks(n, "n_nationkey")))


def memtable_sizes(spark, d):
    """Distinct keys of each run of 1024 log records."""
    return memtable_flush_runs(spark, d).groupBy("store_id", "run_id").agg(F.count(F.lit(1)).alias("keys"))


def memtable_remove(spark, d):
    """The newest records after the incoming keys are removed for good, without tombstones."""
    gone = table(spark, d, "incoming_records").where("key IS NOT NULL").select("store_id", "key").distinct()
    return lww(log(spark, d).drop("value"), BY, ORDER).join(gone, ["store_id", "key"], "left_anti").select("store_id", "key", "seq", "tombstone")


def sst_first_records(spark, d):
    """The first key of each run."""
    return X.ranges(runs(spark, d)).select(*RUN, F.hex("start_key").alias("key_hex"))


def sst_range_scan(spark, d):
    """Newest user records of a key range over all runs, tombstones kept."""
    from tidelog.schema import is_reserved

    hit = runs(spark, d).where(F.col("key").between(b"cart:", b"metric:") & ~is_reserved(F.col("key")))
    return C.newest(hit).select("store_id", F.hex("key").alias("key_hex"), "ts", "tombstone")


LOW, HIGH, SOME = b"cart:", b"metric:", 20


def _shown(df):
    return df.select("store_id", F.hex("key").alias("key_hex"), "ts", "tombstone")


def sst_prefix_scan(spark, d):
    """Newest user records with a prefix over all runs, tombstones kept; the first 20 keys of each store."""
    return _shown(S.prefix_records(C.with_order(runs(spark, d)), b"user:", SOME, ("store_id", "key"), C.ORDER))


def sst_range_scan_max(spark, d):
    """The first 20 keys of each store in a range over all runs, tombstones kept."""
    return _shown(S.range_records(C.with_order(runs(spark, d)), LOW, HIGH, SOME, ("store_id", "key"), C.ORDER))


def run_range_scan(spark, d):
    """Each run's first 20 records of a key range."""
    one = lww(runs(spark, d), (*RUN, "key"), ("ts",))
    return S.run_range_scan(one, LOW, HIGH, SOME).select(*RUN, F.hex("key").alias("key_hex"), "ts", "tombstone")


def run_prefix_scan(spark, d):
    """Each run's records with a prefix, all of them."""
    one = lww(runs(spark, d), (*RUN, "key"), ("ts",))
    return S.run_prefix_scan(one, b"user:").select(*RUN, F.hex("key").alias("key_hex"), "ts", "tombstone")


def _unflushed(spark, d):
    placed = lookup_join(log(spark, d), last_success(table(spark, d, "wal_runs")), ["store_id"], "left", spread=F.col("file_offset"))
    return placed.where(at_or_after(F.col("file_name"), F.col("file_offset"), F.col("from_file"), F.col("from_offset"))).drop("from_file", "from_offset")


def mem_range_scan(spark, d):
    """Newest records of a key range in what is not flushed yet, tombstones kept."""
    return S.range_records(_unflushed(spark, d).drop("value"), LOW.decode(), HIGH.decode(), None, BY, ORDER).select("store_id", "key", "ts", "seq", "tombstone")


def mem_prefix_scan(spark, d):
    """Newest records with a prefix in what is not flushed yet, tombstones kept."""
    return S.prefix_records(_unflushed(spark, d).drop("value"), "user:", None, BY, ORDER).select("store_id", "key", "ts", "seq", "tombstone")


def sst_encode(spark, d):
    """The bytes of each record of the runs."""
    r = runs(spark, d)
    return r.select(*RUN, F.hex(record_bytes(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))).alias("bytes_hex"))


def sst_decode(spark, d):
    """The records of data blocks of 64 each, read back from their bytes, where their checksums hold."""
    one = runs(spark, d).select(*RUN, record_bytes(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("b"), (F.xxhash64("key") % 64).alias("part"))
    blocks = one.groupBy(*RUN, "part").agg(F.unhex(F.concat_ws("", F.collect_list(F.hex("b")))).alias("block"))
    got = decode(blocks, "block").where("sound AND NOT torn")
    return got.select(*RUN, F.hex("key").alias("key_hex"), F.hex(F.when(~F.col("tombstone"), F.col("value"))).alias("value_hex"), "tombstone", "ts")


def wal_encode(spark, d):
    """The bytes of each delivery as a log record."""
    b = wal_record_bytes(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))
    return log(spark, d).select("store_id", "seq", "file_name", "file_offset", F.hex(b).alias("bytes_hex"))


def wal_decode(spark, d):
    """Deliveries written as log records and read back."""
    b = wal_record_bytes(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("block")
    got = decode(log(spark, d).select("store_id", "seq", "file_name", "file_offset", b), "block", log=True).where("sound AND NOT torn")
    return got.select("store_id", "seq", "file_name", "file_offset", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "tombstone", "ts")


def compact_size_tiered_layout(spark, d):
    """Records, newest time and keys' range of each run after size-tiered compaction."""
    got = C.compact_size_tiered(runs(spark, d))
    return got.groupBy("store_id", "level", "table_id").agg(F.count(F.lit(1)).alias("records"), F.max("ts").alias("newest"), F.hex(F.min("key")).alias("start_hex"), F.hex(F.max("key")).alias("end_hex"))


def wal_differences(spark, d):
    """Deliveries of a change that differ in content from its first one, time aside."""
    from pyspark.sql import Window

    rows = log(spark, d).distinct()
    first = Window.partitionBy("store_id", "seq").orderBy("file_name", "file_offset")
    same = F.col("key").eqNullSafe(F.first("key").over(first)) & F.col("value").eqNullSafe(F.first("value").over(first)) & F.col("tombstone").eqNullSafe(F.first("tombstone").over(first))
    return rows.select("store_id", "seq", "file_name", "file_offset", same.alias("same")).where("NOT same").drop("same")


def merkle_contains(spark, d):
    """Nodes of the nations' tree that are also in the tree with one name changed."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    changed = n.withColumn("n_name", F.when(F.col("n_nationkey") == 7, "ELSEWHERE").otherwise(F.col("n_name")))
    got = M.contains(M.tree(_chunks(n, "n_nationkey")), M.tree(_chunks(changed, "n_nationkey")).select("hash"))
    return got.select(F.lower(F.hex("hash")).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        lsm_merge_runs, lsm_level_read, memtable_flush_runs, sst_record_size, sst_ranges, sst_sparse_index, sst_summary, sst_floor_lookup, sst_point_read, record_checksums, wal_checksums,
        wal_segments, wal_layout, wal_replay, wal_unflushed, compact_size_tiered, compact_size_tiered_tables, compact_leveled, compact_leveled_layout, leveled_overlap, level_budget,
        sst_prefix_scan, sst_range_scan_max, run_range_scan, run_prefix_scan, mem_range_scan, mem_prefix_scan, sst_encode, sst_decode, wal_encode, wal_decode, compact_size_tiered_layout,
        memtable_sizes, memtable_remove, sst_first_records, sst_range_scan, wal_differences, merkle_contains, space_by_level, dict_build, dict_encode, dict_decode, dict_space, merkle_root, merkle_diff, merkle_serialize,
    )
}

_RUNS = "(SELECT DISTINCT store_id, level, table_id, key, value, tombstone, ts FROM sst_records)"


def _uv(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


def _size_sql(key: str = "octet_length(key)", own: str | None = None) -> str:
    own = own or f"({_uv(key)} + {key})"
    v = "coalesce(octet_length(value), 0)"
    return f"CAST(5 + ({_uv('ts')}) + {own} + CASE WHEN tombstone THEN 0 ELSE ({_uv(v)}) + {v} END AS BIGINT)"


def _crc_sql(bytes_: str) -> str:
    step = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    codes = f"list_transform(range(0, octet_length({bytes_})::BIGINT), lambda i: ('0x' || substr(hex({bytes_}), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda crc, b: list_reduce(range(0, 8), {step}, xor(crc, b)), 4294967295::BIGINT), 4294967295)"


_LE8 = "unhex(" + " || ".join(f"substr(printf('%016x', ts), {i}, 2)" for i in range(15, 0, -2)) + ")"
_RECORD = f"({_LE8} || CASE WHEN tombstone THEN '\\x01'::BLOB ELSE '\\x00'::BLOB END || key || CASE WHEN tombstone THEN ''::BLOB ELSE coalesce(value, ''::BLOB) END)"
_NEW_RUN = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY ts DESC, level, table_id DESC) AS rn FROM {_RUNS}) WHERE rn = 1"
_INDEXED = f"""(SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY store_id, level, table_id) AS n,
  CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM (SELECT *, {_size_sql()} AS size FROM {_RUNS}) WINDOW w AS (PARTITION BY store_id, level, table_id ORDER BY key, ts, size))"""
_WAL_SIZE = "29 + coalesce(strlen(key), 0) + coalesce(octet_length(value), 0)"
_DELIVERED = f"(SELECT DISTINCT store_id, file_name, file_offset, seq, CAST({_WAL_SIZE} AS BIGINT) AS size FROM wal_records)"
_MANIFEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, level, table_id ORDER BY flushed_at DESC, start_key DESC, end_key DESC, rows DESC NULLS LAST, bytes DESC NULLS LAST) AS rn FROM run_manifest) WHERE rn = 1)"""
_DICT = "(SELECT key, row_number() OVER (ORDER BY min(seq), key) - 1 AS idx, count(*) AS n FROM wal_records WHERE key IS NOT NULL GROUP BY key)"
_PAIRS = "least(ceil((n - 7) / 2.0), floor(n / 2.0))::BIGINT"


def _tiers() -> str:
    """Counts level by level; go says whether the cascade came to a level and goes on."""
    s = "WITH t AS (SELECT store_id, " + ", ".join(f"count(DISTINCT table_id) FILTER (level = {i}) AS n{i}" for i in range(1, 5)) + " FROM sst_records GROUP BY 1), "
    prev, go = "t", "true"
    for i in range(1, 4):
        n = f"n{i}"
        pairs = f"CASE WHEN {go} AND {n} >= 8 THEN {_PAIRS.replace('n - 7', n + ' - 7').replace('n / 2.0', n + ' / 2.0')} ELSE 0 END"
        stop = f"{n} < 8" if i == 1 else f"{n} = 0"
        others = ", ".join(f"n{j}" for j in range(1, 5) if j not in (i, i + 1))
        s += f"s{i} AS (SELECT store_id, {others}, {n} - 2 * {pairs} AS {n}, n{i + 1} + {pairs} AS n{i + 1}, ({go}) AND NOT ({stop}) AS go FROM {prev}), "
        prev, go = f"s{i}", "go"
    s = s.rstrip(", ") + " "
    return s + " UNION ALL ".join(f"SELECT store_id, CAST({i} AS BIGINT) AS level, CAST(n{i} AS BIGINT) AS tables FROM s3 WHERE n{i} > 0" for i in range(1, 5))


def _tier_layout() -> str:
    """Every run of the tables moved level by level; place counts a level's runs, oldest first."""
    s = "WITH p0 AS (SELECT *, level AS lv, row_number() OVER (PARTITION BY store_id, level ORDER BY table_id) AS place FROM (SELECT DISTINCT store_id, level, table_id FROM sst_records)), g0 AS (SELECT DISTINCT store_id, true AS go FROM p0)"
    for i in range(1, 4):
        stop = "n < 8" if i == 1 else "n = 0"
        s += f""", c{i} AS (SELECT g.store_id, g.go AND NOT ({stop}) AS go, CASE WHEN g.go AND n >= 8 THEN {_PAIRS} ELSE 0 END AS pairs, m FROM g{i - 1} g JOIN (
  SELECT store_id, count(DISTINCT place) FILTER (lv = {i}) AS n, count(DISTINCT place) FILTER (lv = {i + 1}) AS m FROM p{i - 1} GROUP BY 1) USING (store_id)), g{i} AS (SELECT store_id, go FROM c{i}),
p{i} AS (SELECT store_id, level, table_id, CASE WHEN lv = {i} AND place <= 2 * pairs THEN {i + 1} ELSE lv END AS lv,
  CASE WHEN lv <> {i} THEN place WHEN place <= 2 * pairs THEN m + (place + 1) // 2 ELSE place - 2 * pairs END AS place FROM p{i - 1} JOIN c{i} USING (store_id))"""
    return s + f""" SELECT store_id, CAST(lv AS INTEGER) AS level, CAST(place AS INTEGER) AS table_id, count(DISTINCT key) AS records, max(ts) AS newest, hex(min(key)) AS start_hex, hex(max(key)) AS end_hex
FROM p3 JOIN {_RUNS} USING (store_id, level, table_id) GROUP BY ALL"""


def _leveled_layout(first: int = 20_000, fanout: int = 4, block: int = 8_000, levels: int = 4) -> str:
    """The runs after leveled compaction, level by level: what a level gives, what it meets below, and how the merged rows are cut."""
    s = f"WITH r0 AS (SELECT store_id, level AS lv, level AS near, table_id AS tid, key, tombstone, ts, value, {_size_sql()} AS size FROM {_RUNS})"
    for i in range(1, levels):
        budget = first * fanout ** (i - 1)
        gives = "true" if i == 1 else f"total - gone > {budget}"
        outside = f"SELECT 1 FROM t{i} t WHERE t.store_id = n.store_id AND t.s <= n.key AND t.e >= n.key AND NOT EXISTS (SELECT 1 FROM c{i} c WHERE c.store_id = t.store_id AND c.lv = t.lv AND c.tid = t.tid)"
        kept = f"AND (NOT tombstone OR EXISTS ({outside}))" if i + 1 == levels else ""
        s += f""", t{i} AS (SELECT store_id, lv, tid, sum(size) AS bytes, min(key) AS s, max(key) AS e FROM r{i - 1} GROUP BY ALL),
o{i} AS (SELECT *, sum(bytes) OVER (PARTITION BY store_id) AS total, coalesce(sum(bytes) OVER (PARTITION BY store_id ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM t{i} WHERE lv = {i}),
g{i} AS (SELECT * FROM o{i} WHERE total > {budget} AND {gives}),
c{i} AS (SELECT store_id, lv, tid FROM g{i} UNION SELECT t.store_id, t.lv, t.tid FROM t{i} t JOIN g{i} g ON g.store_id = t.store_id AND t.lv = {i + 1} AND t.s <= g.e AND t.e >= g.s),
m{i} AS (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY ts DESC, near, tid DESC, value DESC NULLS LAST) AS rn FROM r{i - 1} SEMI JOIN c{i} c ON c.store_id = r{i - 1}.store_id AND c.lv = r{i - 1}.lv AND c.tid = r{i - 1}.tid),
n{i} AS (SELECT * FROM m{i} n WHERE rn = 1 {kept}),
b{i} AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY store_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n{i}),
p{i} AS (SELECT store_id, max(tid) AS top FROM t{i} WHERE lv = {i + 1} GROUP BY 1),
r{i} AS (SELECT r.* FROM r{i - 1} r ANTI JOIN c{i} c ON c.store_id = r.store_id AND c.lv = r.lv AND c.tid = r.tid
  UNION ALL SELECT store_id, {i + 1}, {i + 1}, (coalesce(top, 0) + 1 + before // {block})::INTEGER, key, tombstone, ts, value, size FROM b{i} LEFT JOIN p{i} USING (store_id))"""
    return s + f" SELECT store_id, CAST(lv AS INTEGER) AS level, CAST(tid AS INTEGER) AS table_id, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes, hex(min(key)) AS start_hex, hex(max(key)) AS end_hex FROM r{levels - 1} GROUP BY ALL"


def _le_hex(x: str, n: int) -> str:
    return "(" + " || ".join(f"substr(printf('%016x', {x}), {i}, 2)" for i in range(15, 15 - 2 * n, -2)) + ")"


def _uv_hex(x: str) -> str:
    return "(" + " || ".join(f"CASE WHEN {x} >= {1 << 7 * n if n else 0} THEN printf('%02x', (({x} >> {7 * n}) & 127) + CASE WHEN {x} >= {1 << 7 * (n + 1)} THEN 128 ELSE 0 END) ELSE '' END" for n in range(5)) + ")"


def _record_hex() -> str:
    v = "coalesce(octet_length(value), 0)"
    return f"upper({_le_hex('c', 4)} || {_uv_hex('ts')} || CASE WHEN tombstone THEN '01' ELSE '00' END || {_uv_hex('octet_length(key)')} || CASE WHEN tombstone THEN '' ELSE {_uv_hex(v)} END || hex(key) || CASE WHEN tombstone THEN '' ELSE coalesce(hex(value), '') END)"


def _merkle_sql(rows: str, order: str, tail: str) -> str:
    """All nodes of a tree over chunks, level by level."""
    return f"""WITH RECURSIVE leaf AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS idx, unhex(sha1(unhex(sha1(chunk)))) AS h FROM ({rows})),
nodes AS (
  SELECT 0 AS level, idx, h, (SELECT count(*) FROM leaf) AS n FROM leaf
  UNION ALL
  SELECT level + 1, idx, unhex(sha1(h || coalesce(r, unhex(repeat('00', 20))))), CAST(ceil(n / 2.0) AS BIGINT) FROM (
    SELECT level, idx // 2 AS idx, h, n, idx % 2 AS odd, lead(h) OVER (ORDER BY idx) AS r FROM nodes WHERE n > 1 OR level = 0)
  WHERE odd = 0)
{tail}"""


_NATION = "SELECT n_nationkey, concat_ws('|', n_nationkey, n_name) AS chunk FROM nation"
_CHANGED = "SELECT n_nationkey, concat_ws('|', n_nationkey, CASE WHEN n_nationkey = 7 THEN 'ELSEWHERE' ELSE n_name END) AS chunk FROM nation"
_CUSTOMER = "SELECT c_custkey, concat_ws('|', c_custkey, c_name, c_mktsegment) AS chunk FROM customer"
_NODES = "SELECT level, idx, lower(hex(h)) AS h FROM nodes"
_PROBED = "(SELECT DISTINCT store_id, encode(key) AS key FROM incoming_records WHERE key IS NOT NULL)"
_POS = """(SELECT store_id, latest_file_name AS pf, byte_offset AS po FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY run_id DESC, latest_file_name DESC, byte_offset DESC) AS rn FROM wal_runs WHERE lower(trim(status)) = 'success') WHERE rn = 1)"""
ORACLE = {
    "lsm_merge_runs": f"SELECT store_id, hex(key) AS key_hex, ts, level, table_id FROM ({_NEW_RUN})",
    "lsm_level_read": f"SELECT store_id, hex(key) AS key_hex, ts, level, table_id FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY level, ts DESC, table_id DESC) AS rn FROM {_RUNS}) WHERE rn = 1",
    "memtable_flush_runs": f"""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY store_id ORDER BY file_name, file_offset) - 1) // {MEMTABLE} AS run_id FROM wal_records WHERE key IS NOT NULL)
SELECT store_id, run_id, key, seq, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY store_id, run_id, key ORDER BY ts DESC, seq DESC, file_name DESC, file_offset DESC) AS rn FROM p) WHERE rn = 1""",
    "sst_record_size": f"SELECT store_id, level, table_id, count(*) AS records, CAST(sum({_size_sql()}) AS BIGINT) AS bytes FROM {_RUNS} GROUP BY ALL",
    "sst_ranges": f"SELECT store_id, level, table_id, hex(min(key)) AS start_hex, hex(max(key)) AS end_hex, count(*) AS rows FROM {_RUNS} GROUP BY ALL",
    "sst_sparse_index": f'SELECT store_id, level, table_id, hex(key) AS key_hex, "offset", idx FROM {_INDEXED} WHERE idx % 5 = 0 OR idx = n - 1',
    "sst_summary": f"SELECT store_id, level, table_id, key_hex, idx FROM (SELECT store_id, level, table_id, hex(key) AS key_hex, row_number() OVER (PARTITION BY store_id, level, table_id ORDER BY key, idx) - 1 AS idx FROM {_INDEXED} WHERE idx % 5 = 0 OR idx = n - 1) WHERE idx % 5 = 0",
    "sst_floor_lookup": f"SELECT p.store_id, p.level, hex(p.key) AS key_hex, hex(e.key) AS match_hex FROM (SELECT * FROM {_PROBED} JOIN (SELECT DISTINCT store_id, level FROM {_RUNS}) USING (store_id)) p ASOF LEFT JOIN (SELECT DISTINCT store_id, level, key FROM {_INDEXED} WHERE idx % 5 = 0 OR idx = n - 1) e ON p.store_id = e.store_id AND p.level = e.level AND p.key >= e.key",
    "sst_point_read": f"SELECT r.store_id, hex(r.key) AS key_hex, r.ts, r.tombstone FROM ({_NEW_RUN}) r SEMI JOIN {_PROBED} p ON p.store_id = r.store_id AND p.key = r.key",
    "record_checksums": f"SELECT store_id, level, count(*) FILTER (crc = c) AS valid, count(*) FILTER (crc <> c) AS invalid, count(*) FILTER (crc IS NULL) AS missing FROM (SELECT *, {_crc_sql('bytes')} AS c FROM (SELECT *, {_RECORD} AS bytes FROM sst_records)) GROUP BY ALL",
    "wal_checksums": f"SELECT store_id, count(*) FILTER (crc = c) AS valid, count(*) FILTER (crc <> c) AS invalid FROM (SELECT store_id, crc, {_crc_sql('bytes')} AS c FROM (SELECT *, coalesce(value, ''::BLOB) AS bytes FROM wal_records)) GROUP BY ALL",
    "wal_segments": f"SELECT store_id, file_name, count(*) AS deliveries, CAST(sum(size) AS BIGINT) AS bytes, min(file_offset) AS first, max(file_offset) AS last FROM (SELECT DISTINCT store_id, file_name, file_offset, size FROM {_DELIVERED}) GROUP BY ALL",
    "wal_layout": f"""SELECT store_id, file_name, file_offset, seq, CAST(before // {SEGMENT - 8} AS BIGINT) AS segment, CAST(before % {SEGMENT - 8} + 8 AS BIGINT) AS start FROM (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY store_id ORDER BY file_name, file_offset, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {_DELIVERED})""",
    "wal_replay": f"SELECT store_id, count(*) AS keys, count(*) FILTER (NOT tombstone) AS live, max(ts) AS newest FROM ({newest_sql()}) GROUP BY 1",
    "wal_unflushed": f"SELECT store_id, count(*) AS deliveries, count(DISTINCT seq) AS changes FROM (SELECT DISTINCT store_id, file_name, file_offset, seq FROM wal_records) LEFT JOIN {_POS} USING (store_id) WHERE coalesce(file_name > pf OR (file_name = pf AND file_offset >= po), true) GROUP BY 1",
    "compact_size_tiered": f"SELECT store_id, hex(key) AS key_hex, max(ts) AS ts FROM {_RUNS} GROUP BY ALL",
    "compact_size_tiered_tables": _tiers(),
    "compact_leveled": f"SELECT store_id, hex(key) AS key_hex, ts FROM ({_NEW_RUN}) WHERE NOT tombstone",
    "leveled_overlap": f"SELECT a.store_id, a.level, a.table_id, count(b.table_id) AS overlaps, CAST(coalesce(sum(b.bytes), 0) AS BIGINT) AS overlap_bytes FROM {_MANIFEST} a LEFT JOIN {_MANIFEST} b ON b.store_id = a.store_id AND b.level = a.level + 1 AND b.start_key <= a.end_key AND b.end_key >= a.start_key GROUP BY ALL",
    "level_budget": f"SELECT store_id, level, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes, CAST(20000 * 4 ** (level - 1) AS BIGINT) AS budget, sum(coalesce(bytes, 0)) > 20000 * 4 ** (level - 1) AND level < 4 AS over FROM {_MANIFEST} GROUP BY store_id, level",
    "space_by_level": f"SELECT store_id, level, count(DISTINCT table_id) AS tables, count(*) AS records, CAST(sum({_size_sql()}) AS BIGINT) AS bytes, count(DISTINCT key) AS keys FROM {_RUNS} GROUP BY ALL",
    "dict_build": f"SELECT key, idx, n FROM {_DICT}",
    "dict_encode": f"SELECT store_id, seq, file_name, file_offset, idx FROM wal_records w LEFT JOIN {_DICT} d ON d.key = w.key",
    "dict_decode": "SELECT store_id, seq, file_name, file_offset, key FROM wal_records",
    "dict_space": f"""WITH d AS (SELECT key, row_number() OVER (ORDER BY min(ts), key) - 1 AS idx FROM {_RUNS} GROUP BY key)
SELECT store_id, CAST(sum({_size_sql()}) AS BIGINT) AS plain, CAST(sum({_size_sql(own='(' + _uv('idx') + ')')}) AS BIGINT) AS packed FROM (SELECT r.*, d.idx FROM {_RUNS} r JOIN d ON d.key = r.key) GROUP BY 1""",
    "merkle_root": _merkle_sql(_CUSTOMER, "c_custkey", "SELECT lower(hex(h)) AS root, CAST(level AS BIGINT) AS levels FROM nodes ORDER BY level DESC LIMIT 1"),
    "merkle_diff": "SELECT a.level, a.idx, a.h AS a_hash, b.h AS b_hash FROM (" + _merkle_sql(_NATION, "n_nationkey", _NODES) + ") a JOIN (" + _merkle_sql(_CHANGED, "n_nationkey", _NODES) + ") b ON a.level = b.level AND a.idx = b.idx WHERE a.h <> b.h",
    "merkle_serialize": _merkle_sql(_NATION, "n_nationkey", "SELECT row_number() OVER (ORDER BY level DESC, idx) - 1 AS place, lower(hex(h)) AS hash FROM nodes"),
}
_USER = "decode(key) <> '__TB_RATE_LIMIT__' AND NOT regexp_matches(decode(key), '^__(BF|CMS|HLL|SH)_')"
_SCANNED = f"SELECT store_id, hex(key) AS key_hex, ts, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY key) AS place FROM ({_NEW_RUN}) WHERE {{where}} AND {_USER}) WHERE place <= {SOME}"
_IN_RUN = f"(SELECT *, row_number() OVER (PARTITION BY store_id, level, table_id ORDER BY key) AS place FROM (SELECT *, row_number() OVER (PARTITION BY store_id, level, table_id, key ORDER BY ts DESC, value DESC NULLS LAST, tombstone DESC) AS rn FROM {_RUNS}) WHERE rn = 1 AND {_USER} AND {{where}})"
_UNFLUSHED = f"(SELECT wal_records.* FROM wal_records LEFT JOIN {_POS} USING (store_id) WHERE coalesce(file_name > pf OR (file_name = pf AND file_offset >= po), true))"
_BOUNDS, _PREFIX = f"key BETWEEN '{LOW.decode()}'::BLOB AND '{HIGH.decode()}'::BLOB", "substr(hex(key), 1, 10) = hex('user:'::BLOB)"
ORACLE |= {
    "sst_prefix_scan": _SCANNED.format(where=_PREFIX),
    "sst_range_scan_max": _SCANNED.format(where=_BOUNDS),
    "run_range_scan": f"SELECT store_id, level, table_id, hex(key) AS key_hex, ts, tombstone FROM {_IN_RUN.format(where=_BOUNDS)} WHERE place <= {SOME}",
    "run_prefix_scan": f"SELECT store_id, level, table_id, hex(key) AS key_hex, ts, tombstone FROM {_IN_RUN.format(where=_PREFIX)}",
    "mem_range_scan": f"SELECT store_id, key, ts, seq, tombstone FROM ({newest_sql(_UNFLUSHED)}) WHERE key BETWEEN '{LOW.decode()}' AND '{HIGH.decode()}' AND NOT {RESERVED_SQL}",
    "mem_prefix_scan": f"SELECT store_id, key, ts, seq, tombstone FROM ({newest_sql(_UNFLUSHED)}) WHERE starts_with(key, 'user:') AND NOT {RESERVED_SQL}",
    "sst_encode": f"SELECT store_id, level, table_id, {_record_hex()} AS bytes_hex FROM (SELECT *, {_crc_sql('bytes')} AS c FROM (SELECT *, {_RECORD} AS bytes FROM {_RUNS}))",
    "sst_decode": f"SELECT store_id, level, table_id, hex(key) AS key_hex, CASE WHEN tombstone THEN NULL ELSE coalesce(hex(value), '') END AS value_hex, tombstone, ts FROM {_RUNS}",
    "wal_encode": f"SELECT store_id, seq, file_name, file_offset, upper({_le_hex('c', 4)} || {_le_hex('ts', 8)} || CASE WHEN tombstone THEN '01' ELSE '00' END || {_le_hex('coalesce(strlen(key), 0)', 8)} || {_le_hex('coalesce(octet_length(value), 0)', 8)} || coalesce(hex(encode(key)), '') || coalesce(hex(value), '')) AS bytes_hex FROM (SELECT *, {_crc_sql('bytes')} AS c FROM (SELECT *, coalesce(value, ''::BLOB) AS bytes FROM wal_records))",
    "wal_decode": "SELECT store_id, seq, file_name, file_offset, coalesce(hex(encode(key)), '') AS key_hex, coalesce(hex(value), '') AS value_hex, tombstone, ts FROM wal_records",
    "compact_size_tiered_layout": _tier_layout(),
    "compact_leveled_layout": _leveled_layout(),
    "memtable_sizes": f"SELECT store_id, run_id, count(DISTINCT key) AS keys FROM (SELECT *, (row_number() OVER (PARTITION BY store_id ORDER BY file_name, file_offset) - 1) // {MEMTABLE} AS run_id FROM wal_records WHERE key IS NOT NULL) GROUP BY ALL",
    "memtable_remove": f"SELECT store_id, key, seq, tombstone FROM ({newest_sql()}) n ANTI JOIN (SELECT DISTINCT store_id, key FROM incoming_records WHERE key IS NOT NULL) i ON i.store_id = n.store_id AND i.key = n.key",
    "sst_first_records": f"SELECT store_id, level, table_id, hex(min(key)) AS key_hex FROM {_RUNS} GROUP BY ALL",
    "sst_range_scan": f"SELECT store_id, hex(key) AS key_hex, ts, tombstone FROM ({_NEW_RUN}) WHERE key BETWEEN 'cart:'::BLOB AND 'metric:'::BLOB AND decode(key) <> '__TB_RATE_LIMIT__'",
    "wal_differences": """SELECT store_id, seq, file_name, file_offset FROM (
  SELECT *, first_value(key) OVER w IS NOT DISTINCT FROM key AND first_value(value) OVER w IS NOT DISTINCT FROM value AND first_value(tombstone) OVER w IS NOT DISTINCT FROM tombstone AS same
  FROM (SELECT DISTINCT store_id, seq, file_name, file_offset, key, value, tombstone FROM wal_records) WINDOW w AS (PARTITION BY store_id, seq ORDER BY file_name, file_offset)) WHERE NOT same""",
    "merkle_contains": "SELECT a.h AS hash FROM (" + _merkle_sql(_NATION, "n_nationkey", _NODES) + ") b JOIN (" + _merkle_sql(_CHANGED, "n_nationkey", _NODES) + ") a ON a.h = b.h",
}
