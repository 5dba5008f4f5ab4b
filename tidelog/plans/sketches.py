"""Queries on sketches, rate limits and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.encoding import le8
from tidelog.functions.hashing import seeded_state
from tidelog.operators import bloom as B
from tidelog.operators import cms as K
from tidelog.operators import hll as H
from tidelog.operators import limiter, lru
from tidelog.operators import simhash as S
from tidelog.operators.ordered import running
from tidelog.sources.tables import table

PRECISION = 0.01
CR, CC = K.sizing(0.01, 0.01)
P, SEED = 12, 1
TOKENS, SECONDS = 3, 86_400
CAPACITY = 64


def _sizes(spark):
    return spark.createDataFrame([(1000, 0.1), (1000, 0.01), (20_000, 0.01), (1_000_000, 0.001)], "n bigint, p double")


def bloom_params(spark, d):
    m = F.ceil(F.col("n") * F.abs(F.log("p")) / F.lit(0.6931471805599453) ** 2)
    return _sizes(spark).withColumn("m", m).withColumn("k", F.ceil(F.col("m") / F.col("n") * 0.6931471805599453))


def _finished(spark, d):
    """The keys of finished orders, and the sizing that their number asks for."""
    keys = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return keys, *B.sizing(max(1, keys.distinct().count()), PRECISION)


def bloom_build(spark, d):
    """Bits set by the keys of finished orders, in a filter of the size that their number asks for."""
    keys, m, k = _finished(spark, d)
    return B.build(keys, "o_orderkey", m, k, SEED)


def bloom_probe(spark, d):
    """All orders' keys asked of that filter."""
    keys, m, k = _finished(spark, d)
    return B.probe(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", B.build(keys, "o_orderkey", m, k, SEED), m, k, SEED)


def bloom_probe_joined(spark, d):
    """The same by the way that filters beyond the bitmap's bound take."""
    keys, m, k = _finished(spark, d)
    return B.probe(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", B.build(keys, "o_orderkey", m, k, SEED), m, k, SEED, most_bits=0)


def cms_params(spark, d):
    s = spark.createDataFrame([(0.01, 0.01), (0.001, 0.01), (0.1, 0.5)], "epsilon double, delta double")
    e = F.lit(2.718281828459045)
    return s.withColumn("rows", F.ceil(F.log(e / F.col("delta")))).withColumn("cols", F.ceil(e / F.col("epsilon")))


def _cms(spark, d):
    return K.build(table(spark, d, "lineitem"), "l_partkey", CR, CC, SEED)


def cms_build(spark, d):
    return _cms(spark, d).select("row", "col", "cnt")


def cms_estimate(spark, d):
    """Estimated counts of every part."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item"))
    return K.estimate(parts, _cms(spark, d), CR, CC, SEED)


def cms_estimate_mod256(spark, d):
    """The same with counters of one byte."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item"))
    return K.estimate(parts, _cms(spark, d), CR, CC, SEED, wrap=256)


def hll_registers(spark, d):
    return H.registers(table(spark, d, "lineitem"), "l_orderkey", P, SEED)


def hll_estimate(spark, d):
    return H.estimate(H.registers(table(spark, d, "lineitem"), "l_orderkey", P, SEED), P).select(F.round("estimate", 4).alias("estimate"))


def hll_estimate_by_group(spark, d):
    r = H.registers(table(spark, d, "lineitem"), "l_orderkey", P, SEED, ("l_returnflag",))
    return H.estimate(r, P, ("l_returnflag",)).select("l_returnflag", F.round("estimate", 4).alias("estimate"))


def hll_union(spark, d):
    """Distinct part keys over line items and parts, from two partial sketches."""
    a = H.registers(table(spark, d, "lineitem"), "l_partkey", P, SEED)
    b = H.registers(table(spark, d, "part"), "p_partkey", P, SEED)
    return H.estimate(H.union(a, b), P).select(F.round("estimate", 4).alias("estimate"))


def native_hll(spark, d):
    """The engine's own sketch, merged over groups."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_agg("l_orderkey", 12).alias("s"))
    return g.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("estimate"))


def native_cms(spark, d):
    return table(spark, d, "lineitem").agg(F.length(F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.99), F.lit(1))).alias("bytes"))


def native_bloom(spark, d):
    keys = table(spark, d, "orders").where("o_orderstatus = 'F'")
    f = B.native(keys, "o_orderkey", max(1, keys.select("o_orderkey").distinct().count()), PRECISION)
    return spark.createDataFrame([(int(f.bitSize()), bool(f.mightContain(-1)))], "bits bigint, has_minus_one boolean")


def bloom_bytes(spark, d):
    """The filter of finished orders as it is stored."""
    keys, m, k = _finished(spark, d)
    blob = B.serialize(m, k, keys.distinct().count(), SEED, B.bitmap(B.build(keys, "o_orderkey", m, k, SEED), m))
    return spark.createDataFrame([(blob.hex(),)], "bytes_hex string")


def bloom_restored(spark, d):
    """The places of the set bits in a filter that was stored and read again."""
    keys, m, k = _finished(spark, d)
    _, _, _, _, bits = B.deserialize(B.serialize(m, k, 0, SEED, B.bitmap(B.build(keys, "o_orderkey", m, k, SEED), m)))
    return B.places(spark, bits)


def cms_bytes(spark, d):
    """The sketch of line items' parts as it is stored, one byte a counter."""
    return spark.createDataFrame([(K.serialize(_cms(spark, d), CR, CC, SEED).hex(),)], "bytes_hex string")


def cms_restored(spark, d):
    """Cells that aren't 0 in a sketch that was stored and read again."""
    _, _, _, cells = K.deserialize(K.serialize(_cms(spark, d), CR, CC, SEED))
    return spark.createDataFrame([(i, c, int(n)) for i, row in enumerate(cells.tolist()) for c, n in enumerate(row) if n], "row int, col bigint, cnt bigint")


def hll_bytes(spark, d):
    """The registers of line items' orders as they are stored."""
    regs = {r["bucket"]: r["reg"] for r in H.registers(table(spark, d, "lineitem"), "l_orderkey", P, SEED).toLocalIterator()}
    return spark.createDataFrame([(H.serialize(regs, P, SEED).hex(),)], "bytes_hex string")


def hll_restored(spark, d):
    """Registers that were stored and read again."""
    regs = {r["bucket"]: r["reg"] for r in H.registers(table(spark, d, "lineitem"), "l_orderkey", P, SEED).toLocalIterator()}
    _, back, _ = H.deserialize(H.serialize(regs, P, SEED))
    return spark.createDataFrame(list(back.items()), "bucket bigint, reg int")


def simhash_bytes(spark, d):
    """Each fingerprint as it is stored, eight bytes, least significant first."""
    return S.fingerprints(table(spark, d, "documents")).where("fingerprint IS NOT NULL").select(F.col("id").alias("doc_id"), F.hex(le8(F.col("fingerprint"))).alias("bytes_hex"))


def native_bound(spark, d):
    """Whether the engine's own distinct count of line items' orders lies within five standard errors of the exact one."""
    got = table(spark, d, "lineitem").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey", F.lit(12))).alias("e"), F.countDistinct("l_orderkey").alias("n"))
    return got.select((F.abs(F.col("e") - F.col("n")) <= 5 * H.standard_error(12) * F.col("n")).alias("within"))


def simhash_fingerprint(spark, d):
    return S.fingerprints(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "fingerprint")


def simhash_hamming(spark, d):
    """Distance of each page to the last fetch before it of the same url, a null url being one too."""
    docs = table(spark, d, "documents")
    p = S.fingerprints(docs).where("fingerprint IS NOT NULL").join(docs.select(F.col("doc_id").alias("id"), F.coalesce("url", F.lit("\0")).alias("url"), "fetched_at"), "id")
    placed = running(p, ["url", "fetched_at", "id"], None, ["url"])
    before = placed.select("url", (F.col("idx") + 1).alias("idx"), F.col("id").alias("other"), F.col("fingerprint").alias("f2"))
    return placed.join(before, ["url", "idx"]).select(F.col("id").alias("doc_id"), "other", S.hamming("fingerprint", "f2").cast("bigint").alias("distance"))


def _classes(spark, d):
    return S.classes(S.fingerprints(table(spark, d, "documents")))


def simhash_classes(spark, d):
    """Each document with the class of its exact fingerprint."""
    p = S.fingerprints(table(spark, d, "documents"))
    return p.join(S.classes(p).select("fingerprint", "class_id"), "fingerprint").select(F.col("id").alias("doc_id"), "class_id")


def simhash_near_dups(spark, d):
    """Classes within three bits of each other; simhash_classes has their members."""
    return S.near_pairs(_classes(spark, d), 3).select("a", "b", F.col("distance").cast("bigint").alias("distance"))


def simhash_features(spark, d):
    """Fingerprint of each order over its parts, each line item being a feature of weight 1."""
    got = S.of_bytes(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("part")), "l_orderkey", "part")
    return got.select(F.col("id").alias("l_orderkey"), "fingerprint")


def _clicks(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))


def token_bucket_admit(spark, d):
    """Events of each user and second, and how many a bucket of 3 a day lets through."""
    return limiter.admit(_clicks(spark, d), "user_id", "ts", TOKENS, SECONDS)


def token_bucket_each(spark, d):
    """Each event, allowed or not."""
    return limiter.admit_each(_clicks(spark, d), "user_id", "ts", "event_id", TOKENS, SECONDS).select(F.col("seq").alias("event_id"), "limiter", "allowed")


def lru_hits(spark, d):
    """Which events would find their user in a cache of 64."""
    got = lru.hits(_clicks(spark, d), "user_id", ["ts", "event_id"], CAPACITY)
    return got.select("idx", F.col("item").cast("bigint").alias("user_id"), "hit")


QUERIES = {
    f.__name__: f
    for f in (
        bloom_params, bloom_build, bloom_probe, bloom_probe_joined, cms_params, cms_build, cms_estimate, cms_estimate_mod256, hll_registers, hll_estimate, hll_estimate_by_group, hll_union,
        native_hll, native_cms, native_bloom, native_bound, bloom_bytes, bloom_restored, cms_bytes, cms_restored, hll_bytes, hll_restored, simhash_bytes, simhash_fingerprint, simhash_hamming, simhash_classes, simhash_near_dups, simhash_features, token_bucket_admit, token_bucket_each, lru_hits,
    )
}


def fnv_sql(col: str, seed: int) -> str:
    """Seeded FNV-1a 64 of a VARCHAR as unsigned HUGEINT."""
    h = f"hex(encode({col}))"
    return f"list_reduce(list_transform(range(0, strlen({col})::BIGINT), lambda i: ('0x' || substr({h}, (2 * i + 1)::BIGINT, 2))::HUGEINT), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, {seeded_state(seed)}::HUGEINT)"


def _many(keys: str, n: int, mod: int | str) -> str:
    """(k, i, pos) of the keys under n seeds."""
    return "(" + " UNION ALL ".join(f"SELECT k, {i} AS i, CAST({fnv_sql('k', SEED + i)} % {mod} AS BIGINT) AS pos FROM ({keys})" for i in range(n)) + ")"


_F_KEYS = "SELECT DISTINCT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderstatus = 'F'"
_ALL_KEYS = "SELECT DISTINCT o_orderkey::VARCHAR AS k FROM orders"
BK = B.sizing(1_000_000, PRECISION)[1]
BM = f"(SELECT greatest(ceil(count(*) * abs(ln({PRECISION})) / pow(ln(2), 2)), 1)::HUGEINT FROM ({_F_KEYS}))"
_BITS = f"SELECT DISTINCT pos FROM {_many(_F_KEYS, BK, BM)}"
_PROBE = f"""WITH bits AS ({_BITS}), ok AS (SELECT k, bool_and(b.pos IS NOT NULL) AS maybe FROM {_many(_ALL_KEYS, BK, BM)} p LEFT JOIN bits b ON b.pos = p.pos GROUP BY k)
SELECT o_orderkey, maybe FROM orders JOIN ok ON ok.k = o_orderkey::VARCHAR"""
_COUNTED = "SELECT DISTINCT l_partkey::VARCHAR AS k FROM lineitem"
_CELLS = f"""(SELECT i AS row, pos AS col, CAST(sum(n) AS BIGINT) AS cnt FROM {_many(_COUNTED, CR, CC)} p JOIN (SELECT l_partkey::VARCHAR AS k2, count(*) AS n FROM lineitem GROUP BY 1) c ON c.k2 = p.k GROUP BY ALL)"""
_PART_KEYS = "SELECT DISTINCT p_partkey::VARCHAR AS k FROM part"


def _estimate(cnt: str) -> str:
    return f"SELECT k AS item, min({cnt}) AS estimate FROM {_many(_PART_KEYS, CR, CC)} p LEFT JOIN {_CELLS} c ON c.row = p.i AND c.col = p.pos GROUP BY k"


def _hll(source: str, key: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    h = f"('0x' || substr(md5('\\x01\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB || encode({key}::VARCHAR)), 1, 16))::UBIGINT"
    reg = "CASE WHEN h = 0 THEN 65 ELSE bit_count(xor(h, h - 1)) END"
    return f"(SELECT {g}CAST(h >> {64 - P} AS BIGINT) AS bucket, CAST(max({reg}) AS INTEGER) AS reg FROM (SELECT {g}{h} AS h FROM {source}) GROUP BY ALL)"


def _hll_estimate(regs: str, by: str = "") -> str:
    m, g = 1 << P, f"{by}, " if by else ""
    a = 0.7213 / (1 + 1.079 / m)
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {g}round(CASE WHEN raw <= {2.5 * m} AND v > 0 THEN {float(m)} * ln({float(m)} / v) ELSE raw END, 4) AS estimate
FROM (SELECT {g}v, {a * m * m!r} / (s + v) AS raw FROM (SELECT {g}sum(pow(2.0, -reg)) AS s, ({m} - count(*))::DOUBLE AS v FROM {regs} {group}))"""


_WORDS = r"""(SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\b[^\W\d][\w''-]*\b'))) AS w FROM documents) GROUP BY ALL)"""
_SIGNED = "CASE WHEN f >= 9223372036854775808::HUGEINT THEN CAST(f - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(f AS BIGINT) END"
_PRINTS = f"""(WITH words AS {_WORDS}, hashed AS (SELECT w, CAST({fnv_sql('w', S.SEED)} AS UBIGINT) AS h FROM (SELECT DISTINCT w FROM words)),
votes AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS v FROM words JOIN hashed USING (w), (SELECT unnest(range(0, 64))::UBIGINT AS i) GROUP BY ALL),
sums AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END)::HUGEINT AS f FROM votes GROUP BY 1)
SELECT d.doc_id, {_SIGNED} AS fingerprint FROM documents d LEFT JOIN sums s USING (doc_id))"""
_CLASS = f"(SELECT fingerprint, min(doc_id) AS class_id FROM {_PRINTS} WHERE fingerprint IS NOT NULL GROUP BY 1)"
_DISTANCE = "bit_count(xor(a.fingerprint, b.fingerprint)::BIGINT::BIT)"
_CLICKS = "(SELECT user_id::VARCHAR AS limiter, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"
_BUCKETS = f"""WITH RECURSIVE e AS (SELECT limiter, ts, count(*) AS n FROM {_CLICKS} GROUP BY ALL),
w AS (SELECT limiter, min(ts) AS s FROM e GROUP BY 1
  UNION ALL SELECT w.limiter, (SELECT min(e.ts) FROM e WHERE e.limiter = w.limiter AND e.ts >= w.s + {SECONDS}) FROM w WHERE w.s IS NOT NULL),
placed AS (SELECT e.*, w.s AS window_start FROM e ASOF JOIN (SELECT * FROM w WHERE s IS NOT NULL) w ON e.limiter = w.limiter AND e.ts >= w.s),
got AS (SELECT limiter, ts, n, window_start, CAST(greatest(0, least(n, {TOKENS} - coalesce(sum(n) OVER (PARTITION BY limiter, window_start ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allowed FROM placed)
"""


def _le(x, n: int) -> str:
    """A number as n bytes in hex, least significant first."""
    return "(" + " || ".join(f"substr(printf('%016x', {x}), {i}, 2)" for i in range(15, 15 - 2 * n, -2)) + ")"


ORACLE = {
    "bloom_params": "SELECT n, p, CAST(ceil(n * abs(ln(p)) / pow(ln(2), 2)) AS BIGINT) AS m, CAST(ceil(ceil(n * abs(ln(p)) / pow(ln(2), 2)) / n * ln(2)) AS BIGINT) AS k FROM (VALUES (1000::BIGINT, 0.1::DOUBLE), (1000, 0.01), (20000, 0.01), (1000000, 0.001)) t(n, p)",
    "bloom_build": _BITS,
    "bloom_probe": _PROBE,
    "bloom_probe_joined": _PROBE,
    "cms_params": "SELECT epsilon, delta, CAST(ceil(ln(exp(1) / delta)) AS BIGINT) AS rows, CAST(ceil(exp(1) / epsilon) AS BIGINT) AS cols FROM (VALUES (0.01::DOUBLE, 0.01::DOUBLE), (0.001, 0.01), (0.1, 0.5)) t(epsilon, delta)",
    "cms_build": f"SELECT row, col, cnt FROM {_CELLS}",
    "cms_estimate": _estimate("coalesce(cnt, 0)"),
    "cms_estimate_mod256": _estimate("coalesce(cnt, 0) % 256"),
    "hll_registers": f"SELECT bucket, reg FROM {_hll('lineitem', 'l_orderkey')}",
    "hll_estimate": _hll_estimate(_hll("lineitem", "l_orderkey")),
    "hll_estimate_by_group": _hll_estimate(_hll("lineitem", "l_orderkey", "l_returnflag"), "l_returnflag"),
    "hll_union": _hll_estimate(f"(SELECT bucket, max(reg) AS reg FROM (SELECT * FROM {_hll('lineitem', 'l_partkey')} UNION ALL SELECT * FROM {_hll('part', 'p_partkey')}) GROUP BY 1)"),
    "simhash_fingerprint": f"SELECT doc_id, fingerprint FROM {_PRINTS}",
    "simhash_hamming": f"""SELECT doc_id, other, CAST(bit_count(xor(fingerprint, f2)) AS BIGINT) AS distance FROM (
  SELECT doc_id, fingerprint, lag(doc_id) OVER w AS other, lag(fingerprint) OVER w AS f2 FROM {_PRINTS} JOIN (SELECT doc_id, url, fetched_at FROM documents) USING (doc_id)
  WHERE fingerprint IS NOT NULL WINDOW w AS (PARTITION BY url ORDER BY fetched_at, doc_id)) WHERE other IS NOT NULL""",
    "simhash_classes": f"SELECT doc_id, class_id FROM {_PRINTS} JOIN {_CLASS} USING (fingerprint)",
    "simhash_near_dups": f"SELECT a.class_id AS a, b.class_id AS b, CAST(bit_count(xor(a.fingerprint, b.fingerprint)) AS BIGINT) AS distance FROM {_CLASS} a JOIN {_CLASS} b ON a.class_id < b.class_id WHERE bit_count(xor(a.fingerprint, b.fingerprint)) <= 3",
    "bloom_bytes": f"""WITH bits AS ({_BITS}), m AS (SELECT {BM}::BIGINT AS m, (SELECT count(*) FROM ({_F_KEYS})) AS n),
bytes AS (SELECT pos // 8 AS byte, CAST(sum(1 << (pos % 8)::INTEGER) AS BIGINT) AS v FROM bits GROUP BY 1)
SELECT {_le('m', 4)} || {_le(BK, 4)} || {_le('n', 4)} || {' || '.join(_le(SEED + i, 8) for i in range(BK))} || {_le('m', 4)} ||
  (SELECT string_agg(printf('%02x', coalesce(v, 0)), '' ORDER BY i) FROM range(0, ((SELECT m FROM m) + 7) // 8) r(i) LEFT JOIN bytes ON byte = i) AS bytes_hex FROM m""",
    "bloom_restored": _BITS,
    "cms_bytes": f"""SELECT {_le(CR, 4)} || {_le(CC, 4)} || {' || '.join(_le(SEED + i, 8) for i in range(CR))} ||
  (SELECT string_agg(printf('%02x', coalesce(cnt, 0) % 256), '' ORDER BY i) FROM range(0, {CR * CC}) r(i) LEFT JOIN {_CELLS} ON row * {CC} + col = i) AS bytes_hex""",
    "cms_restored": f"SELECT row, col, cnt % 256 AS cnt FROM {_CELLS} WHERE cnt % 256 > 0",
    "hll_bytes": f"""SELECT {_le(P, 4)} || {_le(1 << P, 4)} || string_agg(printf('%02x', coalesce(reg, 0)) || '000000', '' ORDER BY i) || '{'00' * 8}' || {_le(SEED, 8)} AS bytes_hex FROM range(0, {1 << P}) r(i) LEFT JOIN {_hll('lineitem', 'l_orderkey')} ON bucket = i""",
    "hll_restored": f"SELECT bucket, reg FROM {_hll('lineitem', 'l_orderkey')}",
    "simhash_bytes": f"SELECT doc_id, upper({_le('fingerprint', 8)}) AS bytes_hex FROM {_PRINTS} WHERE fingerprint IS NOT NULL",
    "native_bound": "SELECT true AS within",
    "simhash_features": f"""WITH hashed AS (SELECT k, CAST({fnv_sql('k', S.SEED)} AS UBIGINT) AS h FROM ({_COUNTED})),
votes AS (SELECT l_orderkey, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM lineitem JOIN hashed ON k = l_partkey::VARCHAR, (SELECT unnest(range(0, 64))::UBIGINT AS i) GROUP BY ALL),
sums AS (SELECT l_orderkey, sum(CASE WHEN v > 0 THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END)::HUGEINT AS f FROM votes GROUP BY 1)
SELECT l_orderkey, {_SIGNED} AS fingerprint FROM sums""",
    "token_bucket_admit": _BUCKETS + "SELECT * FROM got",
    "token_bucket_each": _BUCKETS + f"SELECT event_id, limiter, place <= allowed AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY limiter, ts ORDER BY event_id) AS place FROM {_CLICKS}) JOIN (SELECT limiter, ts, allowed FROM got) USING (limiter, ts)",
    "lru_hits": f"""WITH s AS (SELECT user_id, row_number() OVER (ORDER BY floor(epoch(ts)), event_id) - 1 AS idx FROM events), p AS (SELECT *, lag(idx) OVER (PARTITION BY user_id ORDER BY idx) AS last FROM s)
SELECT idx, user_id, coalesce(last IS NOT NULL AND (SELECT count(DISTINCT q.user_id) FROM s q WHERE q.idx > p.last AND q.idx < p.idx) < {CAPACITY}, false) AS hit FROM p""",
}
