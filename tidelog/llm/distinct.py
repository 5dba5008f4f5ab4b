"""Distinct counts over huge identifier sets.

Method: log-log registers. An identifier's hash names a register by its first p bits; a register
keeps the greatest rank of the first one bit in the rest. Registers are a relation, one row per
register that was ever set, so partial results merge by the maximum and any cell of the cube of day,
store and namespace comes from the registers of its parts. Standard error: 1.04 / sqrt(2^p).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.skew import lookup_join
from tidelog.session import cut

P = 12
DIMS = ["day", "store_id", "namespace"]
#: Standard errors within which a comparison with an estimate is not trusted.
DOUBT = 6.0


def standard_error(p: int = P) -> float:
    return 1.04 / math.sqrt(1 << p)


def with_cells(log: DataFrame) -> DataFrame:
    """(day, store_id, namespace, key): UTC day of ts as text and the key up to its first colon.

    Rows with a null key or a null ts belong to no cell. A key without a colon has the empty
    namespace.
    """
    ns = F.when(F.instr("key", ":") > 0, F.substring_index("key", ":", 1)).otherwise(F.lit(""))
    day = F.date_format(F.date_from_unix_date((F.floor(F.col("ts") / 86400)).cast("int")), "yyyy-MM-dd")
    return log.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).select(day.alias("day"), "store_id", ns.alias("namespace"), "key")


def registers(rows: DataFrame, ids: list[str], dims: list[str], p: int = P) -> DataFrame:
    """(dims, bucket, rank, rows): the set registers of each cell and the rows that met them.

    4 <= p <= 16. The identifier is the tuple of the ids; nulls in it are hashed as any value. A cell
    has at most 2^p rows however many identifiers it has, after partial aggregation even before the
    shuffle, and the grouping by register splits a cell with a third of all rows.
    """
    if not 4 <= p <= 16:
        raise ValueError("p must be in 4..16")
    h = F.xxhash64(*ids)
    rest_bits = 64 - p
    rest = F.col("__h").bitwiseAND(F.lit((1 << rest_bits) - 1))
    rank = F.when(rest == 0, rest_bits + 1).otherwise(rest_bits + 1 - F.length(F.bin(rest)))
    hashed = rows.select(*dims, h.alias("__h"))
    return (
        hashed.select(*dims, F.shiftrightunsigned("__h", rest_bits).cast("int").alias("bucket"), rank.cast("int").alias("rank"))
        .groupBy(*dims, "bucket")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("rows"))
    )


def merge(parts: DataFrame, dims: list[str]) -> DataFrame:
    """Registers of coarser cells, or of several partial results: the maximum of each register."""
    return parts.groupBy(*dims, "bucket").agg(F.max("rank").alias("rank"), F.sum("rows").alias("rows"))


def cube(parts: DataFrame, dims: list[str], total: str = "*", sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Registers of every combination of the dims; a dim summed over shows as `total`.

    Works on registers, not rows: the input is repeated once per combination, with partial
    aggregation before the shuffle. The dims come out as text. `over` tells which dims were
    summed over, as a text of 0 and 1, for a value could itself be `total`.
    """
    if sets is None:
        sets = [tuple(d for i, d in enumerate(dims) if m >> i & 1) for m in range(1 << len(dims))]
    marks = F.explode(F.array(*[F.lit("".join("0" if d in s else "1" for d in dims)) for s in sets]))
    wide = parts.withColumn("over", marks)
    cells = [F.when(F.substring("over", i + 1, 1) == "1", F.lit(total)).otherwise(F.col(d).cast("string")).alias(d) for i, d in enumerate(dims)]
    return merge(wide.select(*cells, "over", "bucket", "rank", "rows"), [*dims, "over"])


def _sigma(x: Column) -> Column:
    """x + sum of x^(2^k) 2^(k-1): what empty registers add; 26 terms suffice for p <= 16."""
    return sum((F.pow(x, F.lit(float(2**k))) * float(2 ** (k - 1)) for k in range(1, 27)), x)


def estimates(regs: DataFrame, dims: list[str], p: int = P) -> DataFrame:
    """(dims, rows, estimate, std_error): the estimate without range switches or bias tables.

    Uses the improved raw estimator, alpha m^2 / (m sigma(empty/m) + sum of 2^-rank).
    """
    m = float(1 << p)
    z = F.sum(F.pow(F.lit(2.0), -F.col("rank")))
    got = regs.groupBy(*dims).agg(F.sum("rows").alias("rows"), z.alias("z"), F.count(F.lit(1)).alias("used"))
    est = F.lit(m * m / (2 * math.log(2))) / (F.col("z") + m * _sigma((F.lit(m) - F.col("used")) / m))
    return got.select(*dims, "rows", est.alias("estimate"), (est * standard_error(p)).alias("std_error"))


def mostly_distinct(log: DataFrame, regs: DataFrame, least_rows: int = 30, part: tuple[int, int] = (4, 5), p: int = P) -> DataFrame:
    """(day, store_id, namespace) cells, and (day, store_id, '*'), whose distinct keys are a large part of the rows.

    The registers decide each cell whose estimate lies more than DOUBT standard errors (and three
    keys, for the smallest cells) from the edge. Only the rows of the doubtful cells are read again
    and their keys counted exactly.
    """
    a, b = part
    sets = [tuple(DIMS), ("day", "store_id")]
    est = estimates(cube(regs, DIMS, sets=sets), [*DIMS, "over"], p).where(F.col("rows") >= least_rows)
    edge = F.col("rows") * (a / b)
    doubt = F.col("estimate") * (DOUBT * standard_error(p)) + 3
    # one row a cell; read three times below
    cells = cut(est.withColumn("sure", F.abs(F.col("estimate") - edge) > doubt), "cells")
    sure = cells.where(F.col("sure") & (F.col("estimate") > edge)).select(*DIMS)
    open_cells = cells.where(~F.col("sure")).select(*DIMS, "over", "rows")
    over = F.explode(F.array(F.lit("000"), F.lit("001")))
    rows = with_cells(log).withColumn("store_id", F.col("store_id").cast("string")).withColumn("over", over)
    rows = rows.withColumn("namespace", F.when(F.col("over") == "001", "*").otherwise(F.col("namespace")))
    keys = lookup_join(rows, open_cells.drop("rows"), [*DIMS, "over"], "left_semi").groupBy(*DIMS, "over", "key").agg(F.count(F.lit(1)).alias("n"))
    exact = keys.groupBy(*DIMS, "over").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))
    checked = exact.where(F.col("keys") * b >= F.col("rows") * a).select(*DIMS)
    return sure.unionByName(checked).select("day", F.col("store_id").cast("bigint").alias("store_id"), "namespace")
