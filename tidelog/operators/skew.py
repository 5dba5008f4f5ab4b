"""Joins against small or keyed sides that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut

#: Rows up to which a side with a few narrow columns is broadcast (about 10 MB at 100 bytes a row).
BROADCAST_ROWS = 100_000
#: Shares into which the rows of one key are dealt where they are salted.
SALTS = 16
#: A key with more than one of so many parts of all rows is heavy.
PARTS = 1000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no further than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salts: int = SALTS, spread: Column | None = None, rows: str | None = None) -> DataFrame:
    """left joined to a keyed side `right` (unique in `on`).

    The right side is broadcast only where its counted rows are at most max_rows. Beyond that, the
    left rows of each key are dealt to `salts` shares and the right side is repeated for each share,
    so that a key with a third of all rows is spread over that many tasks. how: left, inner,
    left_semi or left_anti. Null keys match nothing. `spread` is what deals the rows (default: a
    hash of the left columns, so that a repeated task deals them alike).

    The repeated side is never broadcast: what the engine takes for its size leaves out the repetition.

    With rows, a column of right that says how many rows of left its key has, right having every key of
    left, only keys with more than one of PARTS rows are dealt and repeated; these are fewer than PARTS
    by counting. right is then kept as a table.
    """
    if at_most(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    salt = "__salt"
    dealt = spread if spread is not None else F.xxhash64(*[F.col(c) for c in left.columns if c not in on] or [F.lit(0)])
    share, shares = F.pmod(dealt, F.lit(salts)).cast("int"), F.array(*[F.lit(i) for i in range(salts)])
    if rows is None:
        l = left.withColumn(salt, share)
    else:
        right = cut(right, "lookup")
        heavy = F.col(rows) > max(1, (right.agg(F.sum(rows)).first()[0] or 0) // PARTS)
        hot = right.where(heavy).select(*on, F.lit(True).alias("__hot"))
        apart = F.col("__hot").isNotNull()
        for c in on:
            apart = apart | F.col(c).isNull()
        l = left.join(F.broadcast(hot), on, "left").withColumn(salt, F.when(apart, share).otherwise(0)).drop("__hot")
        shares = F.when(heavy, shares).otherwise(F.array(F.lit(0)))
    r = right.withColumn(salt, F.explode(shares))
    return l.join(r.hint("merge"), [*on, salt], how).drop(salt)


def heavy_join(left: DataFrame, state: DataFrame, on: list[str], count_col: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of rows with their keys' state, where state says how many rows each key has.

    Keys with more than total / parts rows are at most `parts` by counting, so their rows of the
    state are broadcast, a proven bound; no other key has more than total / parts rows, so the rest
    is an ordinary shuffled join. The left side is read twice and should be a table.
    """
    edge = max(1, total // parts)
    hot = state.where(F.col(count_col) > edge)
    cold = state.where(F.col(count_col) <= edge)
    hot_rows = left.join(F.broadcast(hot), on, "inner")
    cold_rows = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, "inner")
    return hot_rows.unionByName(cold_rows)


def heavy_left_join(left: DataFrame, state: DataFrame, on: str, count_col: str, parts: int = 1000) -> DataFrame:
    """left joined to the state of its keys (unique in `on`), which also says how many rows each key had.

    The left side is read once. Keys with more than a part of all rows are at most `parts` by counting
    and are broadcast; the rows that these answer, and those of null keys, are dealt evenly and meet
    nothing in the shuffled join with the others. Columns of state but count_col are added, null where
    a key is not there.
    """
    state = state.where(F.col(on).isNotNull())
    total = state.agg(F.sum(count_col)).first()[0] or 0
    edge = max(1, total // parts)
    added = [c for c in state.columns if c not in (on, count_col)]
    hot = state.where(F.col(count_col) > edge).select(F.col(on).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in added])
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(1 << 16)).cast("int") + 1
    l = left.join(F.broadcast(hot), F.col(on) == F.col("__hot"), "left")
    apart = F.col("__hot").isNotNull() | F.col(on).isNull()
    l = l.withColumn("__deal", F.when(apart, spread).otherwise(0)).withColumn("__key", F.when(~apart, F.col(on)))
    cold = state.where(F.col(count_col) <= edge).select(F.col(on).alias("__key"), F.lit(0).alias("__deal"), *[F.col(c).alias(f"__cold_{c}") for c in added])
    joined = l.join(cold, ["__key", "__deal"], "left")
    return joined.select(*[joined[c] for c in left.columns], *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in added])
