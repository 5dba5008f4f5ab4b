"""Dropping rows that cannot meet a set of keys before they are shuffled to it.

The set is a relation of 64-bit words: a key's hash names one word and BITS bits in it. It is built
by one aggregation with bit_or, merges by bit_or, and never says no to a key that is in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.skew import BROADCAST_ROWS, at_most

BITS = 5
BITS_PER_KEY = 16
#: Words that are broadcast at most: 2 million, about 64 MB in a task and 8 million keys at BITS_PER_KEY.
BROADCAST_WORDS = 1 << 21


def _mask(h: Column) -> Column:
    """BITS bits of a word, from six bits of the hash each."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    m = bit(0)
    for i in range(1, BITS):
        m = m.bitwiseOR(bit(i))
    return m


def hash_of(on: list[str]) -> Column:
    return F.xxhash64(*on)


def mask_of(h: Column) -> Column:
    """The bits that a key with this hash sets in its word."""
    return _mask(F.xxhash64(h, F.lit(77)))


def word_of(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words).cast("bigint"))


def words_of(keys: DataFrame, on: list[str], words: int) -> DataFrame:
    """(word, bits) of the keys; a word that is not there has no bit."""
    h = hash_of(on)
    return keys.select(word_of(h, words).alias("word"), mask_of(h).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def may_meet(rows: DataFrame, keys: DataFrame, on: list[str], most_rows: int = BROADCAST_ROWS, most_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows whose `on` may be among the keys (unique in `on`, a table): all that are, and few that aren't.

    Up to most_rows keys are themselves broadcast and the answer is exact. Beyond, their words are, of
    which there are most_words at most: with more keys than these can tell apart more rows pass, never
    fewer. The rows are not shuffled. Null keys meet nothing.
    """
    if at_most(keys, most_rows):
        return rows.join(F.broadcast(keys.select(*on)), on, "left_semi")
    words = max(1, min(most_words, keys.count() * BITS_PER_KEY // 64))
    h = hash_of(on)
    probe = rows.withColumn("__word", word_of(h, words)).withColumn("__mask", mask_of(h))
    bits = words_of(keys, on, words).withColumnRenamed("word", "__word").withColumnRenamed("bits", "__bits")
    hit = probe.join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"))
    return hit.select(*rows.columns)
