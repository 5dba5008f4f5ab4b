"""The record model and its namespaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGELOG = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

# The reserved key and the prefixes of keys that hold sketches.
RESERVED_KEY = "__TB_RATE_LIMIT__"
RESERVED_PREFIXES = {"bloom": "__BF_", "cms": "__CMS_", "hll": "__HLL_", "simhash": "__SH_"}


def is_reserved(key: Column) -> Column:
    """Whether a key (string or binary) is reserved; false for null."""
    k = key.cast("string")
    test = k == RESERVED_KEY
    for p in RESERVED_PREFIXES.values():
        test = test | k.startswith(p)
    return F.coalesce(test, F.lit(False))


def reserved(key: str) -> bool:
    return key == RESERVED_KEY or key.startswith(tuple(RESERVED_PREFIXES.values()))
