"""SimHash fingerprints of texts, their distances and near neighbours."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import fnv1a64, fnv_array, seeded_state
from tidelog.session import cut

# The seed, and what a word is (ASCII letters and digits).
SEED = 14022003
WORD = re.compile(r"\b[^\W\d][\w'-]*\b", re.ASCII)
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(hashes: np.ndarray, weights: np.ndarray) -> int:
    """Bit i is set iff the weights of the features that have it outweigh the others; signed."""
    ones = (hashes[:, None] >> _BITS) & np.uint64(1)
    v = (np.where(ones == 1, 1, -1) * weights[:, None]).sum(0)
    return int(np.bitwise_or.reduce(np.where(v > 0, np.uint64(1) << _BITS, np.uint64(0))).view(np.int64))


def words(text: str) -> Counter:
    return Counter(w.lower() for w in WORD.findall(text))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = seeded_state(SEED)
    for b in batches:
        each = [words(t) if t else Counter() for t in b.column(1).to_pylist()]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in each for w in c))}
        hashes = fnv_array(pa.array(list(vocabulary), pa.string()), state)
        prints = [fingerprint(hashes[[vocabulary[w] for w in c]], np.fromiter(c.values(), dtype=np.int64)) if c else None for c in each]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of whole texts, words weighted by how often they come; null where there is no word. No shuffle."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).mapInArrow(_texts, "id bigint, fingerprint bigint")


def weighted(features: DataFrame) -> DataFrame:
    """(id, fingerprint) from features (id, hash bigint, weight bigint): 64 sums a group in one aggregation."""
    sums = [F.sum(F.when(F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{i}") for i in range(64)]
    bits = [F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return features.groupBy("id").agg(*sums).select("id", out.cast("bigint").alias("fingerprint"))


def of_bytes(df: DataFrame, id_col: str, feature: str) -> DataFrame:
    """(id, fingerprint) over byte features of weight 1 each, repeated ones counting as often as they come; null features count not.

    Features are counted before they are hashed, so a hot feature is hashed once an id.
    """
    counted = df.where(F.col(feature).isNotNull()).groupBy(F.col(id_col).alias("id"), F.col(feature).cast("binary").alias("f")).agg(F.count(F.lit(1)).alias("weight"))
    return weighted(counted.select("id", fnv1a64(F.col("f"), SEED).alias("hash"), "weight"))


def hamming(a, b):
    """Bits in which two fingerprints differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))


def classes(prints: DataFrame) -> DataFrame:
    """(fingerprint, class_id, members): exact copies as one class, named by its least id."""
    return prints.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))


#: The 64 bits in six blocks; two fingerprints within three bits agree in at least three of them.
_CUTS = [0, 11, 22, 33, 44, 54, 64]


def near_pairs(cls: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance) of all classes within `distance` <= 3 bits, a < b; complete.

    Each fingerprint goes to the 20 tables of three of six blocks, so a bucket's key has 31 to 33
    bits; pairs are compared only within buckets and reported by the first bucket they share. Copies
    are one class, so a text copied a million times is one row here.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be in 0..3")
    masks = [(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(_CUTS, _CUTS[1:])]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    triples = [signed(sum(t)) for t in combinations(masks, 3)]
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(triples)])
    put = cut(cls.select("fingerprint", "class_id", F.explode(table).alias("x")).select("fingerprint", "class_id", "x.t", "x.k"), "simhash-tables")
    l = put.select("t", "k", F.col("class_id").alias("a"), F.col("fingerprint").alias("fa"))
    r = put.select("t", "k", F.col("class_id").alias("b"), F.col("fingerprint").alias("fb"))
    diff = F.col("fa").bitwiseXOR(F.col("fb"))
    shared = F.lit(None).cast("int")
    for i in reversed(range(len(triples))):
        shared = F.when(diff.bitwiseAND(F.lit(triples[i])) == 0, i).otherwise(shared)
    pairs = l.join(r, ["t", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(diff) <= distance))
    return pairs.where(F.col("t") == shared).select("a", "b", F.bit_count(diff).alias("distance"))
