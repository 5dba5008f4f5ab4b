"""Has this key been seen before?

Method: filter, then verify. Earlier keys lie on disk, dealt to buckets by hash, beside an approximate
membership filter of them. The filter sends its negatives straight to the answer; only positives are
shuffled to the full keys, of which only the buckets are read that positives fall into. Each positive
that the lookup disproves is counted: the measured error of the filter.

The filter is a relation of 64-bit words, see prefilter. Keys and filter are written once; a batch
that was looked up is absorbed by adding its new keys and their words, and words merge by bit_or.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.prefilter import BITS_PER_KEY, BROADCAST_WORDS, hash_of, mask_of, may_meet, word_of, words_of
from tidelog.operators.skew import heavy_join
from tidelog.session import cut, shared_path
from tidelog.sources import files

ON = ["store_id", "key"]
#: Keys that a bucket should hold; a lookup reads whole buckets.
KEYS_PER_BUCKET = 4_000_000
LEAST_BUCKETS = 8
#: Parts of keys and filter beyond which absorb() puts them together.
MOST_PARTS = 16


@dataclass
class Seen:
    """found: incoming rows seen before; verified: rows that were looked up, with seen and in_filter; new: the keys that nothing knew."""

    found: DataFrame
    verified: DataFrame
    new: DataFrame
    incoming: int
    filter_words: int
    read_buckets: list[int]


def _keyed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.where(F.col("key").isNotNull()).select("store_id", F.col("key").cast("binary").alias("key"), *more)


class KeyIndex:
    """The keys that are known, under root: keys/ by bucket, filter/, and numbered lists of their parts.

    A list is made at once, after its parts are written; the greatest number is in force. So a batch that
    was absorbed halfway is not there, and of two writers from one list only one gets its number.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        numbers = [n for n in files.names(spark, f"{self.root}/lists") if n.isdigit()]
        self._number = int(numbers[-1]) if numbers else -1
        self.list = json.loads(files.read_text(spark, f"{self.root}/lists/{numbers[-1]}")) if numbers else None

    def _publish(self, new: dict) -> None:
        if not files.publish(self.spark, f"{self.root}/lists/{self._number + 1:020d}", json.dumps(new)):
            raise RuntimeError("the index has changed meanwhile")
        self._number, self.list = self._number + 1, new

    def _save_keys(self, keys: DataFrame, buckets: int) -> str:
        """Distinct keys by bucket; a key comes once, so no bucket is uneven whatever the rows were."""
        path = f"{self.root}/keys/{uuid.uuid4().hex}"
        placed = keys.distinct().withColumn("h", hash_of(ON)).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
        placed.repartition(min(buckets, 4096), "bucket").sortWithinPartitions("bucket", "h").write.partitionBy("bucket").parquet(path)
        return path

    def _save_filter(self, keys: DataFrame, words: int) -> str:
        path = f"{self.root}/filter/{uuid.uuid4().hex}"
        words_of(keys, ON, words).write.parquet(path)
        return path

    def _keys(self, buckets: list[int] | None = None, parts: list[str] | None = None) -> DataFrame:
        schema = "store_id bigint, key binary, h bigint, bucket int"
        rows = [self.spark.read.schema(schema).parquet(p) for p in (self.list["keys"] if parts is None else parts)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def create(self, known: DataFrame, bits_per_key: int = BITS_PER_KEY, room: float = 1.0) -> KeyIndex:
        """Write the keys (store_id, key) and their filter, which is sized for `room` times as many rows. Null keys are left out."""
        keys = _keyed(known)
        n = keys.count()
        buckets, words = max(LEAST_BUCKETS, math.ceil(n / KEYS_PER_BUCKET)), max(1, math.ceil(n * room) * bits_per_key // 64)
        path = self._save_keys(keys, buckets)
        self._publish({"keys": [path], "filter": [self._save_filter(self._keys(parts=[path]).select(*ON), words)], "buckets": buckets, "words": words, "bits_per_key": bits_per_key})
        return self

    def filter(self) -> DataFrame:
        """(word, bits) over all parts."""
        parts = self.spark.read.schema("word bigint, bits bigint").parquet(*self.list["filter"])
        return parts.groupBy("word").agg(F.bit_or("bits").alias("bits")) if len(self.list["filter"]) > 1 else parts

    def seen(self, incoming: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> Seen:
        """Which incoming rows (store_id, key string, seq) have a key that is known to their store or came earlier among them.

        A null key is never seen. Keys are compared byte for byte, so case and white space matter; the
        empty key is a key. A row is earlier if its seq is smaller; rows of one equal seq aren't earlier
        than each other.

        To the filter's words come those of incoming hashes that occur twice or more, so its negatives are
        new and alone. Up to broadcast_words it is broadcast; beyond, the batch's distinct hashes, eight
        bytes each, go to their words. Known keys are read in the buckets of positives only, and of these
        only what may meet a positive moves. A hot key falls into one row of each reduction; where verdicts
        go back to rows, keys with over a thousandth of all rows are handled apart (heavy_join).
        """
        words, h = self.list["words"], hash_of(ON)
        new = cut(_keyed(incoming, "seq").withColumn("h", h), "incoming")
        n_new = new.count()
        again = new.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        masks = lambda df: df.withColumn("word", word_of(F.col("h"), words)).withColumn("mask", mask_of(F.col("h")))
        bits = cut(self.filter().unionByName(masks(again).select("word", F.col("mask").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits")), "filter")
        hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
        if words <= broadcast_words:
            positive = masks(new).join(F.broadcast(bits), "word", "left").where(hit)
        else:
            one = masks(new.groupBy("h").agg(F.count(F.lit(1)).alias("n"))).join(bits, "word", "inner").where(hit)
            positive = heavy_join(new, one.select("h", "n"), ["h"], "n", n_new)
        positive = cut(positive.select(*ON, "seq", "h"), "positives")
        keys = cut(positive.groupBy(*ON).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), F.first("h").alias("h")), "asked")
        # at most one number a bucket
        buckets = sorted(r[0] for r in keys.select(F.pmod("h", F.lit(self.list["buckets"])).cast("int")).distinct().collect())
        on_disk = may_meet(self._keys(buckets).select(*ON), keys, ON).groupBy(*ON).agg(F.lit(True).alias("known"))
        verdict = cut(keys.join(on_disk, ON, "left").select(*ON, "first", "n", F.coalesce("known", F.lit(False)).alias("known")), "verdict")
        # keys of one row that aren't known were let through by the filter wrongly
        verified = heavy_join(positive.drop("h"), verdict, ON, "n", max(1, n_new)).select(
            *ON, "seq", (F.col("known") | (F.col("seq") > F.col("first"))).alias("seen"), (F.col("known") | (F.col("n") > 1)).alias("in_filter")
        )
        fresh = new.select(*ON).distinct().join(verdict.where("known").select(*ON), ON, "left_anti")
        return Seen(verified.where("seen").select("seq"), verified, fresh, n_new, words, buckets)

    def absorb(self, seen: Seen) -> None:
        """Add the new keys of a batch that was looked up; what is known already is neither read nor written again.

        Past MOST_PARTS parts all are put together, and a filter that has become too small for its keys is
        made anew in twice the size that they ask for.
        """
        l = self.list
        path = self._save_keys(seen.new, l["buckets"])
        keys, filters = [*l["keys"], path], [*l["filter"], self._save_filter(self._keys(parts=[path]).select(*ON), l["words"])]
        if len(keys) <= MOST_PARTS:
            self._publish(l | {"keys": keys, "filter": filters})
            return
        one = self._save_keys(self._keys(parts=keys).select(*ON), l["buckets"])
        all_keys = self._keys(parts=[one])
        n = all_keys.count()
        words = l["words"] if n * l["bits_per_key"] <= 64 * l["words"] else max(1, 2 * n * l["bits_per_key"] // 64)
        self._publish(l | {"keys": [one], "filter": [self._save_filter(all_keys.select(*ON), words)], "words": words})
        # a reader that began before may still hold the old parts; they go with the next folder that is cleared


def seen_before(known: DataFrame, incoming: DataFrame, bits_per_key: int = BITS_PER_KEY, broadcast_words: int = BROADCAST_WORDS) -> Seen:
    """An index of the known keys in the shared folder, and what it says of the incoming ones; see KeyIndex."""
    spark = known.sparkSession
    return KeyIndex(spark, shared_path(spark, "key-index")).create(known, bits_per_key).seen(incoming, broadcast_words)
