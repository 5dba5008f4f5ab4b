"""Current state from a feed of inserts, updates and deletes, with equality-delete files.

Method: every change has a sequence, (ts, seq, segment, offset). Puts are appended to insert files.
Every change, put or delete, appends its key and sequence to delete files, for it supersedes what
came before under that key. Nothing is rewritten; a reader keeps those inserted rows for which no
delete of the same key has a later sequence, by an anti-join.

A batch is two folders and an entry in the list of batches, which is made last and at once. Readers
take the folders of entries only, so a batch that was torn by a failure is not there at all.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import files

ENTRY = ["store_id", "key"]
SEQUENCE = ["ts", "seq", "file_name", "file_offset"]
_NAME = re.compile(r"(\d+)-(\d+)-(append|fold)-([0-9a-f]{32})")


@dataclass
class EqualityDeleteTable:
    """A table of insert files and delete files under root; one folder of each kind per append."""

    spark: SparkSession
    root: str

    def _entries(self) -> list[re.Match]:
        """Entries in force: of appends under one number the last, but for what a fold has taken in."""
        found = [m for n in files.names(self.spark, f"{self.root}/batches") if (m := _NAME.fullmatch(n))]
        gone = {f for m in found if m[3] == "fold" for f in json.loads(files.read_text(self.spark, f"{self.root}/batches/{m[0]}"))["replaces"]}
        last: dict[tuple[str, str], re.Match] = {}
        for m in sorted((m for m in found if m[4] not in gone), key=lambda m: (int(m[2]), m[4])):
            last[m[1], m[3] if m[3] == "append" else m[4]] = m
        return list(last.values())

    def _publish(self, batch: int, kind: str, folder: str, replaces: list[str]) -> None:
        attempts = [int(m[2]) for n in files.names(self.spark, f"{self.root}/batches") if (m := _NAME.fullmatch(n)) and int(m[1]) == batch]
        name = f"{batch:020d}-{max(attempts, default=-1) + 1:06d}-{kind}-{folder}"
        if not files.publish(self.spark, f"{self.root}/batches/{name}", json.dumps({"replaces": replaces})):
            raise RuntimeError(f"batch {name} is there already")

    def append(self, changes: DataFrame, batch: int) -> None:
        """Append a batch of changes in any order; appending the same batch again replaces it.

        A null key is no entry and is left out. A put whose value is null or empty is a row like any
        other; the value of a delete is dropped. Two narrow writes without a shuffle, then the entry:
        before it nothing of the batch is seen, and a batch that is appended again after a fold took
        it in changes nothing, for its sequences are the same.
        """
        folder = uuid.uuid4().hex
        keyed = changes.where(F.col("key").isNotNull())
        keyed.select(*ENTRY, *SEQUENCE).write.parquet(f"{self.root}/deletes/{folder}")
        puts = keyed.where(~F.coalesce(F.col("tombstone"), F.lit(False)))
        puts.select(*ENTRY, *SEQUENCE, "value").write.parquet(f"{self.root}/inserts/{folder}")
        self._publish(batch, "append", folder, [])

    def _files(self, kind: str, folders: list[str]) -> DataFrame:
        schema = "store_id bigint, key string, ts bigint, seq bigint, file_name string, file_offset bigint" + (", value binary" if kind == "inserts" else "")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{f}" for f in folders])

    def read(self, values: bool = True) -> DataFrame:
        """One row per live key: store_id, key, the sequence of its newest put, and its value.

        Both sides are first reduced to the newest sequence of each key, before and after one shuffle
        by key: of a key's inserts only the newest can be without a later delete, and a delete
        earlier than another of the same key decides nothing. So a key with a third of all rows costs
        its partial aggregates, and the anti-join meets each key once on either side. Changes
        delivered again, or loaded twice, fall together. Null ts or seq sort first.
        """
        return self._state([m[4] for m in self._entries()], values)

    def _state(self, folders: list[str], values: bool) -> DataFrame:
        row = F.struct(*SEQUENCE, *(["value"] if values else []))
        newest = self._files("inserts", folders).groupBy(*ENTRY).agg(F.max(row).alias("r"))
        deletes = self._files("deletes", folders).groupBy(*ENTRY).agg(F.max(F.struct(*SEQUENCE)).alias("deleted"))
        at = F.struct(*[F.col(f"r.{c}").alias(c) for c in SEQUENCE])
        i, d = newest.alias("i"), deletes.alias("d")
        later = (F.col("i.store_id") == F.col("d.store_id")) & (F.col("i.key") == F.col("d.key")) & (F.col("d.deleted") > at)
        return i.join(d, later, "left_anti").select(*ENTRY, "r.*")

    def fold(self, batch: int = 0) -> None:
        """Rewrite the batches that are there now as one: live rows, and the newest delete of every key.

        Deletes are kept, for an older insert may still arrive late. The entry of the fold names the
        folders it replaces, exactly those it read, so batches that are appended meanwhile stay. It
        takes effect at once. A fold that fails leaves everything as it was and can be run again. What
        a fold replaced stays for readers that began before it and is removed by the next one.
        """
        self._clear()
        taken, folder = [m[4] for m in self._entries()], uuid.uuid4().hex
        if not taken:
            return
        self._state(taken, True).write.parquet(f"{self.root}/inserts/{folder}")
        newest = self._files("deletes", taken).groupBy(*ENTRY).agg(F.max(F.struct(*SEQUENCE)).alias("r")).select(*ENTRY, "r.*")
        newest.write.parquet(f"{self.root}/deletes/{folder}")
        self._publish(batch, "fold", folder, taken)

    def _clear(self) -> None:
        """Remove what is no longer in force. An entry goes before the fold that replaces it does, so it never comes back."""
        inforce = {m[4] for m in self._entries()}
        old = {m[4]: m[0] for n in files.names(self.spark, f"{self.root}/batches") if (m := _NAME.fullmatch(n)) and m[4] not in inforce}
        replaces = {f: set(json.loads(files.read_text(self.spark, f"{self.root}/batches/{n}"))["replaces"]) for f, n in old.items()}
        while old:
            for f in [f for f in old if not replaces[f] & old.keys()]:
                files.remove(self.spark, f"{self.root}/batches/{old.pop(f)}")
                for kind in ("inserts", "deletes"):
                    files.remove(self.spark, f"{self.root}/{kind}/{f}")
