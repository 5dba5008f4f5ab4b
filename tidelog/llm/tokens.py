"""Encoding a corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction. A text is halved until the pieces are short, the pieces are encoded,
and neighbours are joined by encoding again a window around their seam. The window grows until both
its ends lie on places where the tokenizer's own split must fall whatever stands around; the tokens
outside such a window are proven to be those of the whole text. Texts longer than SEGMENT are
encoded by several tasks and joined the same way.

Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.small_files import packed_read

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, of the first window on either side of a seam, and of one task's share of a text.
LEAF, WINDOW, SEGMENT = 4096, 32, 1 << 20
# Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A letter or digit before a mark or white space always ends a piece: pieces that hold a letter (or
#: digit) go on with letters (or digits) only, and what follows doesn't look back.
SEAM = regex.compile(r"(?<=[\p{L}\p{N}])(?=[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f、。，！？])")


class Encoder:
    """encode(text) is the list of ids, special tokens' strings being ordinary text."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.flat = self._bpe.encode_ordinary
        self.leaf, self.window = max(1, leaf), max(1, window)
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self._bytes[i] = b

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text)) if text else []

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.flat(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a = b = None
        w = self.window
        while a is None or b is None:
            if a is None:
                start = max(lo, mid - w)
                found = [m.start() for m in SEAM.finditer(text, start, mid) if start < m.start() < mid]
                a = found[-1] if found else lo if start == lo else None
            if b is None:
                end = min(hi, mid + w)
                found = next((m.start() for m in SEAM.finditer(text, mid, end) if mid < m.start() < end), None)
                b = found if found is not None else hi if end == hi else None
            w *= 2
        keep = len(left) - self._tokens(reversed(left), text[a:mid])
        drop = self._tokens(right, text[mid:b])
        return left[:keep] + self.flat(text[a:b]) + right[drop:]

    def _tokens(self, ids, text: str) -> int:
        """How many of the ids make up the text."""
        rest, n = len(text.encode()), 0
        for i in ids:
            if rest <= 0:
                break
            rest -= len(self._bytes[i])
            n += 1
        if rest:
            raise AssertionError("a seam fell inside a token")
        return n

    def decode(self, ids) -> str:
        """Concatenates the tokens' bytes, halves first."""

        def tree(lo: int, hi: int) -> bytes:
            if hi - lo <= self.leaf:
                return b"".join(self._bytes[i] for i in ids[lo:hi])
            mid = (lo + hi) // 2
            return tree(lo, mid) + tree(mid, hi)

        return tree(0, len(ids)).decode()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(tokenizers, name)


def _encode(path: str):
    """Replaces the last column, a text, by its ids; the columns before it are kept."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            last = b.num_columns - 1
            each = [enc.encode(t) if t else [] for t in b.column(last).to_pylist()]
            offsets = np.zeros(len(each) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in each], out=offsets[1:])
            flat = np.fromiter((i for x in each for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:last], ids], [*b.schema.names[:last], "ids"])

    return go


def _count(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            last = b.num_columns - 1
            n = [len(enc.encode(t)) if t else 0 for t in b.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(n, pa.int64())], [*b.schema.names[:last], "tokens"])

    return go


def _cut(segment: int):
    """Texts (row, doc_id, text) in pieces of `segment` characters, each piece once more for its own ids; linear in the text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                pieces = [text[i : i + segment] for i in range(0, len(text), segment)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.string())], ["__row", "doc_id", "part", "piece"])

    return go


def _reduce(path: str):
    """One text's segments, in order, joined pairwise up the tree."""

    def go(t: pa.Table) -> pa.Table:
        enc = encoder(path)
        t = t.sort_by("part")
        nodes = list(zip(t.column("piece").to_pylist(), t.column("ids").to_pylist()))
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes) - 1, 2):
                (a, x), (b, y) = nodes[i], nodes[i + 1]
                up.append((a + b, enc.join(a + b, 0, len(a), len(a) + len(b), x, y)))
            nodes = up + ([nodes[-1]] if len(nodes) % 2 else [])
        return pa.table({"doc_id": t.column("doc_id").slice(0, 1), "ids": pa.array([nodes[0][1]], pa.list_(pa.int32()))})

    return go


def encode(docs: DataFrame, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text); no shuffle but for texts over `segment` characters.

    Repeated rows come out as often as they are there (a repeated doc_id with a text over `segment`
    is joined per row). Other columns are ignored.
    """
    path = path or vocabulary()
    rows = docs.select("doc_id", "text")
    length = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(length <= segment).mapInArrow(_encode(path), "doc_id bigint, ids array<int>")
    long = rows.where(length > segment).withColumn("__row", F.monotonically_increasing_id())
    parts = long.select("__row", F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_cut(segment), "__row bigint, doc_id bigint, part int, piece string")
    spread = parts.repartition("__row", "part").selectExpr("__row", "doc_id", "part", "piece", "piece AS again")
    coded = spread.mapInArrow(_encode(path), "__row bigint, doc_id bigint, part int, piece string, ids array<int>")
    joined = coded.groupBy("__row").applyInArrow(_reduce(path), "doc_id bigint, ids array<int>")
    return short.unionByName(joined)


def token_counts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep and tokens, the number of ids of the text; 0 for null and empty texts. No shuffle."""
    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_count(path or vocabulary()), f"{fields}, tokens bigint")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in splits small enough to keep every core busy, for the work per byte is high."""
    return packed_read(spark, f"{sf_dir}/documents.parquet", target_bytes=16 << 20)
