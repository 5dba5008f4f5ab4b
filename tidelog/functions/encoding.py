"""Encodings of records: varints, record bytes, sizes and checksums, as column expressions; and the way back.

Encoding stays in the JVM. Decoding a block is a walk from record to record, done in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uvarint_size(x: Column) -> Column:
    """Bytes of x as an unsigned varint, seven bits a byte; x >= 0."""
    size = F.lit(10)
    for n in range(9, 0, -1):
        size = F.when(x < F.lit(1 << (7 * n)) if 7 * n < 63 else F.lit(True), n).otherwise(size)
    return size


def le8(x: Column) -> Column:
    """A BIGINT as eight bytes, least significant first."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def record_size(key: Column, value: Column, tombstone: Column, ts: Column, dictionary_index: Column | None = None) -> Column:
    """Bytes of a data record: checksum, ts, tombstone, key (or its place in the dictionary) and, if live, the value."""
    k = F.octet_length(key)
    own = uvarint_size(k) + k if dictionary_index is None else uvarint_size(dictionary_index)
    v = F.coalesce(F.octet_length(value), F.lit(0))
    return (F.lit(4) + uvarint_size(ts) + 1 + own + F.when(tombstone, 0).otherwise(uvarint_size(v) + v)).cast("bigint")


def record_crc(key: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    """CRC-32 over ts, tombstone, key and, if live, the value; a null value counts as empty."""
    live_value = F.when(tombstone, F.lit(b"")).otherwise(F.coalesce(value.cast("binary"), F.lit(b"")))
    return F.crc32(F.concat(le8(ts), F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), key.cast("binary"), live_value))


def wal_record_size(key: Column, value: Column) -> Column:
    """29 bytes of header, key and value; null key or value counts as empty."""
    return (F.lit(29) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def le4(x: Column) -> Column:
    """The low 32 bits of a BIGINT as four bytes, least significant first."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 7, -2)]))


def uvarint(x: Column) -> Column:
    """x >= 0 as an unsigned varint: seven bits a byte, lowest first, the high bit set on all bytes but the last."""
    parts = []
    for n in range(9):
        byte = F.shiftright(x, 7 * n).bitwiseAND(F.lit(127))
        more = x >= F.lit(1 << 7 * (n + 1)) if n < 8 else F.lit(False)
        code = F.lpad(F.hex(F.when(more, byte + 128).otherwise(byte)), 2, "0")
        parts.append(code if n == 0 else F.when(x >= F.lit(1 << 7 * n), code).otherwise(F.lit("")))
    return F.unhex(F.concat(*parts))


def record_bytes(key: Column, value: Column, tombstone: Column, ts: Column, dictionary_index: Column | None = None) -> Column:
    """A data record: checksum, ts, tombstone, sizes, key (or its place in the dictionary, without a size) and, if live, the value."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    long = lambda c: F.octet_length(c).cast("bigint")
    none = F.lit(b"")
    head = [le4(record_crc(key, value, tombstone, ts)), uvarint(ts), F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))]
    own = [uvarint(long(k)), k] if dictionary_index is None else [none, uvarint(dictionary_index)]
    return F.concat(*head, own[0], F.when(tombstone, none).otherwise(uvarint(long(v))), own[1], F.when(tombstone, none).otherwise(v))


def wal_record_bytes(key: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    """A log record: checksum of the value, ts, tombstone, both sizes, key and value; null key or value counts as empty."""
    k, v = F.coalesce(key.cast("binary"), F.lit(b"")), F.coalesce(value.cast("binary"), F.lit(b""))
    size = lambda c: le8(F.octet_length(c).cast("bigint"))
    return F.concat(le4(F.crc32(v)), le8(ts), F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), size(k), size(v), k, v)


def _uvarint_at(block: bytes, at: int) -> tuple[int, int]:
    """The number that begins at a place, and the place behind it."""
    end = at
    while block[end] & 0x80:
        end += 1
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(block[at : end + 1])), end + 1


def _data_records(block: bytes, numbered: bool) -> Iterator[tuple]:
    at = 0
    while at < len(block):
        began, crc, idx, key = at, int.from_bytes(block[at : at + 4], "little"), None, None
        ts, at = _uvarint_at(block, at + 4)
        tombstone, at, many, size = block[at] != 0, at + 1, 0, 0
        if not numbered:
            many, at = _uvarint_at(block, at)
        if not tombstone:
            size, at = _uvarint_at(block, at)
        if numbered:
            idx, at = _uvarint_at(block, at)
        else:
            key, at = block[at : at + many], at + many
        value, at = None if tombstone else block[at : at + size], at + size
        if at > len(block):
            raise IndexError
        sound = None if key is None else crc == zlib.crc32(ts.to_bytes(8, "little") + bytes([tombstone]) + key + (value or b""))
        yield began, crc, sound, key, idx, value, tombstone, ts


def _wal_records(block: bytes, _: bool) -> Iterator[tuple]:
    at = 0
    while at < len(block):
        number = lambda a, n: int.from_bytes(block[at + a : at + a + n], "little")  # noqa: B023, E731
        crc, ts, tombstone, many, size = number(0, 4), number(4, 8), number(12, 1) != 0, number(13, 8), number(21, 8)
        end = at + 29 + many + size
        if end > len(block):
            raise IndexError
        key, value = block[at + 29 : at + 29 + many], block[at + 29 + many : end]
        yield at, crc, crc == zlib.crc32(value), key, None, value, tombstone, ts
        at = end


_DECODED = "`offset` bigint, crc bigint, sound boolean, key binary, idx bigint, value binary, tombstone boolean, ts bigint, torn boolean"


def _decoded(walk, numbered: bool, keep: int):
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.bool_()]
    names = ["offset", "crc", "sound", "key", "idx", "value", "tombstone", "ts", "torn"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            for i, block in enumerate(b.column(keep).to_pylist()):
                try:
                    for r in walk(block or b"", numbered):
                        of.append(i)
                        rows.append((*r, False))
                except IndexError:
                    of.append(i)
                    rows.append((*[None] * 8, True))
            if rows:
                kept = [c.take(pa.array(of)) for c in b.columns[:keep]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(list(v), t) for v, t in zip(zip(*rows), types)]], [*b.schema.names[:keep], *names])

    return go


def decode(blocks: DataFrame, block: str, log: bool = False, numbered: bool = False) -> DataFrame:
    """The records of blocks of encoded ones, with the other columns of their row.

    offset is where a record begins, sound whether its checksum holds (null where the key is a number of
    a dictionary, for the checksum covers the key). A block that ends inside a record gives what comes
    before and one row with torn; an empty or null block gives none. log: records of the log.
    """
    rest = [c for c in blocks.columns if c != block]
    kinds = dict(blocks.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), _DECODED])
    return blocks.select(*rest, block).mapInArrow(_decoded(_wal_records if log else _data_records, numbered, len(rest)), schema)
