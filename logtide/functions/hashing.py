"""Routing hashes, checksums and their text forms as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A routing hash is any function from a key column to a column of values from 0 to 2**63.
HashFunction = Callable[[Column], Column]


def route_hash(key: Column) -> Column:
    """Magnitude of the low 64 bits of MD5, read as a signed number; decimal(20,0).

    The one value of magnitude 2**63 stays positive, so shard numbers are never negative.
    """
    unsigned = F.conv(F.substring(F.md5(key), 17, 16), 16, 10).cast("decimal(20,0)")
    half, full = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (63, 64))
    return F.when(unsigned >= half, full - unsigned).otherwise(unsigned).cast("decimal(20,0)")


def shard_of(key: Column, shards: int, hash_function: HashFunction = route_hash) -> Column:
    return (hash_function(key) % shards).cast("int")


def hash_hex(key: Column, hash_function: HashFunction = route_hash) -> Column:
    """The hash as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.conv(hash_function(key).cast("string"), 10, 16)), 16, "0")


def hash_prefix(key: Column, depth: int, hash_function: HashFunction = route_hash) -> Column:
    """The tree node of a key at ``depth``: the first depth + 1 digits of the hash."""
    return F.substring(hash_hex(key, hash_function), 1, depth + 1)


def record_crc(key: Column, value: Column) -> Column:
    """CRC-32 over key and value bytes; a missing value counts as no bytes."""
    return F.crc32(F.concat(key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))))


def big_endian_long(data: Column, index: Column | int) -> Column:
    """The index-th signed 64-bit big-endian number of a binary column; negative numbers mark tombstones."""
    at = (index if isinstance(index, Column) else F.lit(index)) * 8 + 1
    return F.conv(F.hex(F.substring(data, at, F.lit(8))), 16, -10).cast("long")


def align8(offset: Column) -> Column:
    """The next multiple of eight at or after ``offset``."""
    return (F.ceil(offset / 8) * 8).cast("long")


def little_endian_long(data: Column, index: Column | int) -> Column:
    """The index-th signed 64-bit little-endian number of a binary column."""
    at = (index if isinstance(index, Column) else F.lit(index)) * 8
    turned = F.concat(*[F.substring(data, at + i, F.lit(1)) for i in range(8, 0, -1)])
    return F.conv(F.hex(turned), 16, -10).cast("long")


def tombstone_offset(offset: Column, deleted: Column) -> Column:
    """An index entry: the offset, negative for a tombstone."""
    return F.when(deleted, -offset).otherwise(offset)


def guard(number: Column) -> Column:
    """The bitwise complement, which a guard keeps of its partner."""
    return F.bitwise_not(number)


def random_bytes(smallest: int, largest: int, seed: int) -> Column:
    """Binary test data of ``smallest`` to ``largest`` bytes, the same for a seed and a spread of rows."""
    hexed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(-(-largest // 16))), lambda i: F.md5(F.concat(F.rand(seed).cast("string"), i.cast("string")))), "")
    length = (F.rand(seed + 1) * (largest - smallest + 1)).cast("int") + smallest
    return F.substring(F.unhex(hexed), F.lit(1), length)


def now_nanos() -> Column:
    """The time of the query in nanoseconds, in steps of a microsecond."""
    return F.unix_micros(F.current_timestamp()) * 1000
