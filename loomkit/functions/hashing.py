"""Hashes. What Spark has is native; the rest runs in Python over Arrow batches."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def sha1(c: Column) -> Column:
    return F.sha1(c)


def sha512(c: Column) -> Column:
    return F.sha2(c, 512)


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def _digest(fn, kind: T.DataType):
    @pandas_udf(kind)
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else fn(x if isinstance(x, bytes) else x.encode()))

    return run


sha3_256 = _digest(lambda b: hashlib.sha3_256(b).hexdigest(), T.StringType())
xxh32 = _digest(lambda b: xxhash.xxh32_intdigest(b), T.LongType())
xxh64 = _digest(lambda b: xxhash.xxh64_hexdigest(b), T.StringType())
xxh3 = _digest(lambda b: xxhash.xxh3_64_hexdigest(b), T.StringType())


def _murmur3(data: bytes) -> int:
    h, mask = 0, 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    for i in range(0, len(data) - len(data) % 4, 4):
        k = turn(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & mask
    if tail := data[len(data) - len(data) % 4 :]:
        h ^= turn(int.from_bytes(tail, "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


murmur3 = _digest(_murmur3, T.LongType())


def hmac_sha256(c: Column, key: bytes) -> Column:
    return _digest(lambda b: _hmac.new(key, b, "sha256").hexdigest(), T.StringType())(c)


def hash_agg(value: Column, order: Column) -> Column:
    """An aggregate: the SHA-256 of a group's values in order, joined by line feeds."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("k"), value.cast("string").alias("v")))))
    return F.sha2(F.array_join(F.transform(pairs, lambda p: p["v"]), "\n"), 256)
