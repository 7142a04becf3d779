"""Pairing, splitting and hashing of ids, as column expressions where Spark has the arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def pair(x: Column, y: Column) -> Column:
    """Szudzik's elegant pairing of two non-negative numbers; null where it can't be undone."""
    z = F.when(x >= y, x * x + x + y).otherwise(y * y + x)
    return F.when((F.greatest(x, y) < (1 << 26)) & (x >= 0) & (y >= 0), z)


def unpair(z: Column) -> tuple[Column, Column]:
    root = F.floor(F.sqrt(z.cast("double")))
    rest = z - root * root
    return F.when(rest >= root, root).otherwise(rest), F.when(rest >= root, rest - root).otherwise(root)


def split_id(query_id: Column, shards: int) -> tuple[Column, Column]:
    """Local id and remainder. Shards are a power of two below 256, else the split can't be undone."""
    if not 0 < shards < 256 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two below 256")
    return F.shiftright(query_id, shards.bit_length() - 1), F.pmod(query_id, F.lit(shards))


def join_id(local: Column, remainder: Column, shards: int) -> Column:
    if not 0 < shards < 256 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two below 256")
    return F.shiftleft(local, shards.bit_length() - 1) + remainder


def quantize(relevance: Column) -> Column:
    """A relevance as a number from 0 to 255: hundredths, rounded half up."""
    return F.least(F.greatest(F.round(relevance * 100), F.lit(0)), F.lit(255)).cast("smallint")


def jump(key: int, buckets: int) -> int:
    """Jump consistent hash (Lamping and Veach)."""
    if buckets <= 0:
        raise ValueError("there must be a bucket")
    bucket, after = -1, 0
    while after < buckets:
        bucket = after
        key = (key * 2862933555777941757 + 1) & _MASK
        after = int((bucket + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return bucket


def jump_bucket(key: Column, buckets: int) -> Column:
    """The bucket of a 64-bit key. The arithmetic wraps, which Spark's doesn't under ANSI rules, so
    this is an Arrow UDF; shards are otherwise chosen by ``shard_of``."""
    if buckets <= 0:
        raise ValueError("there must be a bucket")

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jumps(keys.to_numpy(np.int64).view(np.uint64), buckets))

    return run(key)


def jumps(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of many keys: all jump together, and those that are past the end stop."""
    out, left, keys = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys.copy()
    bucket = np.zeros(len(keys), np.int64)
    while len(left):
        out[left] = bucket[left]
        keys[left] = keys[left] * np.uint64(2862933555777941757) + np.uint64(1)
        bucket[left] = ((bucket[left] + 1) * (float(1 << 31) / ((keys[left] >> np.uint64(33)) + np.uint64(1)).astype(float))).astype(np.int64)
        left = left[bucket[left] < buckets]
    return out.astype(np.int32)


# Multiplier and initial state of the published SeaHash.
_SEA = 0x6EED0E9DA4D94A4F
_SEA_STATE = (0x16F11FE89B0D677C, 0xB480A793D8E6C86C, 0x6FE2E5AAF078EBC9, 0x14F994A4C5259381)


def _diffuse(x: int) -> int:
    x = x * _SEA & _MASK
    return (x ^ (x >> 32) >> (x >> 60)) * _SEA & _MASK


def sea_hash(data: bytes) -> int:
    """The published SeaHash of some bytes: four lanes take eight bytes in turn."""
    lanes = list(_SEA_STATE)
    for k in range(0, len(data), 8):
        lanes = [*lanes[1:], _diffuse(lanes[0] ^ int.from_bytes(data[k : k + 8], "little"))]
    return _diffuse(lanes[0] ^ lanes[1] ^ lanes[2] ^ lanes[3] ^ len(data))


def text_bucket(key: Column, buckets: int) -> Column:
    """The jump-hash bucket of a text by its SeaHash, as some existing layouts have it; null for null."""
    if buckets <= 0:
        raise ValueError("there must be a bucket")

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        coded, distinct = pd.factorize(keys)
        found = jumps(np.array([sea_hash(k.encode()) for k in distinct], np.uint64), buckets)
        return pd.Series(np.append(found, 0)[coded]).where(coded >= 0).astype("Int32")

    return run(key)


def shard_of(ngram: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(ngram), F.lit(shards)).cast("int")
