"""MurmurHash3 for token ids and content hashes, as Arrow functions; and their Python forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M32, _M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def _rotl(x: int, r: int, bits: int) -> int:
    return ((x << r) | (x >> (bits - r))) & ((1 << bits) - 1)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    h, n = seed, len(data)
    for i in range(0, n - n % 4, 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & _M32
        h = (_rotl(h ^ _rotl(k, 15, 32) * 0x1B873593 & _M32, 13, 32) * 5 + 0xE6546B64) & _M32
    if n % 4:
        k = int.from_bytes(data[n - n % 4:], "little") * 0xCC9E2D51 & _M32
        h ^= _rotl(k, 15, 32) * 0x1B873593 & _M32
    h ^= n
    for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * mult & _M32
    return h ^ h >> 16


def _finish(k: int) -> int:
    for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ k >> 33) * mult & _M64
    return k ^ k >> 33


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    c1, c2, a, b, n = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed, seed, len(data)

    def first(k: int) -> int:
        return _rotl(k * c1 & _M64, 31, 64) * c2 & _M64

    def second(k: int) -> int:
        return _rotl(k * c2 & _M64, 33, 64) * c1 & _M64

    for i in range(0, n - n % 16, 16):
        k1, k2 = int.from_bytes(data[i:i + 8], "little"), int.from_bytes(data[i + 8:i + 16], "little")
        a = ((_rotl(a ^ first(k1), 27, 64) + b) * 5 + 0x52DCE729) & _M64
        b = ((_rotl(b ^ second(k2), 31, 64) + a) * 5 + 0x38495AB5) & _M64
    tail = data[n - n % 16:]
    b ^= second(int.from_bytes(tail[8:], "little"))
    a ^= first(int.from_bytes(tail[:8], "little"))
    a, b = a ^ n, b ^ n
    a = (a + b) & _M64
    b = (b + a) & _M64
    a, b = _finish(a), _finish(b)
    a = (a + b) & _M64
    return a, (b + a) & _M64


def token_id(token: str, kind: int = 0) -> int:
    """The id of a token in a channel (0: none) of a sparse vector, below 2^31 - 1."""
    h = murmur3_32(("#" * kind + token).encode())
    return (h - (1 << 32) if h >= 1 << 31 else h) % ((1 << 31) - 1)


def content_digest(text: str | None) -> str:
    a, b = murmur3_128((text or "").encode())
    return f"{b:016x}{a:016x}"


def token_id_column(token: Column) -> Column:
    """Ids of tokens that carry their channel's prefix."""
    return F.pandas_udf(lambda s: s.map(token_id, na_action="ignore").astype("Int64"), "long")(token)


def content_hash(text: Column) -> Column:
    def digest(s: pd.Series) -> pd.Series:
        return s.map(content_digest)

    return F.pandas_udf(digest, "string")(text)
