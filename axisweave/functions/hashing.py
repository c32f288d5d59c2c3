"""String hashes (CityHash64 with a seed, 32 low bits) and the experiments built on them.

The hash is vectorised over all strings of one length, so a batch costs a few NumPy passes. Where the
very values do not matter, ``F.xxhash64`` stays in the JVM and is faster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fixed values of the published hash.
K0, K1, K2 = np.uint64(0xC3A5C85C97CB3127), np.uint64(0xB492B66FBE98F273), np.uint64(0x9AE16A3B2F90404F)
KMUL = np.uint64(0x9DDFEA08EB382D69)


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _mix(x):
    return x ^ (x >> _u(47))


def _turn(x, k: int):
    return (x >> _u(k)) | (x << _u(64 - k))


def _pair(u, v, mul=KMUL):
    return _mix((v ^ _mix((u ^ v) * mul)) * mul) * mul


def _city(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix."""
    n = b.shape[1]
    eight = lambda k: np.ascontiguousarray(b[:, k : k + 8]).view("<u8")[:, 0]
    four = lambda k: np.ascontiguousarray(b[:, k : k + 4]).view("<u4")[:, 0].astype(np.uint64)
    mul = K2 + _u(2 * n)
    if n == 0:
        return np.full(len(b), K2)
    if n < 4:
        a, m, z = (b[:, k].astype(np.uint64) for k in (0, n >> 1, n - 1))
        return _mix((a + (m << _u(8))) * K2 ^ (_u(n) + (z << _u(2))) * K0) * K2
    if n < 8:
        return _pair(_u(n) + (four(0) << _u(3)), four(n - 4), mul)
    if n <= 16:
        a, z = eight(0) + K2, eight(n - 8)
        return _pair(_turn(z, 37) * mul + a, (_turn(a, 25) + z) * mul, mul)
    if n <= 32:
        a, s, z, y = eight(0) * K1, eight(8), eight(n - 8) * mul, eight(n - 16) * K2
        return _pair(_turn(a + s, 43) + _turn(z, 30) + y, a + _turn(s + K2, 18) + z, mul)
    if n <= 64:
        return _city_64(eight, n, mul)
    return _city_long(eight, n)


def _city_64(eight, n: int, mul):
    a, b, c, d = eight(0) * K2, eight(8), eight(n - 24), eight(n - 32)
    e, f, g, h = eight(16) * K2, eight(24) * _u(9), eight(n - 8), eight(n - 16) * mul
    u = _turn(a + g, 43) + (_turn(b, 30) + c) * _u(9)
    v = ((a + g) ^ d) + f + _u(1)
    w = ((u + v) * mul).byteswap() + h
    x = _turn(e + f, 42) + c
    y = (((v + w) * mul).byteswap() + g) * mul
    z = e + f + c
    a = ((x + z) * mul + y).byteswap() + b
    return _mix((z + a) * mul + d + h) * mul + x


def _city_long(eight, n: int):
    def weak(k, a, b):
        w, x, y, z = (eight(k + 8 * j) for j in range(4))
        a = a + w
        b = _turn(b + a + z, 21)
        c = a
        a = a + x + y
        return a + z, b + _turn(a, 44) + c

    x, y = eight(n - 40), eight(n - 16) + eight(n - 56)
    z = _pair(eight(n - 48) + _u(n), eight(n - 24))
    v, w = weak(n - 64, _u(n), z), weak(n - 32, y + K1, x)
    x = x * K1 + eight(0)
    for k in range(0, (n - 1) & ~63, 64):
        x = _turn(x + y + v[0] + eight(k + 8), 37) * K1 ^ w[1]
        y = _turn(y + v[1] + eight(k + 48), 42) * K1 + v[0] + eight(k + 40)
        z = _turn(z + w[0], 33) * K1
        v = weak(k, v[1] * K1, x + w[0])
        w = weak(k + 32, z + w[1], y + eight(k + 16))
        x, z = z, x
    return _pair(_pair(v[0], w[0]) + _mix(y) * K1 + z, _pair(v[1], w[1]) + x)


def city32(keys: Sequence[bytes], seed: int) -> np.ndarray:
    """uint32 hashes of byte strings."""
    out = np.zeros(len(keys), np.uint32)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        rows = np.frombuffer(b"".join(keys[k] for k in at), np.uint8).reshape(len(at), n)
        out[at] = (_pair(_city(rows) - K2, np.full(len(at), _u(seed))) & _u(0xFFFFFFFF)).astype(np.uint32)
    return out


def hash_string(key: Column, seed: int, strip: bool = True) -> Column:
    """bigint column of 32-bit hashes; trailing NULs don't count when strip is set. Null keys give null."""

    @pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        there = s.notna().to_numpy()
        raw = [x.encode() if isinstance(x, str) else bytes(x) for x in s[there]]
        out = pd.array(np.zeros(len(s), np.int64), dtype="Int64")
        out[there] = city32([x.rstrip(b"\0") for x in raw] if strip else raw, seed).astype(np.int64)
        out[~there] = pd.NA
        return pd.Series(out)

    return run(key)


def hash_many(key: Column, seeds: Sequence[int]) -> Column:
    """Array of hashes, one a seed."""
    return F.array(*[hash_string(key, s, strip=False) for s in seeds])


def hash_bucket(key: Column, n: int, seed: int) -> Column:
    """Feature hashing: the hash modulo n."""
    return F.pmod(hash_string(key, seed, strip=False), F.lit(n)).cast("int")


def random_group(key: Column, composition: Sequence[int], seed: int) -> Column:
    """A stable split into groups 0, 1, .. whose sizes are as the weights of composition."""
    spot = hash_bucket(key, sum(composition), seed)
    out, end = F.lit(len(composition) - 1), sum(composition)
    for k in reversed(range(len(composition))):
        out = F.when(spot < end, k).otherwise(out)
        end -= composition[k]
    return out.cast("int")


def increments(df: DataFrame, key: str, segment: str, values: Sequence[str], seeds: Sequence[int], composition: tuple[int, int]) -> DataFrame:
    """(segment, seed, values): per seed and segment the sums of group 0 against those of group 1, weighed to equal sizes."""
    ratio = composition[0] / composition[1]
    e = (ratio + 1) / ratio
    parts = []
    for s in seeds:
        g = random_group(F.col(key), composition, s)
        d = df.withColumn("__g", g)
        sums = [F.sum(F.when(F.col("__g") == 0, F.col(v) * e).otherwise(-ratio * e * F.col(v))).alias(v) for v in values]
        parts.append(d.groupBy(F.col(segment).alias("segment")).agg(*sums).withColumn("seed", F.lit(s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("segment", "seed", *values)
