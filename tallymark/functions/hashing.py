"""The 64-bit hash functions and their registry.

Every hash maps a BIGINT column to a BIGINT that carries the unsigned 64-bit result.
``xxhash64`` uses Spark's built-in; ``splitmix64`` and ``murmurhash3`` are column expressions
over wrapping arithmetic and stay in generated JVM code; ``siphash24`` is an Arrow-batched
function.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import wrap64 as w

# Fixed values of the published hash functions.
SPLITMIX_GAMMA = 0x9E3779B97F4A7C15
SPLITMIX_MUL_1 = 0xBF58476D1CE4E5B9
SPLITMIX_MUL_2 = 0x94D049BB133111EB
MURMUR_C1 = 0x87C37B91114253D5
MURMUR_C2 = 0x4CF5AD432745937F
MURMUR_ADD = 0x52DCE729
MURMUR_FMIX_1 = 0xFF51AFD7ED558CCD
MURMUR_FMIX_2 = 0xC4CEB9FE1A85EC53
SIP_KEY_0 = 0x0706050403020100
SIP_KEY_1 = 0x0F0E0D0C0B0A0908
SIP_INIT = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
XX_PRIME_1 = 11400714785074694791
XX_PRIME_2 = 14029467366897019727
XX_PRIME_3 = 1609587929392839161
XX_PRIME_4 = 9650029242287828579
XX_PRIME_5 = 2870177450012600261

# A hash attaches column ``out`` to a frame, computed from BIGINT column ``value``.
HashBuilder = Callable[[DataFrame, str, int, str], DataFrame]


@dataclass(frozen=True)
class HashChoice:
    """A hash function together with the seed it was asked for."""

    name: str
    seed: int

    def attach(self, df: DataFrame, value: str, out: str) -> DataFrame:
        return _REGISTRY[self.name](df, value, self.seed, out)


def _splitmix64(df: DataFrame, value: str, seed: int, out: str) -> DataFrame:
    chain = w.Chain(df, out)
    z = chain.let(w.add_const(f"`{value}`", SPLITMIX_GAMMA))
    z = chain.let(w.xor_shift(z, 30))
    z = chain.let(w.mul_const(z, SPLITMIX_MUL_1))
    z = chain.let(w.xor_shift(z, 27))
    z = chain.let(w.mul_const(z, SPLITMIX_MUL_2))
    return chain.finish(out, w.xor_shift(z, 31))


def _unshift(value: int, bits: int) -> int:
    """Invert ``v ^= v >> bits`` on 64-bit integers."""
    result = value
    for _ in range(64 // bits + 1):
        result = value ^ (result >> bits)
    return result


def xx_seed_preimage(seed: int) -> int:
    """The long whose seed-42 ``xxhash64`` equals ``seed``.

    Spark's ``xxhash64(a, b)`` hashes ``a`` with seed 42 and uses the result as the seed
    for ``b``.  Every step of the 8-byte hash is a bijection, so the literal ``a`` that
    produces any wanted seed can be computed backwards.
    """
    inverse = lambda prime: pow(prime, -1, 1 << 64)
    rotate = lambda v, n: ((v << n) | (v >> (64 - n))) & w.MASK64
    h = _unshift(seed & w.MASK64, 32)
    h = _unshift(h * inverse(XX_PRIME_3) & w.MASK64, 29)
    h = _unshift(h * inverse(XX_PRIME_2) & w.MASK64, 33)
    h = (h - XX_PRIME_4) * inverse(XX_PRIME_1) & w.MASK64
    h = rotate(h, 64 - 27) ^ ((42 + XX_PRIME_5 + 8) & w.MASK64)
    h = rotate(h * inverse(XX_PRIME_1) & w.MASK64, 64 - 31)
    return h * inverse(XX_PRIME_2) & w.MASK64


def _xxhash64(df: DataFrame, value: str, seed: int, out: str) -> DataFrame:
    column = F.col(value).cast("bigint")
    if seed == 42:
        return df.withColumn(out, F.xxhash64(column))
    return df.withColumn(out, F.xxhash64(w.long_lit(xx_seed_preimage(seed)), column))


def _fmix64(chain: w.Chain, h: str) -> str:
    h = chain.let(w.xor_shift(h, 33))
    h = chain.let(w.mul_const(h, MURMUR_FMIX_1))
    h = chain.let(w.xor_shift(h, 33))
    h = chain.let(w.mul_const(h, MURMUR_FMIX_2))
    return chain.let(w.xor_shift(h, 33))


def _murmurhash3(df: DataFrame, value: str, seed: int, out: str) -> DataFrame:
    """128-bit x64 shape fed with one 8-byte word through the block step; returns h1."""
    seed &= 0xFFFFFFFF
    chain = w.Chain(df, out)
    k = chain.let(w.mul_const(f"`{value}`", MURMUR_C1))
    k = chain.let(w.rotate_left(k, 31))
    k = chain.let(w.mul_const(k, MURMUR_C2))
    h1 = chain.let(w.xor(k, w.literal(seed)))
    h1 = chain.let(w.rotate_left(h1, 27))
    h1 = chain.let(w.add_const(h1, seed))
    h1 = chain.let(w.mul_const(h1, 5))
    h1 = chain.let(w.add_const(h1, MURMUR_ADD))
    h2 = seed ^ 8
    h1 = chain.let(w.xor(h1, w.literal(8)))
    h1 = chain.let(w.add_const(h1, h2))
    h2 = chain.let(w.add_const(h1, h2))
    h1 = _fmix64(chain, h1)
    h2 = _fmix64(chain, h2)
    return chain.finish(out, w.add(h1, h2))


def _siphash24(df: DataFrame, value: str, seed: int, out: str) -> DataFrame:
    """SipHash-2-4 of the 8 value bytes under the fixed 16-byte key 00 01 .. 0f.

    The one hash that runs as an Arrow-batched function on numpy's wrapping integers: as a
    column expression its eight rounds make a generated method of some 11,000 bytes of
    bytecode, beyond the 8,000 the JVM still compiles, and ran thirty times slower.
    """
    keys = (SIP_KEY_0, SIP_KEY_1, SIP_KEY_0, SIP_KEY_1)
    start = [init ^ key for init, key in zip(SIP_INIT, keys)]

    def digest(series: pd.Series) -> pd.Series:
        words = series.to_numpy(dtype=np.int64).view(np.uint64)
        a, b, c, d = (np.full(len(words), v, dtype=np.uint64) for v in start)

        def turn(x: np.ndarray, bits: int) -> np.ndarray:
            return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

        def rounds(count: int) -> None:
            nonlocal a, b, c, d
            for _ in range(count):
                a, c = a + b, c + d
                b, d = turn(b, 13) ^ a, turn(d, 16) ^ c
                a, c = turn(a, 32) + d, c + b
                b, d = turn(b, 17) ^ c, turn(d, 21) ^ a
                c = turn(c, 32)

        for block in (words, np.uint64(8 << 56)):
            d = d ^ block
            rounds(2)
            a = a ^ block
        c = c ^ np.uint64(0xFF)
        rounds(4)
        return pd.Series((a ^ b ^ c ^ d).view(np.int64))

    column = F.col(value).cast("bigint")
    hashed = F.pandas_udf(digest, "bigint")(F.coalesce(column, F.lit(0).cast("bigint")))
    return df.withColumn(out, F.when(column.isNotNull(), hashed))


_REGISTRY: dict[str, HashBuilder] = {
    "splitmix64": _splitmix64,
    "xxhash64": _xxhash64,
    "murmurhash3": _murmurhash3,
    "siphash24": _siphash24,
}

# Hashes that are one built-in function call.
BUILT_IN = frozenset({"xxhash64"})

_ALIASES: dict[str, str] = {
    "splitmix": "splitmix64",
    "xxhash": "xxhash64",
    "murmur3": "murmurhash3",
    "murmur": "murmurhash3",
    "siphash": "siphash24",
}


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def supported_hashes() -> list[str]:
    return list(_REGISTRY)


def register_hash(name: str, builder: HashBuilder, aliases: tuple[str, ...] = ()) -> None:
    """Add a hash function.  ``builder(df, value, seed, out)`` attaches column ``out``."""
    if not callable(builder):
        raise ValueError("a hash is registered with a callable (df, value, seed, out)")
    key = _plain(name)
    if not key:
        raise ValueError("a hash needs a name")
    if key in _ALIASES:
        raise ValueError(f"'{name}' is already an alias of {_ALIASES[key]}")
    _REGISTRY[key] = builder
    for alias in aliases:
        _ALIASES[_plain(alias)] = key


def resolve_hash(name: str | None = None, seed: int | None = None) -> HashChoice:
    """Look a hash up by name or alias, ignoring case and punctuation.

    No name and no seed, or an empty name, mean ``splitmix64``.  A seed without a name and
    a name without a seed are errors, as is an unknown name.
    """
    if name is None:
        if seed is not None:
            raise ValueError("a hash seed was given without a hash name")
        return HashChoice("splitmix64", 0)
    plain = _plain(name)
    if not plain:
        return HashChoice("splitmix64", seed or 0)
    if seed is None:
        raise ValueError(f"hash '{name}' needs a seed")
    if not 0 <= seed < 1 << 32:
        raise ValueError(f"hash seed {seed} does not fit 32 bits")
    plain = _ALIASES.get(plain, plain)
    if plain not in _REGISTRY:
        raise ValueError(f"unknown hash '{name}'; known: {', '.join(_REGISTRY)}")
    return HashChoice(plain, seed)


def with_hash(
    df: DataFrame, value: str, name: str | None = None, seed: int | None = None, out: str = "h"
) -> DataFrame:
    """Attach the 64-bit hash of BIGINT column ``value`` as column ``out``."""
    return resolve_hash(name, seed).attach(df, value, out)


def hash32(h: Column) -> Column:
    """The upper 32 bits of a 64-bit hash, as a non-negative BIGINT."""
    return F.shiftrightunsigned(h, 32)
