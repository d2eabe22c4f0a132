"""Hash and partition-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 2_147_483_647


def java_hash(x: Column) -> Column:
    """The signed 32-bit hash of a 64-bit integer: its halves xor-ed."""
    low = x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 2**31, low - 2**32).otherwise(low)


def home(x: Column, parts: int) -> Column:
    """The partition of a vertex by its hash alone."""
    return (F.abs(java_hash(x)) % parts).cast("int")


def spread(x: Column, seed: int = 11) -> Column:
    """A multiplicative scatter of an integer into [0, 2**31 - 1), without overflow. It stands in for
    64-bit hashes where results are compared with SQL."""
    return (F.pmod(x, F.lit(_PRIME)) * 48_271 + seed) % _PRIME


def spread_pair(a: Column, b: Column, seed: int = 11) -> Column:
    return (spread(a, seed) * 31 + spread(b, seed)) % _PRIME


def bucket_of(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def rank_of(h: Column, buckets: int, top_bit: int = 63) -> Column:
    """Trailing zeros + 1 of what is left of a hash without its bucket bits. The top bit is set first,
    so there is a one to find."""
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two, 2 at least")
    mark = -(2**63) if top_bit == 63 else 1 << top_bit
    x = F.shiftrightunsigned(h.bitwiseOR(F.lit(mark).cast("long")), buckets.bit_length() - 1)
    return (F.bit_count(x.bitwiseAND(-x) - 1) + 1).cast("int")
