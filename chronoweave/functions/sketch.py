"""Cardinality estimates from registers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bias correction for small register counts.
ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}


def alpha(buckets: int) -> float:
    return ALPHA.get(buckets, 0.7213 / (1 + 1.079 / buckets))


def cardinality(power_sum: Column, filled: Column, buckets: int) -> Column:
    """The estimate from the sum of 2**-register over the filled registers and their number."""
    zeros = buckets - filled
    raw = alpha(buckets) * buckets * buckets / (power_sum + zeros)
    small = (raw <= 2.5 * buckets) & (zeros > 0)
    return F.round(F.when(small, buckets * F.log(F.lit(float(buckets)) / F.when(zeros > 0, zeros))).otherwise(raw)).cast("long")


def estimate_registers(registers: Column, buckets: int) -> Column:
    """The estimate of an array of registers, 0 for an empty one."""
    filled = F.size(F.filter(registers, lambda r: r > 0))
    power = F.aggregate(registers, F.lit(0.0), lambda a, r: a + F.when(r > 0, F.pow(F.lit(2.0), -r.cast("double"))).otherwise(0.0))
    return cardinality(power, filled, buckets)


def merge_registers(a: Column, b: Column) -> Column:
    """Register-wise maximum; arrays of different lengths are an error."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("register arrays differ in length"))
    return F.when(same.isNull(), F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def register_probability(k: Column, n: Column, buckets: int) -> Column:
    """P(register <= k) after n distinct elements over so many registers."""
    return F.pow(1 - 1 / (F.pow(F.lit(2.0), k.cast("double")) * buckets), n.cast("double"))


def simulated_register(u: Column, n: Column, buckets: int) -> Column:
    """A register drawn by a uniform number in (0, 1): the least k with P(register <= k) >= u."""
    # P(<= k) = (1 - 1 / (2**k * m))**n, solved for k
    k = F.ceil(-F.log2(buckets * (1 - F.pow(u, 1 / n.cast("double")))))
    return F.greatest(k, F.lit(0)).cast("int")
