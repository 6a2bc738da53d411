"""Closed-form estimates as column expressions.

Registers enter as exact integer sums: ``occupied`` registers, the sum of ranks, and the
sum of ``2**-rho`` held as two scaled integers.  Integer sums do not depend on the order of
aggregation, so an estimate is reproducible under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.bias import MIN_K, THRESHOLDS, alpha
from tallymark.functions.bits import SPARSE_PRECISION, trailing_ones

# Fixed values of the published estimators.
PC_PHI = 0.77351
LOGLOG_ALPHA = 0.39701
HLL_RSE = 1.04
LOGLOG_RSE = 1.30

INV_SCALE_HIGH = 31
INV_SCALE_LOW = 62


def _k(k: Column | int) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def registers_of(k: Column | int) -> Column:
    return F.pow(F.lit(2.0), _k(k))


def alpha_of(k: Column | int) -> Column:
    m = registers_of(k)
    chain = F.when(_k(k) == 4, alpha(16)).when(_k(k) == 5, alpha(32)).when(_k(k) == 6, alpha(64))
    return chain.otherwise(F.lit(0.7213) / (F.lit(1.0) + F.lit(1.079) / m))


def inverse_sum(high: Column, low: Column, occupied: Column, k: Column | int) -> Column:
    """Sum of ``2**-rho`` over all registers; untouched ones count 1 each."""
    scaled = high / F.lit(float(1 << INV_SCALE_HIGH)) + low / F.lit(float(1 << INV_SCALE_LOW))
    return scaled + (registers_of(k) - occupied)


def truncate(estimate: Column) -> Column:
    return F.floor(estimate).cast("bigint")


def probabilistic_counting(bitmap: Column, length: Column | int) -> Column:
    ones = trailing_ones(bitmap, length)
    return truncate(F.pow(F.lit(2.0), ones.cast("double")) / F.lit(PC_PHI))


def loglog(rho_sum: Column, k: Column | int) -> Column:
    m = registers_of(k)
    return truncate(F.lit(LOGLOG_ALPHA) * m * F.pow(F.lit(2.0), rho_sum / m))


def raw_estimate(inverse: Column, k: Column | int) -> Column:
    m = registers_of(k)
    return alpha_of(k) * m * m / inverse


def linear_counting(buckets: Column, zeros: Column) -> Column:
    """``buckets * ln(buckets / zeros)``; ``buckets`` itself when no bucket is empty."""
    safe = F.when(zeros > 0, zeros).otherwise(F.lit(1.0))
    return F.when(zeros > 0, buckets * F.log(buckets / safe)).otherwise(buckets)


def hyperloglog(inverse: Column, occupied: Column, k: Column | int) -> Column:
    """Estimate with the small-range and the 32-bit large-range correction."""
    m, raw = registers_of(k), raw_estimate(inverse, k)
    zeros = m - occupied
    span = F.lit(float(1 << 32))
    # Beyond 2**32 the logarithm has no value; the estimate then stays uncorrected.
    share = F.when(raw < span, F.lit(1.0) - raw / span).otherwise(F.lit(1.0))
    large = F.when(raw < span, -span * F.log(share)).otherwise(raw)
    return truncate(
        F.when((raw <= F.lit(2.5) * m) & (zeros > 0), linear_counting(m, zeros))
        .when(raw <= span / F.lit(30.0), raw)
        .otherwise(large)
    )


def threshold_of(k: Column | int) -> Column:
    table = F.array(*[F.lit(float(t)) for t in THRESHOLDS])
    return F.element_at(table, _k(k).cast("int") - (MIN_K - 1))


def hyperloglog_pp(corrected: Column, occupied: Column, k: Column | int) -> Column:
    """Final choice between linear counting and the bias-corrected raw estimate."""
    m = registers_of(k)
    zeros = m - occupied
    linear = F.when(zeros > 0, linear_counting(m, zeros)).otherwise(corrected)
    return truncate(F.when(linear <= threshold_of(k), linear).otherwise(corrected))


def sparse_estimate(n_codes: Column) -> Column:
    """Linear counting over the distinct codes at the sparse precision."""
    buckets = F.lit(float(1 << SPARSE_PRECISION))
    return truncate(linear_counting(buckets, buckets - n_codes))


def theoretical_rse(algo: Column, k: Column) -> Column:
    """1.04/sqrt(m) for HyperLogLog(++), 1.30/sqrt(m) for LogLog, NaN where none is known."""
    root = F.sqrt(registers_of(k))
    return (
        F.when(algo.isin("hll", "hllpp"), F.lit(HLL_RSE) / root)
        .when(algo == "ll", F.lit(LOGLOG_RSE) / root)
        .otherwise(F.lit(float("nan")))
    )


