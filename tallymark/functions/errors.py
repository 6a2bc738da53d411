"""Error, ratio and band expressions used by the evaluations and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.estimators import theoretical_rse

NAN = float("nan")
BAND_FLOOR = 1e-12

__all__ = [
    "absolute_error", "baseline_gap", "degradation_ratio", "distinct_ratio", "finite",
    "finite_mean", "is_boundary", "linear_band", "log_band", "merge_delta", "null_if_nan",
    "progress_percent", "relative_error", "repetition", "theoretical_rse",
]


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def null_if_nan(x: Column) -> Column:
    """NaN becomes NULL, so that averages skip it."""
    return F.when(~F.isnan(x), x)


def finite_mean(x: Column) -> Column:
    """Aggregate: mean over finite values, NaN when there is none."""
    return F.coalesce(F.avg(F.when(finite(x), x)), F.lit(NAN))


def absolute_error(estimate: Column, exact: Column) -> Column:
    return F.when(finite(estimate), F.abs(estimate - exact)).otherwise(F.lit(NAN))


def relative_error(estimate: Column, exact: Column) -> Column:
    usable = finite(estimate) & (exact != 0)
    divisor = F.when(exact != 0, exact)
    return F.when(usable, F.abs(estimate - exact) / divisor).otherwise(F.lit(NAN))


def merge_delta(merged: Column, serial: Column) -> tuple[Column, Column]:
    """Absolute and relative gap between a merged and a serial estimate."""
    gap = F.abs(merged - serial)
    return gap, F.when(serial != 0, gap / F.when(serial != 0, serial)).otherwise(F.lit(0.0))


def _ratio(numerator: Column, denominator: Column) -> Column:
    """IEEE division: x/0 is infinite and 0/0 is NaN."""
    safe = F.when(denominator != 0, denominator)
    at_zero = F.when(F.isnan(numerator) | (numerator == 0), F.lit(NAN)).otherwise(
        F.lit(float("inf")) * F.signum(numerator)
    )
    return F.when(denominator == 0, at_zero).otherwise(numerator / safe)


def degradation_ratio(merge_rel: Column, serial_rel: Column) -> Column:
    return _ratio(merge_rel, serial_rel)


def baseline_gap(merged: Column, baseline: Column, exact: Column) -> Column:
    return _ratio(F.abs(merged - baseline), exact)


def distinct_ratio(processed: Column, distinct: Column) -> Column:
    """Elements seen per distinct element."""
    return processed / F.when(distinct != 0, distinct)


def repetition(sample_size: Column, distinct: Column) -> Column:
    """Whole number of occurrences per distinct element."""
    return F.floor(sample_size / F.when(distinct != 0, distinct)).cast("int")


def progress_percent(processed: Column, sample_size: Column) -> Column:
    return F.lit(100.0) * processed / F.when(sample_size != 0, sample_size)


def is_boundary(processed: Column, rho: Column) -> Column:
    return processed % F.when(rho != 0, rho) == 0


def log_band(mean: Column, std: Column) -> tuple[Column, Column]:
    """Band of one standard deviation under a log-normal spread."""
    centre = F.greatest(mean, F.lit(BAND_FLOOR))
    cv = std / centre
    spread = F.sqrt(F.log1p(cv * cv))
    return centre * F.exp(-spread), centre * F.exp(spread)


def linear_band(mean: Column, std: Column) -> tuple[Column, Column]:
    return F.greatest(mean - std, F.lit(BAND_FLOOR)), mean + std
