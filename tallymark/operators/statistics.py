"""Error statistics over replicas and summaries over merge pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.errors import finite, finite_mean
from tallymark.functions.local import null_safe_join

STREAM_STATISTICS = (
    "f0_mean_t", "f0_hat_mean_t", "variance", "stddev", "rse_observed", "bias",
    "absolute_bias", "relative_bias", "mean_relative_error", "rmse", "mae",
)


def _over(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 where the denominator is 0."""
    return F.when(
        denominator != 0, numerator / F.when(denominator != 0, denominator)
    ).otherwise(F.lit(0.0))


def error_statistics(
    df: DataFrame, by: Sequence[str], estimate: str = "estimate", truth: str = "truth"
) -> DataFrame:
    """Mean, spread, bias and error of ``estimate`` against ``truth`` over replicas.

    A single replica has variance 0.  Replicas with truth 0 add nothing to the mean relative
    error but still count in its divisor.
    """
    e, t = F.col(estimate).cast("double"), F.col(truth).cast("double")
    error = e - t
    relative = F.when(t > 0, F.abs(error) / F.when(t > 0, t)).otherwise(F.lit(0.0))
    grouped = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(t).alias("f0_mean_t"),
        F.avg(e).alias("f0_hat_mean_t"),
        F.coalesce(F.var_samp(e), F.lit(0.0)).alias("variance"),
        F.avg(relative).alias("mean_relative_error"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )
    bias = F.col("f0_hat_mean_t") - F.col("f0_mean_t")
    return (
        grouped.withColumns({"stddev": F.sqrt("variance"), "bias": bias})
        .withColumns(
            {
                "rse_observed": _over(F.col("stddev"), F.col("f0_mean_t")),
                "absolute_bias": F.abs("bias"),
                "relative_bias": _over(F.col("bias"), F.col("f0_mean_t")),
            }
        )
        .select(*by, "runs", *STREAM_STATISTICS)
    )


def pair_summary(
    pairs: DataFrame,
    by: Sequence[str] = (),
    merged: str = "estimate_merge",
    serial: str = "estimate_serial",
    delta_abs: str = "delta_merge_serial_abs",
    delta_rel: str = "delta_merge_serial_rel",
) -> DataFrame:
    """Count, means, maximum and RMSE of merge-minus-serial gaps; zeros for empty input."""
    zero = F.lit(0.0)
    gap = F.col(delta_abs)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.avg(merged), zero).alias("estimate_merge_mean"),
        F.coalesce(F.avg(serial), zero).alias("estimate_serial_mean"),
        F.coalesce(F.avg(gap), zero).alias("delta_abs_mean"),
        F.coalesce(F.max(gap), zero).alias("delta_abs_max"),
        F.coalesce(F.avg(delta_rel), zero).alias("delta_rel_mean"),
        F.coalesce(F.sqrt(F.avg(gap * gap)), zero).alias("delta_rmse"),
    )


def finite_summary(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean over finite values and number of finite values of each column."""
    aggregates = []
    for name in columns:
        aggregates.append(finite_mean(F.col(name)).alias(f"{name}_mean"))
        aggregates.append(F.count_if(finite(F.col(name))).alias(f"{name}_finite"))
    return df.groupBy(*by).agg(*aggregates)


def group_medians(
    df: DataFrame, by: Sequence[str], value: str, out: str = "median", cuts: int = 256
) -> DataFrame:
    """The exact median of ``value`` per group, nulls left out; ``by``, ``out``.

    No task holds a group: values are counted per (group, value), so a heavy group is spread;
    its distinct values are cut into ranges of about equal size at approximate quantiles;
    running counts over the ranges, at most ``cuts`` per group, tell in which range the middle
    ranks lie, and only those ranges are looked at again.  The median is that of all rows, an
    average of the two middle ones where their number is even.  Groups of nulls have no row.
    """
    by = list(by)
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*by, F.col(value).cast("double").alias("__value"))
        .groupBy(*by, "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    shares = F.array(*[F.lit((i + 1) / cuts) for i in range(cuts - 1)])
    bounds = counted.groupBy(*by).agg(F.percentile_approx("__value", shares, 10 * cuts).alias("__cuts"))
    below = F.size(F.filter("__cuts", lambda cut: cut < F.col("__value")))
    placed = null_safe_join(counted, bounds, by).select(*by, "__value", "__n", below.alias("__range"))

    group = Window.partitionBy(*by)
    so_far = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (
        placed.groupBy(*by, "__range")
        .agg(F.sum("__n").alias("__in"))
        .withColumns({"__upto": F.sum("__in").over(so_far), "__all": F.sum("__in").over(group)})
        .select(
            *by,
            "__range",
            (F.col("__upto") - F.col("__in")).alias("__before"),
            "__upto",
            F.floor((F.col("__all") - 1) / 2).alias("__low"),
            F.floor(F.col("__all") / 2).alias("__high"),
        )
    )
    holds = lambda rank: (F.col("__before") <= F.col(rank)) & (F.col(rank) < F.col("__upto"))
    middle = ranges.where(holds("__low") | holds("__high")).withColumnRenamed("__before", "__start").drop("__upto")

    within = Window.partitionBy(*by, "__range").orderBy("__value")
    looked = null_safe_join(placed, middle, [*by, "__range"]).withColumn(
        "__upto", F.col("__start") + F.sum("__n").over(within)
    )
    looked = looked.withColumn("__before", F.col("__upto") - F.col("__n"))
    at = lambda rank: F.max(F.when(holds(rank), F.col("__value")))
    return looked.groupBy(*by).agg((0.5 * at("__low") + 0.5 * at("__high")).alias(out))
