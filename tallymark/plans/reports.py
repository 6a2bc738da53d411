"""Report tables over evaluation results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.errors import (
    baseline_gap,
    degradation_ratio,
    distinct_ratio,
    is_boundary,
    log_band,
    linear_band,
    null_if_nan,
    progress_percent,
    repetition,
)
from tallymark.functions.labels import (
    HASH_ORDER,
    PAIR_GROUP_ORDER,
    PAIRING_ORDER,
    SCENARIO_LABELS,
    STRATEGY_ORDER,
    order_of,
    param_value,
    scenario_label,
)
from tallymark.functions.local import local_frame, null_safe_join
from tallymark.operators.statistics import group_medians

# Standard parameters per algorithm, report targets.
STANDARD_PARAMS = {
    "HyperLogLog++": "k=14",
    "HyperLogLog": "k=14,L=32",
    "LogLog": "k=14,L=32",
    "Probabilistic Counting": "L=31",
}
F0_TARGETS = (1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000)
SCENARIO_ORDER = list(SCENARIO_LABELS)

SWEEP_KEYS = ("algorithm_label", "param_name", "param_value")


# --- selection ------------------------------------------------------------------------


def select_stream_results(
    results: DataFrame,
    sample_size: int | None = None,
    seed: int | None = None,
    rhos: Sequence[int] | None = None,
) -> DataFrame:
    """Prefix results of one experiment with positive truth and estimate, plus ``rho``.

    Only plain comparisons on stored columns are used, so they reach the scan.
    """
    rows = results.where(F.col("mode") == "streaming")
    if sample_size is not None:
        rows = rows.where(F.col("sample_size") == sample_size)
    if seed is not None:
        rows = rows.where(F.col("seed") == seed)
    rows = rows.where((F.col("f0_mean_t") > 0) & (F.col("f0_hat_mean_t") > 0))
    rows = rows.withColumn("rho", repetition(F.col("sample_size"), F.col("f0")))
    return rows.where(F.col("rho").isin(*rhos)) if rhos else rows


def standard_params_only(
    results: DataFrame, params: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows whose (algorithm, params) is one of the standard choices."""
    chosen = local_frame(
        results.sparkSession,
        list((params or STANDARD_PARAMS).items()),
        "algorithm string, params string",
    )
    return results.join(F.broadcast(chosen), ["algorithm", "params"], "left_semi")


def with_sweep_keys(results: DataFrame) -> DataFrame:
    """Attach ``algorithm_label, param_name, param_value``; L for bitmaps, k otherwise."""
    k, length = param_value(F.col("params"), "k"), param_value(F.col("params"), "L")
    return results.withColumns(
        {
            "algorithm_label": F.col("algorithm"),
            "param_name": F.when(k.isNotNull(), "k").otherwise("L"),
            "param_value": F.coalesce(k, length),
        }
    )


# --- prefix reports -------------------------------------------------------------------


def endpoint_summary(results: DataFrame) -> DataFrame:
    """Mean relative error at the last checkpoint per algorithm, parameter and f0."""
    last = F.max_by(F.struct("rho", "mean_relative_error"), "number_of_elements_processed")
    ends = with_sweep_keys(results).groupBy(*SWEEP_KEYS, "f0").agg(last.alias("e"))
    return ends.select(
        *SWEEP_KEYS,
        F.col("e.rho").alias("rho"),
        F.col("e.mean_relative_error").alias("endpoint_mre"),
    ).orderBy("algorithm_label", "rho", "param_value")


def best_params(endpoints: DataFrame) -> DataFrame:
    """The parameter with the smallest endpoint error per algorithm and rho.

    Equal errors go to the smaller parameter.
    """
    best = F.min(F.struct("endpoint_mre", "param_value", "param_name")).alias("b")
    return (
        endpoints.groupBy("algorithm_label", "rho")
        .agg(best)
        .select(
            "algorithm_label",
            F.col("b.param_name").alias("param_name"),
            F.col("b.param_value").alias("param_value"),
            "rho",
            F.col("b.endpoint_mre").alias("endpoint_mre"),
        )
        .orderBy("algorithm_label", "rho", "param_value")
    )


def interpolated_points(
    results: DataFrame,
    targets: Sequence[int] = F0_TARGETS,
    by: Sequence[str] = (*SWEEP_KEYS, "rho"),
) -> DataFrame:
    """Elements, estimate and spread at chosen truths, between the checkpoints around them.

    Checkpoints with the same truth are averaged first.  Series with fewer than two points
    and targets outside a series give no row.  A series has at most one point per
    checkpoint, and each segment between two of them picks the few targets inside it.
    """
    series = with_sweep_keys(results).groupBy(*by, "f0_mean_t").agg(
        F.avg("number_of_elements_processed").alias("t"),
        F.avg("f0_hat_mean_t").alias("y"),
        F.avg("stddev").alias("s"),
    )
    order = Window.partitionBy(*by).orderBy("f0_mean_t")
    x = F.col("f0_mean_t")
    segments = series.select(
        *by,
        x.alias("x"),
        "t",
        "y",
        "s",
        F.lead(x).over(order).alias("x_next"),
        F.lead("t").over(order).alias("t_next"),
        F.lead("y").over(order).alias("y_next"),
        F.lead("s").over(order).alias("s_next"),
        F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("points"),
    ).where(F.col("points") >= 2)
    star = F.col("f0_star")

    def inside(target: Column) -> Column:
        return (F.col("x") <= target) & (
            (target < F.col("x_next")) | (F.col("x_next").isNull() & (target == F.col("x")))
        )

    wanted = F.array(*[F.lit(float(v)) for v in targets])
    hit = segments.withColumn("f0_star", F.explode(F.filter(wanted, inside)))

    def between(name: str) -> Column:
        slope = (F.col(f"{name}_next") - F.col(name)) / (F.col("x_next") - F.col("x"))
        return F.when(F.col("x_next").isNull(), F.col(name)).otherwise(
            slope * (star - F.col("x")) + F.col(name)
        )

    return hit.select(
        *by,
        star.cast("bigint").alias("f0_star"),
        (between("t") / star).alias("rho_t"),
        between("y").alias("f0_hat"),
        between("s").alias("stddev"),
    )


def interpolated_error(points: DataFrame, by: Sequence[str] = ("algorithm_label",)) -> DataFrame:
    """Mean relative error of interpolated estimates."""
    error = F.abs(F.col("f0_hat") - F.col("f0_star")) / F.col("f0_star")
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.avg(error).alias("mean_relative_error")
    )


def truth_curve(results: DataFrame) -> DataFrame:
    """The truth per experiment and position, once over all algorithms, with its ratios.

    ``rho_t`` is elements per distinct element so far; boundaries are the positions at which
    a block of a constant-ratio stream ends.
    """
    usable = results.where((F.col("f0_mean_t") > 0) & (F.col("number_of_elements_processed") > 0))
    once = usable.groupBy("sample_size", "f0", "seed", "number_of_elements_processed").agg(
        F.min("f0_mean_t").alias("f0_mean_t")
    )
    c = F.col
    return once.withColumns(
        {
            "rho_final": repetition(c("sample_size"), c("f0")),
            "rho_t": distinct_ratio(c("number_of_elements_processed"), c("f0_mean_t")),
            "progress_pct": progress_percent(c("number_of_elements_processed"), c("sample_size")),
        }
    ).withColumn("is_boundary", is_boundary(c("number_of_elements_processed"), c("rho_final")))


def with_bands(results: DataFrame) -> DataFrame:
    """Attach the log-normal and the linear band of the mean estimate."""
    log_low, log_high = log_band(F.col("f0_hat_mean_t"), F.col("stddev"))
    low, high = linear_band(F.col("f0_hat_mean_t"), F.col("stddev"))
    return results.withColumns(
        {
            "log_band_low": log_low,
            "log_band_high": log_high,
            "band_low": low,
            "band_high": high,
        }
    )


def pivot_metric(
    rows: DataFrame, index: Sequence[str], column: str, values: Sequence, metric: str
) -> DataFrame:
    """Metric with one column per value; the values are given, so no extra pass finds them."""
    return rows.groupBy(*index).pivot(column, list(values)).agg(F.first(metric))


# --- merge reports --------------------------------------------------------------------


def homogeneous_summary(pairs: DataFrame) -> DataFrame:
    """Merge against serial per (namespace, d, rho, hash, k)."""
    gap = F.col("delta_merge_serial_abs")
    rows = pairs.groupBy("namespace", "d", "rho", "hash", "k").agg(
        F.count("pair_index").alias("pairs"),
        F.avg("estimate_merge").alias("estimate_merge_mean"),
        F.avg("estimate_serial").alias("estimate_serial_mean"),
        F.avg(gap).alias("delta_abs_mean"),
        F.max(gap).alias("delta_abs_max"),
        F.sqrt(F.avg(gap * gap)).alias("delta_abs_rmse"),
        F.avg("delta_merge_serial_rel").alias("delta_rel_mean"),
        F.max("delta_merge_serial_rel").alias("delta_rel_max"),
        F.count_if(F.abs(gap) > 0).alias("nonzero_pairs"),
    )
    share = F.col("nonzero_pairs") / F.col("pairs")
    return rows.withColumn("nonzero_share", share).orderBy("rho", "hash", "k")


def worst_cells(summary: DataFrame, n: int = 10) -> DataFrame:
    """The cells with the largest relative, then absolute gap."""
    return summary.orderBy(
        F.desc("delta_rel_max"), F.desc("delta_abs_max"), "namespace", "rho", "hash", "k"
    ).limit(n)


def with_merge_ratios(pairs: DataFrame) -> DataFrame:
    """Attach ``degradation_ratio`` and ``baseline_gap_rel`` per pair."""
    c = F.col
    return pairs.withColumns(
        {
            "degradation_ratio": degradation_ratio(
                c("error_merge_rel_exact"), c("error_serial_rel_exact")
            ),
            "baseline_gap_rel": baseline_gap(
                c("estimate_merge"), c("baseline_homogeneous"), c("exact_union")
            ),
        }
    )


def _mismatch_aggregates(gap_rel: bool) -> list[Column]:
    """Averages skip NaN, as rejected merges carry NaN estimates."""
    clean = lambda name: null_if_nan(F.col(name))
    merge = clean("error_merge_rel_exact")
    columns = [
        F.count(F.lit(1)).alias("pairs"),
        F.avg(merge).alias("merge_rel_mean"),
        F.max(merge).alias("merge_rel_max"),
        F.avg(clean("error_serial_rel_exact")).alias("serial_rel_mean"),
        F.avg(clean("delta_vs_baseline")).alias("baseline_gap_abs_mean"),
        F.max(clean("delta_vs_baseline")).alias("baseline_gap_abs_max"),
    ]
    if gap_rel:
        columns.append(F.avg(clean("baseline_gap_rel")).alias("baseline_gap_rel_mean"))
    columns.append(F.avg(clean("degradation_ratio")).alias("degradation_ratio_mean"))
    return columns


def _mismatch_report(rows: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """The aggregates per group, with the median error, which takes no group into one task,
    behind the mean."""
    summary = rows.groupBy(*by).agg(*aggregates)
    clean = rows.select(*by, null_if_nan(F.col("error_merge_rel_exact")).alias("__error"))
    medians = group_medians(clean, by, "__error", "merge_rel_median")
    names = [*summary.columns]
    names.insert(names.index("merge_rel_mean") + 1, "merge_rel_median")
    return null_safe_join(summary, medians, by, "left").select(*names)


def hash_mismatch_runs(pairs: DataFrame) -> DataFrame:
    """Hash mismatch results per run configuration."""
    by = ["scenario", "strategy", "validity", "d", "rho", "left_hash", "right_hash"]
    rows = _mismatch_report(with_merge_ratios(pairs), by, *_mismatch_aggregates(gap_rel=True))
    return rows.orderBy(
        order_of(F.col("scenario"), SCENARIO_ORDER), "strategy", "d", "left_hash", "right_hash"
    )


def hash_mismatch_global(pairs: DataFrame) -> DataFrame:
    """Hash mismatch results per scenario, strategy and validity."""
    by = ["scenario", "strategy", "validity"]
    rows = _mismatch_report(with_merge_ratios(pairs), by, *_mismatch_aggregates(gap_rel=False))
    return rows.orderBy(order_of(F.col("scenario"), SCENARIO_ORDER), "strategy")


def control_summary(runs_summary: DataFrame) -> DataFrame:
    rows = runs_summary.where(F.col("scenario") == "ctrl").select(
        "d", "rho", "left_hash", "merge_rel_mean", "serial_rel_mean", "baseline_gap_abs_mean"
    )
    return rows.orderBy(order_of(F.col("left_hash"), HASH_ORDER), "rho")


def unsafe_summary(runs_summary: DataFrame) -> DataFrame:
    return runs_summary.where(F.col("strategy") == "unsafe_naive_merge").select(
        "scenario", "d", "rho", "left_hash", "right_hash", "merge_rel_mean", "serial_rel_mean",
        "baseline_gap_abs_mean", "baseline_gap_rel_mean", "degradation_ratio_mean",
    )


def unsafe_by_scenario(unsafe: DataFrame) -> DataFrame:
    """Mean error of forced merges per scenario, with its label, and rho."""
    rows = unsafe.groupBy("scenario", "rho").agg(F.avg("merge_rel_mean").alias("merge_rel_mean"))
    return rows.withColumn("scenario_label", scenario_label(F.col("scenario"))).orderBy(
        order_of(F.col("scenario"), SCENARIO_ORDER), "rho"
    )


def with_pairing(pairs: DataFrame) -> DataFrame:
    """Attach ``pairing`` (``10->14``) and ``pair_group`` (``10 vs 14``)."""
    left, right = (param_value(F.col(name), "k") for name in ("left_params", "right_params"))
    low, high = F.least(left, right), F.greatest(left, right)
    return pairs.withColumns(
        {
            "pairing": F.concat(left.cast("string"), F.lit("->"), right.cast("string")),
            "pair_group": F.concat(low.cast("string"), F.lit(" vs "), high.cast("string")),
        }
    )


def precision_mismatch_runs(pairs: DataFrame) -> DataFrame:
    """Precision mismatch results per pairing, with all-pairs equality checks.

    Two NaN values count as equal.
    """
    by = ["pairing", "pair_group", "strategy", "validity", "d", "rho"]
    merged = F.col("estimate_merge")
    rows = _mismatch_report(
        with_merge_ratios(with_pairing(pairs)),
        by,
        *_mismatch_aggregates(gap_rel=True),
        F.every(merged.eqNullSafe(F.col("estimate_serial"))).alias("merge_eq_serial_all"),
        F.every(merged.eqNullSafe(F.col("baseline_homogeneous"))).alias("merge_eq_baseline_all"),
    )
    return rows.orderBy(
        order_of(F.col("pairing"), PAIRING_ORDER),
        order_of(F.col("strategy"), STRATEGY_ORDER),
        "d",
    )


def precision_mismatch_global(pairs: DataFrame) -> DataFrame:
    """Precision mismatch results per strategy and validity."""
    rows = _mismatch_report(
        with_merge_ratios(pairs), ["strategy", "validity"], *_mismatch_aggregates(gap_rel=False)
    )
    return rows.orderBy(order_of(F.col("strategy"), STRATEGY_ORDER))


def precision_mismatch_pair_groups(pairs: DataFrame) -> DataFrame:
    """Precision mismatch results per unordered pair of precisions."""
    by = ["pair_group", "strategy", "d", "rho"]
    clean = lambda name: F.avg(null_if_nan(F.col(name)))
    rows = with_merge_ratios(with_pairing(pairs)).groupBy(*by).agg(
        clean("error_merge_rel_exact").alias("merge_rel_mean"),
        clean("error_serial_rel_exact").alias("serial_rel_mean"),
        clean("baseline_gap_rel").alias("baseline_gap_rel_mean"),
        clean("degradation_ratio").alias("degradation_ratio_mean"),
    )
    return rows.orderBy(
        order_of(F.col("pair_group"), PAIR_GROUP_ORDER),
        order_of(F.col("strategy"), STRATEGY_ORDER),
        "d",
    )


def consistency_checks(pairs: DataFrame) -> DataFrame:
    """Three statements about precision mismatch results, each true or false.

    Computed in one pass; a statement about no rows is true.
    """
    merged = F.col("estimate_merge")
    reduced = F.col("strategy") == "reduce_then_merge"
    rejected = F.col("strategy") == "reject"

    def all_of(scope: Column, statement: Column) -> Column:
        return F.coalesce(F.every(F.when(scope, statement)), F.lit(True))

    flags = pairs.agg(
        all_of(reduced, merged.eqNullSafe(F.col("estimate_serial"))).alias("serial"),
        all_of(reduced, merged.eqNullSafe(F.col("baseline_homogeneous"))).alias("baseline"),
        all_of(rejected, F.isnan(merged)).alias("rejected"),
    )
    named = {
        "serial": "reduce_then_merge == serial for all pairs",
        "baseline": "reduce_then_merge == baseline for all pairs",
        "rejected": "reject produces NaN merge estimates",
    }
    rows = [
        F.struct(F.lit(text).alias("check"), F.col(flag).alias("value"))
        for flag, text in named.items()
    ]
    return flags.select(F.inline(F.array(*rows)))


def _findings(summary: DataFrame, figures: Mapping[str, Column]) -> DataFrame:
    """One row per named figure, all computed in a single aggregation."""
    names = {f"f{i}": name for i, name in enumerate(figures)}
    picked = summary.agg(*[c.alias(f"f{i}") for i, c in enumerate(figures.values())])
    rows = [
        F.struct(F.lit(name).alias("finding"), F.col(field).alias("value"))
        for field, name in names.items()
    ]
    return picked.select(F.inline(F.array(*rows)))


def hash_mismatch_findings(summary: DataFrame) -> DataFrame:
    """Named figures picked from the global hash mismatch report."""
    control = (F.col("scenario") == "ctrl") & (F.col("strategy") == "direct")
    unsafe = F.col("strategy") == "unsafe_naive_merge"
    mean, worst = F.col("merge_rel_mean"), F.col("merge_rel_max")
    return _findings(
        summary,
        {
            "homogeneous control": F.first(F.when(control, mean), ignorenulls=True),
            "unsafe invalid merge": F.avg(F.when(unsafe, mean)),
            "worst-case unsafe invalid merge": F.max(F.when(unsafe, worst)),
        },
    )


def precision_mismatch_findings(summary: DataFrame) -> DataFrame:
    """Named figures picked from the global precision mismatch report."""

    def of(strategy: str, column: str) -> Column:
        chosen = F.when(F.col("strategy") == strategy, F.col(column))
        return F.first(chosen, ignorenulls=True)

    return _findings(
        summary,
        {
            "reduce_then_merge global mean relative error": of(
                "reduce_then_merge", "merge_rel_mean"
            ),
            "unsafe_naive_merge global mean relative error": of(
                "unsafe_naive_merge", "merge_rel_mean"
            ),
            "worst-case unsafe_naive_merge": of("unsafe_naive_merge", "merge_rel_max"),
        },
    )
