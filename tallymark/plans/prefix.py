"""Estimates along the prefixes of a stream.

``runs`` holds one row per element: ``run_id``, ``pos`` (1-based) and ``value``.  Repeats
cannot change a register, a bitmap or the truth, so everything after the first shuffle works
on first occurrences.  Each one is assigned to the checkpoint interval it falls into;
registers are reduced per (run, register, interval); a window over the at most 200 intervals
of one register finds where its rank rises; and the integer estimator sums of the rises are
accumulated per run.  No task ever holds a whole run.

Every run has a row at every checkpoint.  Where no value has come yet, as in a run that starts
late or holds nulls only, the truth is 0 and the estimate that of an empty sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import bits as b
from tallymark.functions.bias import BiasPoints
from tallymark.functions.bits import SPARSE_PRECISION
from tallymark.functions.errors import theoretical_rse
from tallymark.functions.labels import algorithm_name_of
from tallymark.functions.local import null_safe_join
from tallymark.operators.cells import (
    BITMAP_LEVEL,
    COARSEST,
    SUMS,
    by_coarsest,
    hashed_rows,
    register_terms,
    unfold,
)
from tallymark.operators.estimate import (
    attach_specs,
    estimate_rows,
    fine_precision,
    hash_ids,
    levels_needed,
)
from tallymark.operators.exact import first_occurrences
from tallymark.operators.sparse import (
    check_mode,
    is_dense,
    is_open,
    list_sizes,
    open_precisions,
)
from tallymark.operators.spec import SketchSpec
from tallymark.operators.statistics import STREAM_STATISTICS, error_statistics
from tallymark.plans.checkpoints import checkpoint_at, checkpoint_plan, interval_of

STREAM_COLUMNS = (
    "algorithm", "params", "mode", "runs", "sample_size", "number_of_elements_processed",
    "f0", "seed", "f0_mean_t", "f0_hat_mean_t", "variance", "stddev", "rse_theoretical",
    "rse_observed", "bias", "absolute_bias", "relative_bias", "mean_relative_error",
    "rmse", "mae",
)


#: Codes of a run are joined with its open checkpoints in 2**PART_BITS parts.
PART_BITS = 6


def first_in_interval(runs: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """``run_id, value, ckpt``: first occurrences with the interval they fall into."""
    first = first_occurrences(runs)
    placed = first.withColumn("ckpt", interval_of(F.col("first_pos"), checkpoints))
    return placed.where(F.col("ckpt").isNotNull()).select("run_id", "value", "ckpt")


def _starts(runs: DataFrame) -> DataFrame:
    """``run_id, ckpt``: every run at the first checkpoint, whether it holds a value or not."""
    return runs.select("run_id").distinct().withColumn("ckpt", F.lit(0))


def _fill_forward(rows: DataFrame, by: Sequence[str], values: dict[str, Column], n: int):
    """Accumulate ``values`` over intervals and repeat them up to the next row's interval."""
    order = Window.partitionBy(*by).orderBy("ckpt")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(
        *by,
        "ckpt",
        *[value.over(so_far).alias(name) for name, value in values.items()],
        (F.coalesce(F.lead("ckpt").over(order), F.lit(n)) - 1).alias("__until"),
    )
    repeated = running.withColumn("__at", F.explode(F.sequence("ckpt", "__until")))
    return repeated.drop("ckpt", "__until").withColumnRenamed("__at", "ckpt")


def prefix_truth(runs: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """``run_id, t, truth``: distinct elements among the first t, at every checkpoint."""
    first = first_in_interval(runs, checkpoints).select(
        "run_id", "ckpt", F.lit(1).cast("bigint").alias("new")
    )
    empty = _starts(runs).withColumn("new", F.lit(0).cast("bigint"))
    counts = first.unionByName(empty).groupBy("run_id", "ckpt").agg(F.sum("new").alias("new"))
    grown = _fill_forward(counts, ["run_id"], {"truth": F.sum("new")}, len(checkpoints))
    return grown.select(
        "run_id", checkpoint_at(F.col("ckpt"), checkpoints).alias("t"), "truth"
    )


def prefix_estimates(
    runs: DataFrame,
    specs: Sequence[SketchSpec],
    checkpoints: Sequence[int],
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """Truth and estimate of every spec for every run and checkpoint.

    Returns ``run_id, t, truth, algorithm, params, hash, hash_seed, estimate``.
    """
    check_mode(mode)
    if not checkpoints:
        raise ValueError("no checkpoints: an empty stream has no prefixes")
    counted = [s for s in specs if s.algo != "naive"]
    parts = []
    if counted:
        parts.append(_sketch_prefixes(runs, counted, checkpoints, mode, bias_points))
    if len(counted) < len(specs):
        truth = prefix_truth(runs, checkpoints)
        parts.append(
            truth.select(
                "run_id",
                "t",
                "truth",
                F.lit("naive").alias("algorithm"),
                F.lit("").alias("params"),
                F.lit("").alias("hash"),
                F.lit(0).cast("bigint").alias("hash_seed"),
                F.col("truth").alias("estimate"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _sketch_prefixes(runs, specs, checkpoints, mode, bias_points) -> DataFrame:
    ks = sorted({s.k for s in specs if s.k is not None})
    k_from = fine_precision(specs, mode)
    wanted = levels_needed(specs, mode)
    first = first_in_interval(runs, checkpoints)
    rows = hashed_rows(first, ["run_id", "ckpt"], "value", list(hash_ids(specs)))
    cell_rows = (
        rows.select(
            "run_id",
            "hash_id",
            "ckpt",
            b.register_idx(F.col("h"), k_from).alias("idx"),
            b.register_rho(F.col("h"), k_from).alias("rho"),
            b.bitmap_bit(F.col("h")).alias("bits"),
        )
        .groupBy("run_id", "hash_id", "ckpt", "idx")
        .agg(
            F.max("rho").alias("rho"),
            F.bit_or("bits").alias("bits"),
            F.count(F.lit(1)).alias("seen"),
        )
    )
    group = ["run_id", "hash_id", "k"]
    # One shuffle of the cells serves every level: the merge of a register per interval and the
    # window over its intervals both find their rows where the coarsest register put them.
    placed = by_coarsest(cell_rows, ["run_id", "hash_id"], k_from, wanted)
    per_register = (
        unfold(
            placed, ["run_id", "hash_id", COARSEST, "ckpt"], k_from, wanted, True, ["seen"]
        )
        .groupBy(*group, COARSEST, "ckpt", "idx")
        .agg(
            F.max("rho").alias("rho"),
            F.bit_or("bits").alias("bits"),
            F.sum("seen").alias("seen"),
        )
    )
    before = (
        Window.partitionBy(*group, COARSEST, "idx")
        .orderBy("ckpt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    traced = per_register.withColumn("old", F.max("rho").over(before))
    rises = traced.where(
        (F.col("k") == BITMAP_LEVEL) | F.col("old").isNull() | (F.col("rho") > F.col("old"))
    )
    # A register that rises from a rank to the same rank adds nothing to any sum.
    nothing = {"idx": F.lit(0), "rho": F.lit(1), "old": F.lit(1), "bits": F.lit(0), "seen": F.lit(0)}
    numbers = F.array(*[F.lit(i) for i in hash_ids(specs).values()])
    precisions = F.array(*[F.lit(k) for k in [BITMAP_LEVEL, *wanted]])
    empty = _starts(runs).withColumn("hash_id", F.explode(numbers))
    empty = empty.withColumn("k", F.explode(precisions))
    types = dict(rises.dtypes)
    rises = rises.drop(COARSEST).unionByName(
        empty.withColumns({name: value.cast(types[name]) for name, value in nothing.items()})
    )
    new_terms = register_terms(F.col("rho"), F.col("k"))
    old_terms = register_terms(F.col("old"), F.col("k"))
    is_register = F.col("k") != BITMAP_LEVEL
    deltas = rises.groupBy(*group, "ckpt").agg(
        *[
            F.coalesce(
                F.sum(
                    F.when(
                        is_register,
                        new_terms[name]
                        - F.when(F.col("old").isNotNull(), old_terms[name]).otherwise(F.lit(0)),
                    )
                ),
                F.lit(0),
            ).alias(name)
            for name in SUMS
        ],
        F.bit_or("bits").alias("bits"),
        F.sum("seen").alias("seen"),
    )
    accumulated = {name: F.sum(name) for name in SUMS}
    accumulated |= {"bits": F.bit_or("bits"), "seen": F.sum("seen")}
    grid = _fill_forward(deltas, group, accumulated, len(checkpoints))
    # Truth sits on the base level, the code count on level 25; both at most 17 rows away.
    side = Window.partitionBy("run_id", "hash_id", "ckpt")
    grid = grid.withColumn("truth", F.max("seen").over(side))
    algorithms = [s.algo for s in specs]
    if k_from == SPARSE_PRECISION:
        is_codes = F.col("k") == SPARSE_PRECISION
        grid = grid.withColumn(
            "n_codes", F.max(F.when(is_codes, F.col("occupied"))).over(side)
        ).where(~is_codes)
        grid = _prefix_format(grid, cell_rows, ks) if mode == "auto" else grid
    rows = attach_specs(grid, specs)
    estimated = estimate_rows(rows, algorithms, ks, mode, bias_points)
    return estimated.select(
        "run_id",
        checkpoint_at(F.col("ckpt"), checkpoints).alias("t"),
        "truth",
        F.col("algo").alias("algorithm"),
        "params",
        "hash",
        "hash_seed",
        "estimate",
    )


def _prefix_format(grid: DataFrame, cell_rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Attach ``dense`` per checkpoint; lists are measured only where their size is open."""
    candidates = open_precisions(ks)
    if not candidates:
        none = F.lit(None).cast("bigint")
        return grid.withColumn("dense", is_dense(F.col("n_codes"), none, F.col("k")))
    at = ["run_id", "hash_id", "ckpt"]
    open_points = grid.where(
        F.col("k").isin(*candidates) & is_open(F.col("n_codes"), F.col("k"))
    ).select(*at, "k")
    # A run's codes are dealt out by their leading bits, so that one long run is no single task,
    # and those after its last open checkpoint are not looked at.
    wanted = open_points.groupBy("run_id", "hash_id").agg(
        F.collect_set("ckpt").alias("points"), F.max("ckpt").alias("last")
    )
    part = (F.col("idx") / F.lit(1 << (SPARSE_PRECISION - PART_BITS))).cast("int")
    until = (
        null_safe_join(
            cell_rows.select("run_id", "hash_id", "ckpt", "idx", "rho", part.alias("part")),
            wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((1 << PART_BITS) - 1)))),
            ["run_id", "hash_id", "part"],
        )
        .where(F.col("ckpt") <= F.col("last"))
        .withColumn("point", F.explode("points"))
        .where(F.col("ckpt") <= F.col("point"))
    )
    codes = until.groupBy("run_id", "hash_id", F.col("point").alias("ckpt"), "idx").agg(
        F.max("rho").alias("rho")
    )
    sizes = list_sizes(codes, open_points, at)
    sized = null_safe_join(grid, sizes, [*at, "k"], "left")
    return sized.withColumn(
        "dense", is_dense(F.col("n_codes"), F.col("list_bits"), F.col("k"))
    ).drop("list_bits")


def prefix_statistics(estimates: DataFrame) -> DataFrame:
    """Error statistics over runs per algorithm, hash, parameters and checkpoint."""
    by = ["algorithm", "params", "hash", "hash_seed", "t"]
    return error_statistics(estimates, by, "estimate", "truth")


def prefix_eval(
    runs: DataFrame,
    specs: Sequence[SketchSpec],
    sample_size: int,
    seed: int | None = None,
    budget: int = 200,
    mode: str = "dense",
    checkpoints: Sequence[int] | None = None,
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """The prefix evaluation: one row per algorithm, hash, parameters and checkpoint.

    Columns are those of the prefix result files, plus ``hash`` and ``hash_seed``.  ``f0`` is
    the mean distinct count of the runs at the last checkpoint, truncated.
    """
    points = list(checkpoints) if checkpoints else checkpoint_plan(sample_size, budget)
    stats = prefix_statistics(prefix_estimates(runs, specs, points, mode, bias_points))
    whole = Window.partitionBy("algorithm", "params", "hash", "hash_seed")
    k = F.regexp_extract("params", r"k=(\d+)", 1)
    k = F.when(k != "", k).otherwise(F.lit("0")).cast("int")
    named = stats.withColumns(
        {
            "rse_theoretical": theoretical_rse(F.col("algorithm"), k),
            "f0": F.floor(F.max_by("f0_mean_t", "t").over(whole)).cast("bigint"),
            "mode": F.lit("streaming"),
            "sample_size": F.lit(sample_size).cast("bigint"),
            "seed": F.lit(seed).cast("bigint"),
            "number_of_elements_processed": F.col("t"),
        }
    ).withColumn("algorithm", algorithm_name_of(F.col("algorithm")))
    return named.select(*STREAM_COLUMNS, "hash", "hash_seed")


__all__ = [
    "STREAM_COLUMNS", "STREAM_STATISTICS", "first_in_interval", "prefix_estimates",
    "prefix_eval", "prefix_statistics", "prefix_truth",
]
