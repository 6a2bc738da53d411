"""Merged sketches against one sketch over all the data, pair by pair.

Runs 2i and 2i+1 form pair i.  ``runs`` needs ``run_id`` and ``value``; positions play no
part, as a sketch does not depend on order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import bits as b
from tallymark.functions.bias import BiasPoints
from tallymark.functions.bits import SPARSE_PRECISION
from tallymark.functions.errors import NAN, absolute_error, merge_delta, relative_error
from tallymark.functions.hashing import resolve_hash
from tallymark.functions.labels import algorithm_name_of
from tallymark.functions.local import local_frame, null_safe_join
from tallymark.operators.cells import cells_from_hashes, hashed_rows, levels, summarize
from tallymark.operators.estimate import (
    attach_specs,
    estimate_rows,
    fine_precision,
    hash_ids,
    levels_needed,
)
from tallymark.operators.exact import exact_distinct, exact_pair_union, pair_runs, pair_values
from tallymark.operators.sparse import check_mode, with_format
from tallymark.operators.spec import SketchSpec
from tallymark.plans.grid import MergeCase

SERIAL = 2

MERGE_COLUMNS = (
    "algorithm", "params", "mode", "pairs", "sample_size", "pair_index", "seed",
    "estimate_merge", "estimate_serial", "delta_merge_serial_abs", "delta_merge_serial_rel",
)
HETEROGENEOUS_COLUMNS = (
    "algorithm", "mode", "pairs", "sample_size", "pair_index", "dataset_seed",
    "left_hash", "right_hash", "left_hash_seed", "right_hash_seed", "left_params",
    "right_params", "strategy", "validity", "topology", "exact_union", "estimate_merge",
    "estimate_serial", "error_merge_abs_exact", "error_merge_rel_exact",
    "error_serial_abs_exact", "error_serial_rel_exact", "baseline_homogeneous",
    "delta_vs_baseline",
)


def merge_pairs(
    runs: DataFrame,
    specs: Sequence[SketchSpec],
    run_count: int | None = None,
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """Merged and serial estimate of every spec for every pair of runs.

    The raw rows are read once, into the distinct values of every pair.  Each value is hashed
    once and feeds up to three groups, the two sides and the serial one, which are combined
    map-side to at most 2**k cells per group.  The merged sketch is then built from the two
    sides' cells alone, the serial one from its own.  In the ``auto`` mode of HyperLogLog++
    both are kept at sparse resolution, so that they agree by construction.
    """
    return _pair_estimates(_values(runs, run_count), specs, mode, bias_points)


def _values(runs: DataFrame, run_count: int | None) -> DataFrame:
    return pair_values(pair_runs(runs, run_count).select("pair_index", "side", "value"))


def _in_groups(rows: DataFrame, serial: Column | bool = True) -> DataFrame:
    """A row per side that has the value, and one for the serial group where ``serial`` holds."""
    both = F.lit(serial) if isinstance(serial, bool) else serial
    sides = F.array(F.when(F.col("in_left"), 0), F.when(F.col("in_right"), 1), F.when(both, SERIAL))
    return rows.withColumn("side", F.explode(F.array_compact(sides))).drop("in_left", "in_right")


def _pair_estimates(values, specs, mode, bias_points) -> DataFrame:
    check_mode(mode)
    counted = [s for s in specs if s.algo != "naive"]
    parts = []
    if counted:
        parts.append(_sketch_pairs(values, counted, mode, bias_points))
    if len(counted) < len(specs):
        parts.append(_exact_pairs(values))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    gap, share = merge_delta(F.col("estimate_merge"), F.col("estimate_serial"))
    return both.withColumns(
        {"delta_merge_serial_abs": gap.cast("double"), "delta_merge_serial_rel": share}
    )


def _side_by_side(estimates: DataFrame, by: Sequence[str]) -> DataFrame:
    value = F.col("estimate").cast("double")
    return estimates.groupBy(*by).agg(
        F.max(F.when(F.col("kind") == "merge", value)).alias("estimate_merge"),
        F.max(F.when(F.col("kind") == "serial", value)).alias("estimate_serial"),
    )


def _sketch_pairs(values, specs, mode, bias_points) -> DataFrame:
    bitmap = any(s.algo == "pc" for s in specs)
    ks = sorted({s.k for s in specs if s.k is not None})
    k_from = fine_precision(specs, mode)
    hashed = hashed_rows(values, ["pair_index", "in_left", "in_right"], "value", list(hash_ids(specs)))
    cell_rows = cells_from_hashes(_in_groups(hashed), ["pair_index", "side"], k_from, bitmap)
    kind = F.when(F.col("side") == SERIAL, "serial").otherwise("merge")
    by_kind = cell_rows.withColumn("kind", kind).drop("side")
    group = ["pair_index", "kind", "hash_id"]
    wanted = levels_needed(specs, mode)
    merged = levels(by_kind, group, k_from, wanted, bitmap, regroup=True)
    summary = summarize(merged, group, bitmap)
    if k_from == SPARSE_PRECISION:
        codes = by_kind.groupBy(*group, "idx").agg(F.max("rho").alias("rho"))
        summary = with_format(summary, codes, group, ks)
    rows = attach_specs(summary, specs)
    estimated = estimate_rows(rows, [s.algo for s in specs], ks, mode, bias_points)
    return _side_by_side(
        estimated.withColumnRenamed("algo", "algorithm"),
        ["pair_index", "algorithm", "params", "hash", "hash_seed"],
    )


def _exact_pairs(values: DataFrame) -> DataFrame:
    per_side = _in_groups(values, serial=False)
    merged = exact_distinct(per_side, ["pair_index"], "value", "estimate_merge")
    serial = exact_pair_union(values, "estimate_serial")
    both = null_safe_join(merged, serial, ["pair_index"])
    return both.select(
        "pair_index",
        F.lit("naive").alias("algorithm"),
        F.lit("").alias("params"),
        F.lit("").alias("hash"),
        F.lit(0).cast("bigint").alias("hash_seed"),
        F.col("estimate_merge").cast("double"),
        F.col("estimate_serial").cast("double"),
    )


def _pair_count(values: DataFrame) -> Column:
    """Pairs of runs that have a value, as a scalar subquery."""
    return exact_pair_union(values).where("exact_union > 0").select(F.count(F.lit(1))).scalar()


def merge_eval(
    runs: DataFrame,
    specs: Sequence[SketchSpec],
    sample_size: int,
    seed: int | None = None,
    run_count: int | None = None,
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """The merge evaluation in the columns of the merge result files, plus the hash."""
    values = _values(runs, run_count)
    points = _pair_estimates(values, specs, mode, bias_points)
    named = points.withColumns(
        {
            "pairs": _pair_count(values),
            "mode": F.lit("merge"),
            "sample_size": F.lit(sample_size).cast("bigint"),
            "seed": F.lit(seed).cast("bigint"),
        }
    ).withColumn("algorithm", algorithm_name_of(F.col("algorithm")))
    return named.select(*MERGE_COLUMNS, "hash", "hash_seed")


def _recipes(
    cases: Sequence[MergeCase], contexts: dict, mode: str
) -> tuple[list[tuple], list[tuple]]:
    """Which sketches the cases need, and which cells enter each of them.

    A sketch is described by its ingredients ``(side, hash_id, mid_k, to_k, naive, est_k,
    sparse)``: cells of ``side`` under ``hash_id`` are taken to ``mid_k`` properly, then to
    ``to_k``, properly or naively; ``sparse`` ones stay at precision 25 for the format rule.
    Equal descriptions are one sketch, however many cases and roles refer to it.  Returns
    rows ``(sketch_id, *ingredient)`` and rows ``(case_id, role, sketch_id)``.
    """
    known: dict[tuple, int] = {}
    uses = []

    def ingredient(side, context, mid_k, to_k, naive, as_is) -> tuple:
        codes = as_is and mode != "dense"
        at, to = (SPARSE_PRECISION, SPARSE_PRECISION) if codes else (mid_k, to_k)
        return (side, contexts[context], at, to, naive and at != to, to_k, codes)

    def use(case_id, role, *ingredients) -> None:
        uses.append((case_id, role, known.setdefault(ingredients, len(known))))

    for case_id, case in enumerate(cases):
        left = (case.left_hash, case.left_hash_seed)
        right = (case.right_hash, case.right_hash_seed)
        target = case.target_k
        recoverable = case.validity == "recoverable"
        if case.strategy != "reject":
            naive = case.strategy == "unsafe_naive_merge" and recoverable
            as_is = not recoverable
            use(
                case_id,
                "merge",
                ingredient(0, left, case.left_k, target, naive, as_is),
                ingredient(1, right, case.right_k, target, naive, as_is),
            )
        *serial, k = case.serial_context
        use(case_id, "serial", ingredient(SERIAL, tuple(serial), k, k, False, True))
        if case.baseline_context is not None:
            *baseline, k = case.baseline_context
            sides = [ingredient(side, tuple(baseline), k, k, False, True) for side in (0, 1)]
            use(case_id, "baseline", *sides)
    rows = [(i, *part) for parts, i in known.items() for part in parts]
    return rows, uses


def heterogeneous_pairs(
    runs: DataFrame,
    cases: Sequence[MergeCase],
    run_count: int | None = None,
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """Exact, merged, serial and baseline value of every case for every pair of runs.

    All cases share one scan: the raw rows become the distinct values of every pair, which
    are counted for the exact union and hashed once per distinct context.  They become cells
    per (pair, side, context), with a side of its own for the serial sketch, which sees all
    values; which cells enter which sketch is a small literal frame that is broadcast; a
    single maximum per (pair, sketch, register) then does reduction and merge together, since
    both commute with the maximum.  Sketches that several cases or roles have in common are
    made once.  Without a baseline its columns are NaN.
    """
    return _case_estimates(_values(runs, run_count), cases, mode, bias_points)


def _case_estimates(
    values: DataFrame, cases: Sequence[MergeCase], mode: str, bias_points: BiasPoints | None
) -> DataFrame:
    check_mode(mode)
    for case in cases:
        if case.problem:
            raise ValueError(case.problem)
    if not cases:
        raise ValueError("no merge cases")
    contexts: dict[tuple[str, int], int] = {}
    for case in cases:
        for name, hash_seed, _ in case.contexts:
            contexts.setdefault((name, hash_seed), len(contexts))
    spark = values.sparkSession
    ks = sorted({k for c in cases for _, _, k in c.contexts})
    k_from = max(ks) if mode == "dense" else SPARSE_PRECISION
    choices = [resolve_hash(name, seed) for name, seed in contexts]
    hashed = hashed_rows(values, ["pair_index", "in_left", "in_right"], "value", choices)
    serial_ids = sorted({contexts[c.serial_context[:2]] for c in cases})
    grouped = _in_groups(hashed, F.col("hash_id").isin(serial_ids))
    cell_rows = cells_from_hashes(grouped, ["pair_index", "side"], k_from)

    rows, uses = _recipes(cases, contexts, mode)
    recipe = local_frame(
        spark,
        rows,
        "sketch_id int, side int, hash_id int, mid_k int, to_k int, naive boolean, est_k int, "
        "sparse boolean",
    )
    mixed = cell_rows.join(F.broadcast(recipe), ["side", "hash_id"])
    mid_idx = b.reduced_idx(F.col("idx"), k_from, F.col("mid_k"))
    mid_rho = b.reduced_rho(F.col("idx"), F.col("rho"), k_from, F.col("mid_k"))
    staged = mixed.withColumns({"__idx": mid_idx, "__rho": mid_rho})
    to_rho = F.when(F.col("naive"), F.col("__rho")).otherwise(
        b.reduced_rho(F.col("__idx"), F.col("__rho"), F.col("mid_k"), F.col("to_k"))
    )
    group = ["pair_index", "sketch_id", "est_k", "sparse"]
    registers = (
        staged.select(
            *group,
            b.reduced_idx(F.col("__idx"), F.col("mid_k"), F.col("to_k")).alias("idx"),
            to_rho.alias("rho"),
        )
        .groupBy(*group, "idx")
        .agg(F.max("rho").alias("rho"))
    )
    by = ["pair_index", "sketch_id", "est_k"]
    dense_rows = registers.withColumn("k", F.col("est_k"))
    if mode == "dense":
        summary = summarize(dense_rows, by)
    else:
        codes = registers.where("sparse").select(*by, "idx", "rho")
        fixed = summarize(dense_rows.where(~F.col("sparse")).select(*by, "k", "idx", "rho"), by)
        lists = summarize(levels(codes, by, SPARSE_PRECISION, [*ks, SPARSE_PRECISION]), by)
        lists = with_format(lists, codes, by, ks).where(F.col("k") == F.col("est_k"))
        summary = fixed.withColumns(
            {"n_codes": F.lit(0).cast("bigint"), "dense": F.lit(True)}
        ).unionByName(lists)
        if mode == "sparse":
            summary = summary.withColumn("dense", F.col("n_codes") == 0)
    estimated = estimate_rows(
        summary.withColumn("algo", F.lit("hllpp")),
        ["hllpp"],
        ks,
        "dense" if mode == "dense" else "auto",
        bias_points,
    )
    value = F.col("estimate").cast("double")
    roles = local_frame(spark, uses, "case_id int, role string, sketch_id int")
    sketched = estimated.join(F.broadcast(roles), "sketch_id").groupBy(
        "pair_index", "case_id"
    ).agg(
        *[
            F.max(F.when(F.col("role") == role, value)).alias(name)
            for role, name in (
                ("merge", "estimate_merge"),
                ("serial", "estimate_serial"),
                ("baseline", "baseline_homogeneous"),
            )
        ]
    )
    exact = exact_pair_union(values)
    described = local_frame(
        spark,
        [
            (
                i, c.scenario, c.left_hash, c.right_hash, c.left_hash_seed, c.right_hash_seed,
                f"k={c.left_k}", f"k={c.right_k}", c.strategy, c.validity,
            )
            for i, c in enumerate(cases)
        ],
        "case_id int, scenario string, left_hash string, right_hash string, "
        "left_hash_seed bigint, right_hash_seed bigint, left_params string, "
        "right_params string, strategy string, validity string",
    )
    joined = sketched.join(exact, "pair_index").join(F.broadcast(described), "case_id")
    nan = F.lit(NAN)
    whole = joined.withColumns(
        {
            "exact_union": F.col("exact_union").cast("double"),
            "estimate_merge": F.coalesce("estimate_merge", nan),
            "baseline_homogeneous": F.coalesce("baseline_homogeneous", nan),
        }
    )
    c = F.col
    return whole.withColumns(
        {
            "error_merge_abs_exact": absolute_error(c("estimate_merge"), c("exact_union")),
            "error_merge_rel_exact": relative_error(c("estimate_merge"), c("exact_union")),
            "error_serial_abs_exact": absolute_error(c("estimate_serial"), c("exact_union")),
            "error_serial_rel_exact": relative_error(c("estimate_serial"), c("exact_union")),
            "delta_vs_baseline": absolute_error(c("estimate_merge"), c("baseline_homogeneous")),
        }
    )


def heterogeneous_eval(
    runs: DataFrame,
    cases: Sequence[MergeCase],
    sample_size: int,
    dataset_seed: int,
    run_count: int | None = None,
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """The heterogeneous evaluation in the columns of its result files, plus the scenario."""
    values = _values(runs, run_count)
    points = _case_estimates(values, cases, mode, bias_points)
    named = points.withColumns(
        {
            "algorithm": F.lit("HyperLogLog++"),
            "mode": F.lit("merge_heterogeneous"),
            "pairs": _pair_count(values),
            "sample_size": F.lit(sample_size).cast("bigint"),
            "dataset_seed": F.lit(dataset_seed).cast("bigint"),
            "topology": F.lit("pairwise"),
        }
    )
    return named.select(*HETEROGENEOUS_COLUMNS, "scenario")
