"""From estimator sums to estimates, and the one-pass multi-sketch query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import bits as b
from tallymark.functions import estimators as e
from tallymark.functions.bias import BiasPoints, subtract_bias
from tallymark.functions.bits import SPARSE_PRECISION
from tallymark.functions.local import local_frame
from tallymark.operators.cells import BITMAP_LEVEL, cells, hashed_rows, levels, summarize
from tallymark.operators.exact import exact_distinct
from tallymark.operators.sparse import (
    LEAST_LEVEL,
    check_mode,
    settled_keys,
    with_open_format,
    without_settled,
)
from tallymark.operators.spec import SketchSpec

SPEC_COLUMNS = ("algorithm", "params", "hash", "hash_seed")


def hash_ids(specs: Sequence[SketchSpec]) -> dict:
    """Distinct hashes of the specs, numbered in order of appearance."""
    return {choice: i for i, choice in enumerate(dict.fromkeys(s.hash for s in specs))}


def fine_precision(specs: Sequence[SketchSpec], mode: str) -> int:
    """Precision of the shared cells: 25 where the sparse form of HyperLogLog++ counts."""
    if mode != "dense" and any(s.algo == "hllpp" for s in specs):
        return SPARSE_PRECISION
    return max([s.k for s in specs if s.k is not None], default=4)


def levels_needed(specs: Sequence[SketchSpec], mode: str) -> list[int]:
    ks = sorted({s.k for s in specs if s.k is not None})
    if mode != "dense" and any(s.algo == "hllpp" for s in specs):
        ks.append(SPARSE_PRECISION)
    return ks or [4]


def attach_specs(summary: DataFrame, specs: Sequence[SketchSpec]) -> DataFrame:
    """One row per (row of ``summary``, spec that reads its hash and precision)."""
    ids = hash_ids(specs)
    if len(specs) == 1:
        spec = specs[0]
        return summary.withColumns(
            {
                "algo": F.lit(spec.algo),
                "l": F.lit(spec.l).cast("int"),
                "params": F.lit(spec.params),
                "hash": F.lit(spec.hash.name),
                "hash_seed": F.lit(spec.hash.seed).cast("bigint"),
            }
        ).where(F.col("k") == (spec.k if spec.k is not None else BITMAP_LEVEL))
    rows = [
        (
            ids[s.hash],
            s.k if s.k is not None else BITMAP_LEVEL,
            s.algo,
            s.l,
            s.params,
            s.hash.name,
            s.hash.seed,
        )
        for s in specs
    ]
    frame = local_frame(
        summary.sparkSession,
        rows,
        "hash_id int, k int, algo string, l int, params string, hash string, hash_seed bigint",
    )
    return summary.join(F.broadcast(frame), ["hash_id", "k"])


def estimate_rows(
    rows: DataFrame,
    algorithms: Sequence[str],
    ks: Sequence[int],
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
    out: str = "estimate",
) -> DataFrame:
    """Attach the estimate to rows that carry ``algo, k, l`` and the estimator sums.

    ``mode`` other than ``dense`` also needs ``n_codes`` and, for ``auto``, ``dense``.
    Only the algorithms present are compiled into the plan.
    """
    c = F.col
    present = set(algorithms)
    inverse = e.inverse_sum(c("inv_high"), c("inv_low"), c("occupied"), c("k"))
    inverse32 = e.inverse_sum(c("inv32"), F.lit(0), c("occupied"), c("k"))
    chosen: Column | None = None

    def case(algo: str, value: Column) -> None:
        nonlocal chosen
        if present == {algo}:
            chosen = value
        elif chosen is None:
            chosen = F.when(c("algo") == algo, value)
        else:
            chosen = chosen.when(c("algo") == algo, value)

    extra: list[str] = []
    if "hllpp" in present and mode != "sparse":
        raw = e.raw_estimate(inverse, c("k"))
        if present != {"hllpp"}:
            raw = F.when(c("algo") == "hllpp", raw)
        rows = subtract_bias(
            rows.withColumn("__raw", raw), "__raw", "k", ks, bias_points, "__corrected"
        )
        extra = ["__raw", "__corrected"]
        value = e.hyperloglog_pp(c("__corrected"), c("occupied"), c("k"))
        if mode == "auto":
            value = F.when(c("dense"), value).otherwise(e.sparse_estimate(c("n_codes")))
        case("hllpp", value)
    elif "hllpp" in present:
        case("hllpp", e.sparse_estimate(c("n_codes")))
    if "hll" in present:
        case("hll", e.hyperloglog(inverse32, c("occupied"), c("k")))
    if "ll" in present:
        case("ll", e.loglog(c("rho_sum"), c("k")))
    if "pc" in present:
        case("pc", e.probabilistic_counting(c("bits"), c("l")))
    return rows.withColumn(out, chosen).drop(*extra)


def distinct_estimates(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    specs: Sequence[SketchSpec],
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """Distinct-count estimates per key for a whole list of specs in one pass.

    Returns ``keys, algorithm, params, hash, hash_seed, estimate``.  The raw data is read,
    hashed and shuffled once at the finest precision needed; every other precision and
    algorithm is derived from the resulting cells.

    ``mode`` concerns HyperLogLog++ only.  ``dense`` always uses registers and shuffles at
    most 2**k rows per key and task.  ``sparse`` always counts codes, up to 2**25 per key, and
    so shuffles about as much as an exact distinct count; other algorithms read the rows once more.  ``auto`` applies the
    sparse-or-dense rule in two phases: registers first, then a second reading of the rows for
    the codes of keys that the registers do not prove to be dense.
    """
    check_mode(mode)
    if not specs:
        raise ValueError("nothing to estimate: the list of specs is empty")
    counted = [s for s in specs if s.algo != "naive"]
    parts = []
    listed = [s for s in counted if s.algo == "hllpp"] if mode == "sparse" else []
    if listed:
        parts.append(_code_estimates(df, keys, value, listed))
    others = [s for s in counted if s not in listed]
    if others:
        parts.append(_sketch_estimates(df, keys, value, others, mode, bias_points))
    if len(counted) < len(specs):
        exact = exact_distinct(df, keys, value, "estimate")
        parts.append(
            exact.select(
                *keys,
                F.lit("naive").alias("algorithm"),
                F.lit("").alias("params"),
                F.lit("").alias("hash"),
                F.lit(0).cast("bigint").alias("hash_seed"),
                "estimate",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _code_estimates(df, keys, value, specs) -> DataFrame:
    """Sparse estimates: only the number of codes counts, so no register is made of them."""
    group = [*keys, "hash_id"]
    rows = hashed_rows(df, keys, value, list(hash_ids(specs)))
    codes = rows.select(*group, b.register_idx(F.col("h"), SPARSE_PRECISION).alias("idx")).distinct()
    summary = codes.groupBy(*group).agg(F.count(F.lit(1)).alias("n_codes"))
    ks = sorted({s.k for s in specs})
    rows = attach_specs(summary.withColumn("k", F.explode(F.array(*map(F.lit, ks)))), specs)
    return estimate_rows(rows, ["hllpp"], ks, "sparse").select(
        *keys, F.col("algo").alias("algorithm"), "params", "hash", "hash_seed", "estimate"
    )


def _sketch_estimates(df, keys, value, specs, mode, bias_points) -> DataFrame:
    bitmap = any(s.algo == "pc" for s in specs)
    ks = sorted({s.k for s in specs if s.k is not None})
    hashes = list(hash_ids(specs))
    group = [*keys, "hash_id"]
    listed = [s.k for s in specs if s.algo == "hllpp"] if mode == "auto" else []
    k_from = max(*ks, LEAST_LEVEL) if listed else fine_precision(specs, mode)
    cell_rows = cells(df, keys, value, hashes, k_from, bitmap)
    if not ks:
        per_level = cell_rows.groupBy(*group).agg(F.bit_or("bits").alias("bits"))
        summary = per_level.withColumn("k", F.lit(BITMAP_LEVEL))
    else:
        wanted = [*ks, k_from] if listed else levels_needed(specs, mode)
        summary = summarize(levels(cell_rows, group, k_from, wanted, bitmap), group, bitmap)
    if listed:
        settled = settled_keys(summary, keys, len(hashes), k_from, max(listed))
        codes = cells(without_settled(df, keys, settled), keys, value, hashes, SPARSE_PRECISION)
        summary = with_open_format(summary, codes, group, sorted(set(listed)))
    rows = attach_specs(summary, specs)
    estimated = estimate_rows(rows, [s.algo for s in specs], ks, mode, bias_points)
    return estimated.select(
        *keys, F.col("algo").alias("algorithm"), "params", "hash", "hash_seed", "estimate"
    )
