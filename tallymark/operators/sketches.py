"""Sketch tables: sketches as rows that can be stored, merged, reduced and estimated.

A sketch table holds ``keys.., algo, hash, hash_seed, k, l, res, idx, rho``: one row per
touched register, absent registers being 0.  ``res`` is the precision of ``idx``.  It equals
``k`` for dense sketches and 25 for HyperLogLog++ sketches kept at sparse resolution.
Probabilistic Counting rows carry the bit number in ``idx`` and 1 in ``rho`` (-1 and 0 for
elements outside the bitmap).  Merging is a
maximum per register for every algorithm, so it is associative, commutative and idempotent:
any topology, any order and any repetition of inputs give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import bits as b
from tallymark.functions.bias import MAX_K, BiasPoints
from tallymark.functions.bits import SPARSE_PRECISION
from tallymark.functions.labels import params_text
from tallymark.operators.cells import BITMAP_LEVEL, SUMS, cells, hashed_rows, register_terms
from tallymark.operators.estimate import estimate_rows
from tallymark.operators.sparse import (
    is_dense,
    is_open,
    check_mode,
    list_sizes,
    open_precisions,
)
from tallymark.operators.spec import HLLPP_K, SketchSpec
from tallymark.functions.local import null_safe_join

IDENTITY = ("algo", "hash", "hash_seed", "k", "l", "res")


def build_sketches(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    spec: SketchSpec,
    sparse_resolution: bool = False,
) -> DataFrame:
    """A sketch table with one sketch per key.

    ``sparse_resolution`` keeps HyperLogLog++ codes at precision 25, so that the format can
    still be decided after any number of merges.
    """
    if spec.algo == "naive":
        raise ValueError("exact sketches are value rows; see exact_values")
    if sparse_resolution and spec.algo != "hllpp":
        raise ValueError("only HyperLogLog++ has a sparse resolution")
    if spec.algo == "pc":
        registers = _bitmap_rows(df, keys, value, spec)
        res = None
    else:
        res = SPARSE_PRECISION if sparse_resolution else spec.k
        registers = cells(df, keys, value, [spec.hash], res).drop("hash_id")
        if spec.algo in ("hll", "ll"):
            registers = registers.withColumn("rho", b.rho32(F.col("rho"), spec.k))
    return registers.select(
        *keys,
        F.lit(spec.algo).alias("algo"),
        F.lit(spec.hash.name).alias("hash"),
        F.lit(spec.hash.seed).cast("bigint").alias("hash_seed"),
        F.lit(spec.k).cast("int").alias("k"),
        F.lit(spec.l).cast("int").alias("l"),
        F.lit(res).cast("int").alias("res"),
        "idx",
        "rho",
    )


def _bitmap_rows(
    df: DataFrame, keys: Sequence[str], value: str, spec: SketchSpec
) -> DataFrame:
    """One row per set bit, at most 31 per key.

    Elements that set no bit within the length leave a row with ``idx`` -1 and rank 0, so
    that no key with values is lost.
    """
    bit = b.bitmap_bit(F.col("h"))
    position = F.bit_count(bit - F.lit(1).cast("bigint"))
    missed = (F.col("__bit") == 0) | (F.col("__at") >= spec.l)
    rows = hashed_rows(df, keys, value, [spec.hash]).withColumns({"__bit": bit, "__at": position})
    placed = rows.select(
        *keys,
        F.when(missed, -1).otherwise(F.col("__at")).alias("idx"),
        F.when(missed, 0).otherwise(1).alias("rho"),
    )
    return placed.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def identity_text(prefix: str = "") -> Column:
    parts = [
        F.coalesce(F.col(prefix + name).cast("string"), F.lit("-")) for name in IDENTITY
    ]
    return F.concat_ws("/", *parts)


def incompatible_groups(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge groups whose sketches differ in algorithm, hash, seed or parameters."""
    identities = sketches.select(*by, identity_text().alias("__id")).distinct()
    return (
        identities.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("identities"), F.min("__id").alias("one"),
             F.max("__id").alias("other"))
        .where(F.col("identities") > 1)
    )


def merge_sketches(
    sketches: DataFrame, by: Sequence[str], verify: bool = True, combine: bool = True
) -> DataFrame:
    """Union of all sketches that share ``by``: a maximum per register.

    ``by`` may be any subset of the key columns or expressions over them, so this is also
    the roll-up of a stored sketch table to a coarser key.  With ``verify`` a group that
    mixes algorithms, hashes, seeds or parameters makes the query fail; the check is one
    scalar read from the merged rows, whose shuffle both then share.  ``verify=False`` keeps
    such sketches apart, as the identity stays part of the key.  ``combine=False`` shuffles the
    rows as they are: where few sketches meet in one, tasks hardly combine any before, and
    tables of nearly all their rows would take much memory.
    """
    if not combine:
        sketches = sketches.repartition(*by, "idx")
    merged = sketches.groupBy(*by, *IDENTITY, "idx").agg(F.max("rho").alias("rho"))
    if not verify:
        return merged
    # the condition on the rank keeps the aggregation the same as that of the result
    example = (
        incompatible_groups(merged.where(F.col("rho").isNotNull()), by)
        .agg(F.min(F.concat_ws(" and ", "one", "other")).alias("example"))
        .scalar()
    )
    message = F.concat(F.lit("sketches cannot be merged: "), example)
    passed = F.when(example.isNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return merged.where(passed)


def reduce_precision(
    sketches: DataFrame, keys: Sequence[str], target: int, naive: bool = False
) -> DataFrame:
    """Sketches lowered to precision ``target``; the result is always dense.

    A sketch whose precision already is ``target`` is returned unchanged, at its own
    resolution.  ``naive`` leaves the ranks as they are, which is wrong on purpose: it is
    the negative control.  Targets outside [4, k] make the query fail.
    """
    if target not in HLLPP_K:
        raise ValueError("the target precision has to lie in [4, 18]")
    bad = (F.col("k") < target) | F.col("k").isNull()
    message = F.concat(
        F.lit(f"cannot reduce to precision {target} from "),
        F.coalesce(F.col("k").cast("string"), F.lit("a sketch without precision")),
    )
    passed = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    same = F.col("k") == target
    # From sparse resolution first to the sketch's own precision, then to the target.
    own_idx = b.reduced_idx(F.col("idx"), F.col("res"), F.col("k"))
    own_rho = b.reduced_rho(F.col("idx"), F.col("rho"), F.col("res"), F.col("k"))
    staged = sketches.where(passed).withColumns({"__idx": own_idx, "__rho": own_rho})
    lowered_rho = (
        F.col("__rho")
        if naive
        else b.reduced_rho(F.col("__idx"), F.col("__rho"), F.col("k"), F.lit(target))
    )
    projected = staged.select(
        *keys,
        "algo",
        "hash",
        "hash_seed",
        F.lit(target).alias("k"),
        "l",
        F.when(same, F.col("res")).otherwise(F.lit(target)).alias("res"),
        F.when(same, F.col("idx"))
        .otherwise(b.reduced_idx(F.col("__idx"), F.col("k"), F.lit(target)))
        .alias("idx"),
        F.when(same, F.col("rho")).otherwise(lowered_rho).alias("rho"),
    )
    return projected.groupBy(*keys, *IDENTITY, "idx").agg(F.max("rho").alias("rho"))


def to_dense(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sparse-resolution sketches turned into dense registers of their own precision."""
    projected = sketches.select(
        *keys,
        "algo",
        "hash",
        "hash_seed",
        "k",
        "l",
        F.col("k").alias("res"),
        b.reduced_idx(F.col("idx"), F.col("res"), F.col("k")).alias("idx"),
        b.reduced_rho(F.col("idx"), F.col("rho"), F.col("res"), F.col("k")).alias("rho"),
    )
    return projected.groupBy(*keys, *IDENTITY, "idx").agg(F.max("rho").alias("rho"))


def estimate_sketches(
    sketches: DataFrame,
    keys: Sequence[str],
    mode: str = "auto",
    ks: Sequence[int] | None = None,
    algorithms: Sequence[str] = ("hllpp", "hll", "ll", "pc"),
    bias_points: BiasPoints | None = None,
) -> DataFrame:
    """Estimate per key and identity: ``keys.., algo, params, hash, hash_seed, estimate``.

    Dense sketches are estimated from their registers; sparse-resolution sketches follow
    ``mode``.  ``ks`` and ``algorithms`` may narrow the plan to what the table holds.
    """
    check_mode(mode)
    ks = sorted(ks or HLLPP_K)
    group = [*keys, *IDENTITY]
    is_pc = F.col("algo") == "pc"
    sparse = F.coalesce(F.col("res") == SPARSE_PRECISION, F.lit(False))
    # A sparse row counts once as a code and once as a register of its own precision.
    views = F.when(sparse, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    unfolded = sketches.withColumn("__code", F.explode(views))
    as_register = sparse & ~F.col("__code")
    projected = unfolded.select(
        *group,
        "__code",
        F.when(as_register, b.reduced_idx(F.col("idx"), F.col("res"), F.col("k")))
        .otherwise(F.col("idx"))
        .alias("idx"),
        F.when(as_register, b.reduced_rho(F.col("idx"), F.col("rho"), F.col("res"), F.col("k")))
        .otherwise(F.col("rho"))
        .alias("rho"),
    )
    registers = projected.groupBy(*group, "__code", "idx").agg(F.max("rho").alias("rho"))
    terms = register_terms(F.col("rho"), F.coalesce(F.col("k"), F.lit(4)))
    is_register = ~F.col("__code") & ~is_pc
    aggregates = [F.sum(F.when(is_register, terms[name])).alias(name) for name in SUMS]
    one = F.lit(1).cast("bigint")
    set_bit = F.when(is_pc & (F.col("idx") >= 0), b.shift_left(one, F.col("idx")))
    aggregates.append(F.coalesce(F.bit_or(set_bit), F.lit(0).cast("bigint")).alias("bits"))
    aggregates.append(F.sum(F.when(F.col("__code"), 1)).alias("n_codes"))
    summary = registers.groupBy(*group).agg(*aggregates)
    candidates = open_precisions(ks)
    if mode == "auto":
        size = F.lit(None).cast("bigint")
        if candidates:
            open_groups = summary.where(
                F.col("n_codes").isNotNull() & is_open(F.col("n_codes"), F.col("k"))
            )
            codes = sketches.where(F.col("res") == SPARSE_PRECISION)
            codes = codes.drop("k").groupBy(*[g for g in group if g != "k"], "idx").agg(
                F.max("rho").alias("rho")
            )
            sizes = list_sizes(codes, open_groups, [g for g in group if g != "k"])
            summary = null_safe_join(summary, sizes, group, "left")
            size = F.col("list_bits")
        dense = F.coalesce(is_dense(F.col("n_codes"), size, F.col("k")), F.lit(True))
    else:
        dense = F.lit(mode == "dense") | F.col("n_codes").isNull()
    rows = summary.withColumn("dense", dense).drop("list_bits")
    rows = rows.withColumn("k", F.coalesce("k", F.lit(BITMAP_LEVEL)))
    estimated = estimate_rows(rows, algorithms, ks, "auto", bias_points)
    return estimated.select(
        *keys,
        "algo",
        params_text(F.when(F.col("k") != BITMAP_LEVEL, F.col("k")), F.col("l")).alias("params"),
        "hash",
        "hash_seed",
        "estimate",
    )


def pack_registers(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per sketch for storage: a dense array of ranks of fixed length ``2**res``.

    The group collected per sketch is its registers, at most 2**18 small integers.  Sketches
    at sparse resolution, which may hold far more, and bitmaps make the query fail.
    """
    dense = F.coalesce(F.col("res") <= MAX_K, F.lit(False))
    refused = F.raise_error(F.lit("only dense register sketches can be packed")).cast("boolean")
    sketches = sketches.where(F.when(dense, F.lit(True)).otherwise(refused))
    filled = F.array_sort(F.collect_list(F.struct("idx", "rho")))
    grouped = sketches.groupBy(*keys, *IDENTITY).agg(filled.alias("__m"))
    # Each touched register brings the zeros before it, so the work is one pass over the array.
    zero, size = F.lit(0).cast("tinyint"), b.shift_left(F.lit(1), F.col("res"))
    before = F.concat(F.array(F.lit(-1)), F.transform("__m", lambda r: r["idx"]))
    pieces = F.zip_with(
        F.col("__m"),
        F.slice(before, 1, F.size("__m")),
        lambda r, prior: F.concat(
            F.array_repeat(zero, r["idx"] - prior - 1), F.array(r["rho"].cast("tinyint"))
        ),
    )
    rest = F.array_repeat(zero, (size - 1 - F.element_at("__m", -1)["idx"]).cast("int"))
    ranks = F.concat(F.flatten(pieces), rest)
    return grouped.withColumn("registers", ranks).drop("__m")


def unpack_registers(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The register rows of packed sketches; zeros are dropped again."""
    rows = packed.select(*keys, *IDENTITY, F.posexplode("registers").alias("idx", "rho"))
    return rows.where(F.col("rho") > 0).withColumn("rho", F.col("rho").cast("int"))


def empty_estimates(
    key_list: DataFrame, estimates: DataFrame, keys: Sequence[str], spec: SketchSpec
) -> DataFrame:
    """Estimates completed by keys without any value, which get the empty-sketch estimate."""
    empty = {"pc": 1, "hll": 0, "hllpp": 0}.get(spec.algo)
    if spec.algo == "ll":
        empty = int(0.39701 * (1 << spec.k))
    joined = null_safe_join(key_list.select(*keys).distinct(), estimates, keys, "left")
    return joined.select(
        *keys, F.coalesce("estimate", F.lit(empty).cast("bigint")).alias("estimate")
    )


