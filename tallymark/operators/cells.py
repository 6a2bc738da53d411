"""Register cells: the one aggregation that all register sketches share.

``cells`` reduces raw rows to at most ``2**k`` rows per key and hash, with map-side
combining, whatever the row count of the key; the shuffle is by (key, register), so a key
that holds a third of all rows is still spread over many tasks.  Lower precisions, LogLog,
HyperLogLog, HyperLogLog++ and Probabilistic Counting are all derived from those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import bits as b
from tallymark.functions.estimators import INV_SCALE_HIGH, INV_SCALE_LOW
from tallymark.functions.hashing import BUILT_IN, HashChoice

BITMAP_LEVEL = 0


def hashed_rows(
    df: DataFrame, keep: Sequence[str], value: str, hashes: Sequence[HashChoice]
) -> DataFrame:
    """Columns ``keep``, ``hash_id`` and ``h``: every row hashed by every hash, nulls left out.

    Built-in hashes share one branch and are unfolded after hashing.  Every other hash gets
    a branch of its own: a few hundred operations per row are as much as one generated
    method can hold and still be compiled to machine code, and two such hashes in one method
    would run interpreted, at a tenth of the speed.  Reading two narrow columns once more
    costs little beside computing the hash; where the input is itself the result of a
    shuffle, all branches read the same one.
    """
    # The coalesce only tells the planner that no null is left, which spares every step of
    # the hash its null checks.
    solid = F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint"))
    rows = df.where(F.col(value).isNotNull()).select(*keep, solid.alias("__value"))
    numbered = list(enumerate(hashes))
    light = [(i, choice) for i, choice in numbered if choice.name in BUILT_IN]
    heavy = [(i, choice) for i, choice in numbered if choice.name not in BUILT_IN]
    branches = []
    if light:
        branch = rows
        for i, choice in light:
            branch = choice.attach(branch, "__value", f"__h{i}")
        if len(light) == 1:
            i = light[0][0]
            branches.append(branch.select(*keep, F.lit(i).alias("hash_id"), F.col(f"__h{i}").alias("h")))
        else:
            pairs = [
                F.struct(F.lit(i).alias("hash_id"), F.col(f"__h{i}").alias("h")) for i, _ in light
            ]
            branches.append(branch.select(*keep, F.inline(F.array(*pairs))))
    for i, choice in heavy:
        branch = choice.attach(rows, "__value", "h")
        branches.append(branch.select(*keep, F.lit(i).alias("hash_id"), "h"))
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def cells_from_hashes(
    rows: DataFrame, keys: Sequence[str], k: int, bitmap: bool = False
) -> DataFrame:
    """``keys, hash_id, idx, rho[, bits]`` from rows with a ready hash column ``h``."""
    projected = rows.select(
        *keys,
        "hash_id",
        b.register_idx(F.col("h"), k).alias("idx"),
        b.register_rho(F.col("h"), k).alias("rho"),
        *([b.bitmap_bit(F.col("h")).alias("bits")] if bitmap else []),
    )
    aggregates = [F.max("rho").alias("rho")]
    if bitmap:
        aggregates.append(F.bit_or("bits").alias("bits"))
    return projected.groupBy(*keys, "hash_id", "idx").agg(*aggregates)


def cells(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    hashes: Sequence[HashChoice],
    k: int,
    bitmap: bool = False,
) -> DataFrame:
    return cells_from_hashes(hashed_rows(df, keys, value, hashes), keys, k, bitmap)


def registers(
    df: DataFrame, keys: Sequence[str], value: str, k: int, choice: HashChoice
) -> DataFrame:
    """``keys, idx, rho`` for one hash and one precision."""
    return cells(df, keys, value, [choice], k).drop("hash_id")


def levels(
    cell_rows: DataFrame,
    keys: Sequence[str],
    k_from: int,
    ks: Sequence[int],
    bitmap: bool = False,
    regroup: bool = False,
) -> DataFrame:
    """Cells re-expressed at every precision of ``ks``, tagged with column ``k``.

    With ``bitmap`` the pseudo level 0 carries the Probabilistic Counting bitmap, in one row
    per key and register of the coarsest level.  Work is proportional to the cells, never to
    the raw rows.  ``regroup`` says that ``keys`` are coarser than those of the cells, so even
    a single level has to merge.

    All registers that fold into one register of the coarsest level share its leading bits.
    So the cells are shuffled once, as they are, by key and those bits, and every level is
    unfolded and merged where its cells already lie.
    """
    wanted = sorted(set(ks))
    if wanted == [k_from] and not bitmap and not regroup:
        return cell_rows.withColumn("k", F.lit(k_from))
    placed = by_coarsest(cell_rows, keys, k_from, wanted)
    projected = unfold(placed, [*keys, COARSEST], k_from, wanted, bitmap)
    aggregates = [F.max("rho").alias("rho")]
    if bitmap:
        aggregates.append(F.bit_or("bits").alias("bits"))
    return projected.groupBy(*keys, COARSEST, "k", "idx").agg(*aggregates).drop(COARSEST)


COARSEST = "__coarsest"


def by_coarsest(
    cell_rows: DataFrame, keys: Sequence[str], k_from: int, ks: Sequence[int]
) -> DataFrame:
    """Cells brought together by key and register of the coarsest precision (``COARSEST``).

    The number of the hash is made part of that column: as a column of its own it is a constant
    where there is one hash only, and a partitioning by a constant is not recognised again.
    """
    lowest = min(ks)
    coarsest = b.reduced_idx(F.col("idx"), k_from, F.lit(lowest)).cast("bigint")
    if "hash_id" in keys:
        coarsest = coarsest + F.col("hash_id") * F.lit(1 << lowest).cast("bigint")
    others = [key for key in keys if key != "hash_id"]
    return cell_rows.withColumn(COARSEST, coarsest).repartition(*others, COARSEST)


def unfold(
    cell_rows: DataFrame,
    keep: Sequence[str],
    k_from: int,
    ks: Sequence[int],
    bitmap: bool = False,
    base_only: Sequence[str] = (),
) -> DataFrame:
    """``keep, k, idx, rho[, bits]``: a row per cell and precision, not merged yet.

    ``base_only`` columns, like the bitmap, are carried by the pseudo level 0 alone.
    """
    all_levels = ([BITMAP_LEVEL] if bitmap else []) + list(ks)
    unfolded = cell_rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in all_levels])))
    is_base = F.col("k") == BITMAP_LEVEL
    idx = b.reduced_idx(F.col("idx"), k_from, F.col("k"))
    rho = b.reduced_rho(F.col("idx"), F.col("rho"), k_from, F.col("k"))
    if bitmap:
        idx = F.when(is_base, F.lit(0)).otherwise(idx)
        rho = F.when(is_base, F.lit(0)).otherwise(rho)
    carried = (["bits"] if bitmap else []) + list(base_only)
    return unfolded.select(
        *keep,
        "k",
        idx.alias("idx"),
        rho.alias("rho"),
        *[F.when(is_base, F.col(name)).alias(name) for name in carried],
    )


def scaled_inverse(rho: Column) -> tuple[Column, Column]:
    """``2**-rho`` as two integers, scaled by 2**31 (rho up to 31) and 2**62 (beyond)."""
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    high = F.when(rho <= INV_SCALE_HIGH, b.shift_left(one, F.lit(INV_SCALE_HIGH) - rho))
    low = F.when(rho > INV_SCALE_HIGH, b.shift_left(one, F.lit(INV_SCALE_LOW) - rho))
    return high.otherwise(none), low.otherwise(none)


def register_terms(rho: Column, k: Column) -> dict[str, Column]:
    """What one register with rank ``rho`` adds to the estimator sums of its key."""
    short = b.rho32(rho, k)
    high, low = scaled_inverse(rho)
    return {
        "occupied": F.lit(1).cast("bigint"),
        "rho_sum": short.cast("bigint"),
        "inv32": scaled_inverse(short)[0],
        "inv_high": high,
        "inv_low": low,
    }


SUMS = ("occupied", "rho_sum", "inv32", "inv_high", "inv_low")


def summarize(level_rows: DataFrame, keys: Sequence[str], bitmap: bool = False) -> DataFrame:
    """Exact integer estimator sums per key and precision."""
    terms = register_terms(F.col("rho"), F.col("k"))
    aggregates = [F.sum(terms[name]).alias(name) for name in SUMS]
    if bitmap:
        aggregates.append(F.bit_or("bits").alias("bits"))
    return level_rows.groupBy(*keys, "k").agg(*aggregates)
