"""The HyperLogLog++ format rule.

A HyperLogLog++ sketch starts as a sorted list of codes at precision 25 and turns into
dense registers when the compressed list outgrows them.  Here the format is a pure function
of the set: **dense iff there are at least 4,096 codes and their delta-coded list takes more
than 6 bits per register**.  With n codes the list takes between 8n and 40n bits, so the
exact size matters only for at most 0.75 * 2**k codes; larger keys never reach the sort.

Occupied registers bound the number of codes from below, so the registers alone settle most
large keys: those that occupy more than 0.75 * 2**k of them are dense, whatever their codes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import bits as b
from tallymark.functions.bits import SPARSE_PRECISION
from tallymark.functions.local import null_safe_join

# Pending codes before the first size test, bits per dense register.
FLUSH_CODES = 4096
REGISTER_BITS = 6
MODES = ("auto", "dense", "sparse")

#: Registers at this precision can show 4,096 codes and more with registers to spare.
LEAST_LEVEL = 13
#: Keys that are known to be dense and sent to all tasks to spare their codes. They are the
#: largest ones; a key beyond this number has its codes counted, with the same result.
MAX_SETTLED_KEYS = 10_000


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not '{mode}'")
    return mode


def dense_bits(k: Column) -> Column:
    return b.shift_left(F.lit(REGISTER_BITS).cast("bigint"), k)


def is_open(n_codes: Column, k: Column) -> Column:
    """Whether the list has to be measured to know the format."""
    limit = dense_bits(k)
    return (n_codes >= FLUSH_CODES) & (n_codes * 40 > limit) & (n_codes * 8 <= limit)


def open_precisions(ks: Sequence[int]) -> list[int]:
    """Precisions at which any list has to be measured at all (13 and up)."""
    return [k for k in ks if FLUSH_CODES * 8 <= REGISTER_BITS << k]


def is_dense(n_codes: Column, list_bits: Column, k: Column) -> Column:
    size = F.coalesce(list_bits, n_codes * 8)
    return (n_codes >= FLUSH_CODES) & (size > dense_bits(k))


def settled_keys(
    summary: DataFrame, keys: Sequence[str], hashes: int, level: int, k: int
) -> DataFrame:
    """The largest keys whose registers at precision ``level`` prove that they are dense at every
    precision up to ``k``, under all ``hashes`` hashes; ``MAX_SETTLED_KEYS`` rows at most.

    ``summary`` holds ``keys, hash_id, k, occupied, rho_sum, ..``.
    """
    occupied = F.col("occupied")
    proven = (occupied >= FLUSH_CODES) & (occupied * 8 > REGISTER_BITS << k)
    # The bitmap is counted only to keep it alive, so that the cells are those of the estimates.
    alive = F.count("bits") if "bits" in summary.columns else F.lit(0)
    proofs = (
        summary.where((F.col("k") == level) & proven)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__hashes"),
            F.sum("rho_sum").alias("__ranks"),
            alive.alias("__alive"),
        )
        .where(F.col("__hashes") == hashes)
    )
    largest = proofs.orderBy(F.col("__ranks").desc(), "__alive").limit(MAX_SETTLED_KEYS)
    return largest.select(*keys, "__hashes")


def without_settled(df: DataFrame, keys: Sequence[str], settled: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not settled; nothing is shuffled for it."""
    if not keys:
        return df.where(~settled.exists())
    return null_safe_join(df, F.broadcast(settled.select(*keys)), keys, "left_anti")


def code_counts(codes: DataFrame, keys: Sequence[str], out: str = "n_codes") -> DataFrame:
    """Distinct codes per key.

    Counting through ``rho`` keeps the column alive, so this aggregation reads the very same
    shuffle of ``codes`` as the other consumers instead of planning a pruned copy of it.
    """
    return codes.groupBy(*keys).agg(F.sum(F.when(F.col("rho") > 0, 1)).alias(out))


def list_sizes(
    codes: DataFrame, open_groups: DataFrame, keys: Sequence[str], out: str = "list_bits"
) -> DataFrame:
    """Exact list size per open (keys, k).

    ``codes`` holds ``keys, idx, rho`` at precision 25.  Only codes of open groups are
    sorted, each group being bounded by 0.75 * 2**k codes.
    """
    member = null_safe_join(codes, open_groups.select(*keys, "k"), keys, "inner")
    entries = member.select(
        *keys, "k", b.sparse_entry(F.col("idx"), F.col("rho"), F.col("k")).alias("entry")
    )
    previous = F.lag("entry", 1, 0).over(Window.partitionBy(*keys, "k").orderBy("entry"))
    sized = entries.withColumn("__delta", F.col("entry") - previous)
    return sized.groupBy(*keys, "k").agg(F.sum(b.varint_bits(F.col("__delta"))).alias(out))


def with_open_format(
    summary: DataFrame, codes: DataFrame, keys: Sequence[str], ks: Sequence[int]
) -> DataFrame:
    """Attach ``n_codes`` and ``dense`` where only keys that are not settled have ``codes``.

    A key without codes is dense; its ``n_codes`` is null.
    """
    counts = code_counts(codes, keys)
    # The counts ride along as rows of a level of their own.
    placed = summary.unionByName(
        counts.withColumn("k", F.lit(SPARSE_PRECISION)), allowMissingColumns=True
    )
    counted = placed.withColumn(
        "n_codes", F.max("n_codes").over(Window.partitionBy(*keys))
    ).where(F.col("k") != SPARSE_PRECISION)
    settled = F.col("n_codes").isNull()
    candidates = open_precisions(ks)
    if not candidates:
        none = F.lit(None).cast("bigint")
        return counted.withColumn("dense", settled | is_dense(F.col("n_codes"), none, F.col("k")))
    open_groups = counts.withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in candidates]))
    ).where(is_open(F.col("n_codes"), F.col("k")))
    sized = null_safe_join(counted, list_sizes(codes, open_groups, keys), [*keys, "k"], "left")
    dense = settled | is_dense(F.col("n_codes"), F.col("list_bits"), F.col("k"))
    return sized.withColumn("dense", dense).drop("list_bits")


def with_format(
    summary: DataFrame, codes: DataFrame, keys: Sequence[str], ks: Sequence[int]
) -> DataFrame:
    """Attach ``n_codes`` and ``dense`` to a summary whose level 25 counts the codes.

    ``summary`` holds ``keys, k, occupied, ..`` for every precision of ``ks`` and for 25.
    """
    per_key = Window.partitionBy(*keys)
    counted = summary.withColumn(
        "n_codes",
        F.max(F.when(F.col("k") == SPARSE_PRECISION, F.col("occupied"))).over(per_key),
    ).where(F.col("k") != SPARSE_PRECISION)
    candidates = open_precisions(ks)
    if not candidates:
        return counted.withColumn(
            "dense", is_dense(F.col("n_codes"), F.lit(None).cast("bigint"), F.col("k"))
        )
    open_groups = (
        code_counts(codes, keys)
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in candidates])))
        .where(is_open(F.col("n_codes"), F.col("k")))
    )
    sizes = list_sizes(codes, open_groups, keys)
    return (
        null_safe_join(counted, sizes, [*keys, "k"], "left")
        .withColumn("dense", is_dense(F.col("n_codes"), F.col("list_bits"), F.col("k")))
        .drop("list_bits")
    )
