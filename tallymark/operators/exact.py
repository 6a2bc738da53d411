"""Exact distinct counts, first occurrences, profiles and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def exact_distinct(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "exact"
) -> DataFrame:
    """Distinct non-null values per key.

    Values are de-duplicated map-side and shuffled by (key, value), so one heavy key is
    spread over all tasks; only counts travel in the second shuffle.
    """
    return df.groupBy(*keys).agg(F.count_distinct(value).alias(out))


def exact_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The exact sketch: one row per distinct (key, value)."""
    return df.where(F.col(value).isNotNull()).select(*keys, value).distinct()


def exact_union(
    sketches: DataFrame, by: Sequence[str], value: str, out: str = "exact"
) -> DataFrame:
    """Distinct count of the union of exact sketches, by any coarser key."""
    return exact_distinct(sketches, by, value, out)


def dense_distinct(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "exact"
) -> DataFrame:
    """Exact distinct count of densely packed ids through fixed-size bitmaps.

    Ids are cut into buckets of 32,768; each bucket is a 4 KiB bitmap, whatever the number
    of rows.  Cheaper than shuffling the values where most ids of a bucket occur.
    """
    bitmaps = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(value).alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("__map"))
    )
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("__map")).alias(out))


def first_occurrences(
    runs: DataFrame, keys: Sequence[str] = ("run_id",), value: str = "value", pos: str = "pos"
) -> DataFrame:
    """One row per distinct (key, value) with the position of its first occurrence."""
    return (
        runs.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.min(pos).alias("first_pos"))
    )


def with_truth_bit(
    runs: DataFrame, keys: Sequence[str] = ("run_id",), value: str = "value", pos: str = "pos"
) -> DataFrame:
    """Attach ``is_new``: whether a position is the first occurrence of its value.

    First positions are unique per key, so the flag is looked up by (key, pos), which stays
    evenly spread even where one value fills a third of a run.
    """
    first = first_occurrences(runs, keys, value, pos).select(
        *keys, F.col("first_pos").alias(pos), F.lit(True).alias("__new")
    )
    flagged = runs.join(first, [*keys, pos], "left")
    return flagged.select(
        *runs.columns, F.coalesce(F.col("__new"), F.lit(False)).alias("is_new")
    )


def dataset_profile(
    runs: DataFrame, run: str = "run_id", value: str = "value", seed: int | None = None
) -> DataFrame:
    """One row: number of runs, elements per run and distinct values per run.

    ``count(*)`` is split from the distinct count so that no row is multiplied.
    """
    per_run = run_sizes(runs, run, value)
    return per_run.agg(
        F.count(F.lit(1)).alias("runs"),
        F.max("n").alias("sample_size"),
        F.max("d").alias("f0"),
        F.lit(seed).cast("bigint").alias("seed"),
    )


def run_sizes(runs: DataFrame, run: str = "run_id", value: str = "value") -> DataFrame:
    """Elements ``n`` and distinct values ``d`` of every run, from one shuffle by value."""
    per_value = runs.groupBy(run, value).agg(F.count(F.lit(1)).alias("__times"))
    return per_value.groupBy(run).agg(
        F.sum("__times").alias("n"), F.count(value).alias("d")
    )


def integrity_violations(
    runs: DataFrame,
    n: int | None = None,
    d: int | None = None,
    run: str = "run_id",
    value: str = "value",
    is_new: str | None = "is_new",
) -> DataFrame:
    """Rows ``(run_id, rule, expected, actual)`` for every broken rule; empty when clean.

    Every run must hold ``n`` elements and ``d`` distinct ones (by default: those of the
    largest run), truth bits must add up to the distinct count, and ids must fit 32 bits.
    """
    flag = F.col(is_new).cast("bigint") if is_new else F.lit(None).cast("bigint")
    per_value = runs.groupBy(run, value).agg(
        F.count(F.lit(1)).alias("__times"), F.sum(flag).alias("__new")
    )
    sizes = per_value.groupBy(run).agg(
        F.sum("__times").alias("n"),
        F.count(value).alias("d"),
        F.sum("__new").alias("new"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    if n is None or d is None:
        totals = sizes.agg(F.max("n").alias("want_n"), F.max("d").alias("want_d"))
        want_n = totals.select("want_n").scalar() if n is None else F.lit(n)
        want_d = totals.select("want_d").scalar() if d is None else F.lit(d)
    else:
        want_n, want_d = F.lit(n), F.lit(d)

    def rule(name: str, expected, actual, broken):
        entry = F.struct(
            F.lit(name).alias("rule"),
            expected.cast("bigint").alias("expected"),
            actual.cast("bigint").alias("actual"),
        )
        return F.when(broken, entry)

    wanted = sizes.withColumns({"want_n": want_n, "want_d": want_d})
    c = F.col
    rules = [
        rule("elements per run", c("want_n"), c("n"), c("n") != c("want_n")),
        rule("distinct per run", c("want_d"), c("d"), c("d") != c("want_d")),
        rule("distinct at most elements", c("n"), c("d"), c("d") > c("n")),
        rule("id at least 0", F.lit(0), c("low"), c("low") < 0),
        rule("id fits 32 bits", F.lit((1 << 32) - 1), c("high"), c("high") >= 1 << 32),
    ]
    if is_new:
        rules.append(rule("truth bits", c("d"), c("new"), c("new") != c("d")))
    broken = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return wanted.select(run, F.explode(broken).alias("v")).select(run, "v.*")


def select_runs(runs: DataFrame, ids: Sequence[int], run: str = "run_id") -> DataFrame:
    """The named runs; the filter reaches the scan (or prunes partitions)."""
    return runs.where(F.col(run).isin(*ids))


def pair_runs(runs: DataFrame, run_count: int | None = None, run: str = "run_id") -> DataFrame:
    """Attach ``pair_index`` and ``side`` for runs 2i and 2i+1; an odd last run is dropped.

    Without ``run_count`` the number of runs is taken from the highest run id.
    """
    if run_count is None:
        pairs = runs.select(F.floor((F.max(run) + 1) / 2).cast("bigint")).scalar()
    else:
        pairs = F.lit(run_count // 2)
    paired = runs.withColumns(
        {
            "pair_index": F.floor(F.col(run) / 2).cast("int"),
            "side": F.pmod(F.col(run), F.lit(2)).cast("int"),
        }
    )
    return paired.where(F.col("pair_index") < pairs)


def pair_values(paired: DataFrame, value: str = "value") -> DataFrame:
    """Distinct non-null values of every pair: ``pair_index, value, in_left, in_right``.

    One shuffle by (pair, value), so a heavy pair is spread over all tasks.  Whatever is
    derived from it shares that shuffle, and so one reading of the raw rows, as long as it
    uses both flags; see :func:`exact_pair_union`.
    """
    on_side = lambda side: F.max(F.col("side") == side)
    return (
        paired.where(F.col(value).isNotNull())
        .groupBy("pair_index", F.col(value).alias("value"))
        .agg(on_side(0).alias("in_left"), on_side(1).alias("in_right"))
    )


def exact_pair_union(values: DataFrame, out: str = "exact_union") -> DataFrame:
    """Size of the union of both sides per pair, from :func:`pair_values`."""
    return values.groupBy("pair_index").agg(F.count_if(F.col("in_left") | F.col("in_right")).alias(out))
