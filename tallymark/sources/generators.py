"""Streams with a known number of distinct values.

Every value is a function of (seed, run, position), so streams are made by independent
tasks, finer than one run, without any shuffle, and come out the same under any layout.
Distinct ids are drawn by a keyed permutation of the id range: a few swap-or-not rounds,
which are a bijection of ``0..n-1`` for any n and need no arithmetic that could overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import wrap64 as w

# Odd multipliers of the per-run seed, and the id range of a 32-bit id.
SEED_FACTOR = 0x9E3779B97F4A7C15
RUN_FACTOR = 0xBF58476D1CE4E5B9
ID_DOMAIN = 1 << 32
ROUNDS = 16


def run_seed(seed: int, run: int) -> int:
    """Seed of one run, as an unsigned 64-bit number."""
    return (seed * SEED_FACTOR + run * RUN_FACTOR) & w.MASK64


def with_run_seed(df: DataFrame, run: str, seed: int, out: str = "run_seed") -> DataFrame:
    """The same per row, carried in a BIGINT."""
    chain = w.Chain(df, out)
    key = chain.let(f"cast(`{run}` as bigint)")
    scaled = chain.let(w.mul_const(key, RUN_FACTOR))
    return chain.finish(out, w.add_const(scaled, seed * SEED_FACTOR))


def permute(
    df: DataFrame, x: str, size: str, key: str, salt: int, out: str, rounds: int = ROUNDS
) -> DataFrame:
    """Attach ``out``: the image of ``x`` under a permutation of ``0..size-1`` keyed by ``key``.

    Each round pairs x with ``(k - x) mod size`` and swaps the pair if a hash bit of its
    larger member says so; both members see the same bit, hence the map is one to one.
    ``size`` and ``key`` are columns, so every run may have its own.
    """
    chain = w.Chain(df, out)
    at = chain.let(f"cast(`{x}` as bigint)")
    for i in range(rounds):
        mark = f"{salt * 1000 + i}L"
        pivot = f"pmod(xxhash64(`{key}`, {mark}), `{size}`)"
        partner = chain.let(f"pmod({pivot} - {at}, `{size}`)")
        bit = f"xxhash64(`{key}`, -1L, {mark}, greatest({at}, {partner})) & 1L"
        at = chain.let(f"if(({bit}) = 1, {partner}, {at})")
    return chain.finish(out, at)


#: What the shape of a stream has to keep to, and what is said where it does not.
UNIFORM_RULES = {
    "distinct values have to fit the 32-bit id range": lambda n, d, p: d <= ID_DOMAIN,
    "there cannot be more distinct values than elements": lambda n, d, p: d <= n,
    "a stream with elements has at least one distinct value": lambda n, d, p: d > 0 or n <= 0,
    "n and d cannot be negative": lambda n, d, p: min(n, d) >= 0,
    "there has to be at least one run": lambda n, d, p: p >= 1,
}
CONSTANT_RHO_RULES = UNIFORM_RULES | {
    "n and d have to be positive": lambda n, d, p: min(n, d) > 0,
    "n has to be a multiple of d": lambda n, d, p: d <= 0 or n % d == 0,
}


def _check(rules: dict, n: int, d: int, p: int) -> None:
    broken = [said for said, holds in rules.items() if not holds(n, d, p)]
    if broken:
        raise ValueError("; ".join(broken))


def check_uniform(n: int, d: int, p: int) -> None:
    _check(UNIFORM_RULES, n, d, p)


def check_constant_rho(n: int, d: int, p: int) -> None:
    _check(CONSTANT_RHO_RULES, n, d, p)


def positions(spark: SparkSession, n: int, p: int) -> DataFrame:
    """``run_id, pos`` for p runs of n elements."""
    ids = spark.range(n * p)
    if n == 0:
        return ids.select(F.lit(0).alias("run_id"), F.col("id").alias("pos"))
    return ids.select(
        F.expr(f"cast(id div {n} as int)").alias("run_id"),
        (F.pmod(F.col("id"), F.lit(n)) + 1).alias("pos"),
    )


def _number(value: int | Column) -> Column:
    return value.cast("bigint") if isinstance(value, Column) else F.lit(value).cast("bigint")


def _prepared(places: DataFrame, n: int | Column, d: int | Column, seed: int) -> DataFrame:
    sized = places.withColumns({"__n": _number(n), "__d": _number(d)})
    sized = sized.withColumns(
        {
            "__domain": F.least(F.col("__n"), F.lit(ID_DOMAIN)),
            "__at": F.col("pos").cast("bigint") - 1,
        }
    )
    return with_run_seed(sized, "run_id", seed, "__seed")


_HELPERS = ("__n", "__d", "__domain", "__at", "__seed")


def uniform_values(
    places: DataFrame, n: int | Column, d: int | Column, seed: int
) -> DataFrame:
    """Attach ``value`` so that every run has exactly d distinct ids among its n elements.

    d positions chosen by one permutation carry one id each; all others draw an id
    uniformly.  ``places`` holds ``run_id`` and ``pos`` (1..n).
    """
    ready = _prepared(places, n, d, seed)
    ranked = permute(ready, "__at", "__n", "__seed", 1, "__rank")
    draw = F.pmod(F.xxhash64(F.col("__seed"), F.lit(7).cast("bigint"), F.col("__at")), F.col("__d"))
    sourced = ranked.withColumn(
        "__src", F.when(F.col("__rank") < F.col("__d"), F.col("__rank")).otherwise(draw)
    )
    valued = permute(sourced, "__src", "__domain", "__seed", 2, "value")
    return valued.drop(*_HELPERS, "__rank", "__src")


def constant_rho_values(
    places: DataFrame, n: int | Column, d: int | Column, seed: int
) -> DataFrame:
    """Attach ``value`` and ``is_new``: one new id every n/d positions, so F0(j n/d) = j.

    The other elements of block j repeat one of the j+1 ids seen so far, uniformly.
    """
    ready = _prepared(places, n, d, seed)
    blocks = ready.withColumn("__rho", F.expr("__n div __d")).withColumns(
        {
            "__block": F.expr("__at div __rho"),
            "is_new": F.col("__at") % F.col("__rho") == 0,
        }
    )
    draw = F.pmod(
        F.xxhash64(F.col("__seed"), F.lit(7).cast("bigint"), F.col("__at")), F.col("__block") + 1
    )
    sourced = blocks.withColumn(
        "__src", F.when(F.col("is_new"), F.col("__block")).otherwise(draw)
    )
    valued = permute(sourced, "__src", "__domain", "__seed", 2, "value")
    kept = [c for c in places.columns]
    return valued.select(*kept, "value", "is_new")


def uniform_stream(spark: SparkSession, n: int, d: int, p: int, seed: int) -> DataFrame:
    """``run_id, pos, value``: p uniform runs of n elements and d distinct ids each."""
    check_uniform(n, d, p)
    return uniform_values(positions(spark, n, p), n, max(d, 1), seed)


def constant_rho_stream(spark: SparkSession, n: int, d: int, p: int, seed: int) -> DataFrame:
    """``run_id, pos, value, is_new``: p runs in which a new id comes every n/d elements."""
    check_constant_rho(n, d, p)
    return constant_rho_values(positions(spark, n, p), n, d, seed)
