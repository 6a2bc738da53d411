"""Experiment grids: data set sizes, sketch contexts, strategies and preset matrices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.local import local_frame
from tallymark.operators.spec import DEFAULT_K, DEFAULT_STRATEGY, HLLPP_K

# Vocabulary of result columns, and defaults of the experiment grids.
VALIDITIES = ("valid", "recoverable", "invalid")
STRATEGIES = ("reject", "direct", "reduce_then_merge", "unsafe_naive_merge")
TOPOLOGIES = ("pairwise", "balanced_tree", "left_deep_chain", "custom")
DEFAULT_N = (100, 1000, 10000, 100000, 1000000, 10000000)
DEFAULT_RATIOS = (0.01, 0.1, 0.5, 1.0)
DEFAULT_SEEDS = (21041998, 42, 137357, 10032018, 29042026)
DEFAULT_HASH = "splitmix64"

CONTEXT_COLUMNS = (
    "left_hash", "left_hash_seed", "left_k", "right_hash", "right_hash_seed", "right_k",
)


def experiment_grid(
    spark: SparkSession,
    ns: Sequence[int] | DataFrame = DEFAULT_N,
    ratios: Sequence[float] = DEFAULT_RATIOS,
    seeds: Sequence[int] = DEFAULT_SEEDS,
    params: Sequence[str] = ("",),
    hashes: Sequence[str] = (DEFAULT_HASH,),
) -> DataFrame:
    """``n, d, seed, params, hash``: every combination, each d once per n.

    d is ``n * ratio`` rounded half to even and kept within [1, n].  ``ns`` may be a frame
    with a column ``n``, for instance the sizes of the groups of a table.
    """
    for ratio in ratios:
        if not 0.0 < ratio <= 1.0:
            raise ValueError(f"a ratio of distinct values lies in (0, 1], not {ratio}")
    if isinstance(ns, DataFrame):
        sizes = ns.select(F.col("n").cast("bigint")).where(F.col("n") >= 1).distinct()
    else:
        if any(n < 1 for n in ns):
            raise ValueError("a stream has at least one element")
        sizes = local_frame(spark, [(n,) for n in ns], "n bigint")
    grid = sizes
    for name, values in (("ratio", ratios), ("seed", seeds), ("params", params), ("hash", hashes)):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    d = F.greatest(F.lit(1), F.least(F.bround(F.col("n") * F.col("ratio")), F.col("n")))
    seed = F.col("seed").cast("bigint").alias("seed")
    return grid.select("n", d.cast("bigint").alias("d"), seed, "params", "hash").distinct()


def classify(
    same_hash: Column, same_seed: Column, same_params: Column
) -> Column:
    """``valid`` when everything agrees, ``recoverable`` when only parameters differ."""
    return (
        F.when(same_hash & same_seed & same_params, F.lit("valid"))
        .when(same_hash & same_seed, F.lit("recoverable"))
        .otherwise(F.lit("invalid"))
    )


def pair_validity() -> Column:
    """Validity of the pair described by the context columns.

    Equality is textual: hashes that ignore their seed still count as different when their
    seeds differ.
    """
    c = F.col
    return classify(
        c("left_hash") == c("right_hash"),
        c("left_hash_seed") == c("right_hash_seed"),
        c("left_k") == c("right_k"),
    )


def strategy_problem(strategy: Column, validity: Column) -> Column:
    """NULL when the strategy fits the validity, otherwise what it would need."""
    return (
        F.when(strategy == "reject", F.lit(None).cast("string"))
        .when(
            strategy == "direct",
            F.when(validity != "valid", F.lit("direct needs a valid pair")),
        )
        .when(
            strategy == "reduce_then_merge",
            F.when(validity != "recoverable", F.lit("reduce_then_merge needs a recoverable pair")),
        )
        .when(
            strategy == "unsafe_naive_merge",
            F.when(validity == "valid", F.lit("unsafe_naive_merge needs a pair that is not valid")),
        )
        .otherwise(F.concat(F.lit("unknown strategy "), strategy))
    )


def with_validity(pairs: DataFrame) -> DataFrame:
    """Attach ``validity`` and ``problem`` to rows of contexts and a strategy."""
    return pairs.withColumn("validity", pair_validity()).withColumn(
        "problem", strategy_problem(F.col("strategy"), F.col("validity"))
    )


def legal_pairs(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Rows whose strategy is legal; with ``strict`` an illegal row fails the query."""
    judged = with_validity(pairs)
    ok = F.col("problem").isNull()
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.col("problem")).cast("boolean"))
    return judged.where(ok).drop("problem")


def context_pairs(
    spark: SparkSession,
    left: Sequence[tuple[str, int, int]] | DataFrame,
    right: Sequence[tuple[str, int, int]],
    strategies: Sequence[str],
) -> DataFrame:
    """Every left context with every right one and every strategy.

    ``left`` may be a frame ``left_hash, left_hash_seed, left_k`` of any size; the right side is
    a parameter list that each of its rows is unfolded by.
    """
    rights = [
        F.struct(
            F.lit(name).alias("right_hash"),
            F.lit(seed).cast("bigint").alias("right_hash_seed"),
            F.lit(k).alias("right_k"),
        )
        for name, seed, k in right
    ]
    if isinstance(left, DataFrame):
        lefts = left.select("left_hash", "left_hash_seed", "left_k")
    else:
        lefts = local_frame(spark, left, "left_hash string, left_hash_seed bigint, left_k int")
    paired = lefts.select("*", F.inline(F.array(*rights)))
    return paired.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))


DERIVED = "derived"


@dataclass(frozen=True)
class MergeCase:
    """One heterogeneous merge experiment on HyperLogLog++ sketches."""

    left_hash: str
    left_hash_seed: int
    left_k: int
    right_hash: str
    right_hash_seed: int
    right_k: int
    strategy: str = DEFAULT_STRATEGY
    scenario: str = ""
    #: (hash, seed, k) of the sketch over all values; without one it follows from the left side.
    serial: tuple[str, int, int] | None = None
    #: (hash, seed, k) of the merge without mismatch: ``DERIVED`` from the left side, or none.
    baseline: tuple[str, int, int] | str | None = DERIVED

    @property
    def serial_context(self) -> tuple[str, int, int]:
        if self.serial is not None:
            return self.serial
        k = self.target_k if self.validity == "recoverable" else self.left_k
        return self.left_hash, self.left_hash_seed, k

    @property
    def baseline_context(self) -> tuple[str, int, int] | None:
        if self.baseline == DERIVED:
            return self.left_hash, self.left_hash_seed, self.target_k
        return self.baseline

    @property
    def contexts(self) -> list[tuple[str, int, int]]:
        """Every (hash, seed, k) that a sketch of the case is made with."""
        found = [
            (self.left_hash, self.left_hash_seed, self.left_k),
            (self.right_hash, self.right_hash_seed, self.right_k),
            self.serial_context,
        ]
        return found + ([self.baseline_context] if self.baseline_context else [])

    @property
    def validity(self) -> str:
        same_hash = (self.left_hash, self.left_hash_seed) == (
            self.right_hash,
            self.right_hash_seed,
        )
        if same_hash:
            return "valid" if self.left_k == self.right_k else "recoverable"
        return "invalid"

    @property
    def problem(self) -> str | None:
        if self.strategy not in STRATEGIES:
            return f"unknown strategy {self.strategy}"
        needs = {
            "direct": self.validity == "valid",
            "reduce_then_merge": self.validity == "recoverable",
            "unsafe_naive_merge": self.validity != "valid",
        }
        if not needs.get(self.strategy, True):
            return f"{self.strategy} does not fit a pair that is {self.validity}"
        for _, _, k in self.contexts:
            if k not in HLLPP_K:
                return f"precision {k} lies outside [4, 18]"
        if (
            self.strategy == "unsafe_naive_merge"
            and self.validity == "invalid"
            and self.left_k != self.right_k
        ):
            return "sketches of different hashes and precisions cannot be merged at all"
        return None

    @property
    def target_k(self) -> int:
        """Precision both sides are reduced to, and that of the homogeneous baseline."""
        return min(self.left_k, self.right_k)


def merge_case(
    dataset_seed: int,
    hash: str = DEFAULT_HASH,
    k: int = DEFAULT_K,
    strategy: str = DEFAULT_STRATEGY,
    left_hash: str | None = None,
    right_hash: str | None = None,
    left_hash_seed: int | None = None,
    right_hash_seed: int | None = None,
    left_k: int | None = None,
    right_k: int | None = None,
    scenario: str = "",
    serial: tuple[str, int, int] | None = None,
    baseline: tuple[str, int, int] | str | None = DERIVED,
) -> MergeCase:
    """A case in which every side falls back to the common hash, k and data set seed."""
    pick = lambda own, common: common if own is None else own
    return MergeCase(
        pick(left_hash, hash),
        pick(left_hash_seed, dataset_seed),
        pick(left_k, k),
        pick(right_hash, hash),
        pick(right_hash_seed, dataset_seed),
        pick(right_k, k),
        strategy,
        scenario,
        serial,
        baseline,
    )


def hash_mismatch_cases(seed: int, other_seed: int = 17, k: int = 14) -> list[MergeCase]:
    """The hash mismatch matrix: controls, seed and family mismatches in both directions."""
    hashes = ("splitmix64", "xxhash64", "murmurhash3", "siphash24")
    cases = [merge_case(seed, h, k, "direct", scenario="ctrl") for h in hashes]
    forced = ("reject", "unsafe_naive_merge")
    for short, name in (("seed_xx", "xxhash64"), ("seed_murmur", "murmurhash3")):
        for strategy in forced:
            cases.append(
                merge_case(seed, name, k, strategy, right_hash_seed=other_seed, scenario=short)
            )
            cases.append(
                merge_case(
                    seed, name, k, strategy, left_hash_seed=other_seed, scenario=f"{short}_rev"
                )
            )
    for other in ("splitmix64", "murmurhash3", "siphash24"):
        for strategy in forced:
            cases.append(
                merge_case(seed, "xxhash64", k, strategy, right_hash=other, scenario="family")
            )
            cases.append(
                merge_case(seed, "xxhash64", k, strategy, left_hash=other, scenario="family_rev")
            )
    return cases


def precision_mismatch_cases(seed: int, hash: str = "xxhash64") -> list[MergeCase]:
    """The precision mismatch matrix over 10, 14 and 18, in both directions."""
    cases = []
    for left, right in ((10, 14), (14, 10), (10, 18), (18, 10), (14, 18), (18, 14)):
        for strategy in ("reject", "unsafe_naive_merge", "reduce_then_merge"):
            cases.append(
                merge_case(
                    seed, hash, strategy=strategy, left_k=left, right_k=right,
                    scenario=f"{left}->{right}",
                )
            )
    return cases
