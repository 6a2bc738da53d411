"""Plugging in algorithms of one's own.

An algorithm is four column builders.  ``project`` turns a 64-bit hash into a register and a
state, ``combine`` names the aggregate that merges two states of a register, ``summarize``
folds the registers of a key and ``estimate`` turns that into a number.  Because ``combine``
is a Spark aggregate, building, merging and incremental maintenance all follow from it.

That holds only if ``combine`` obeys three laws, so they are checked before an algorithm is
used: merging a state with itself changes nothing, and neither order nor grouping matters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.hashing import HashChoice, resolve_hash
from tallymark.operators.cells import hashed_rows


@runtime_checkable
class SketchAlgorithm(Protocol):
    """What an algorithm has to offer."""

    name: str

    def project(self, h: Column) -> tuple[Column, Column]:
        """Register index and state of one hashed element."""

    def combine(self, state: Column) -> Column:
        """Aggregate that merges states of the same register; must be idempotent."""

    def summarize(self, idx: Column, state: Column) -> dict[str, Column]:
        """Aggregates over the registers of a key."""

    def estimate(self, summary: dict[str, Column]) -> Column:
        """The estimate from the summary columns."""


LAWS = ("identity", "idempotence", "commutativity", "associativity")
SAMPLE_STATES = 64

_ALGORITHMS: dict[str, SketchAlgorithm] = {}
_LAWFUL: set[str] = set()


def law_violations(
    states: DataFrame, combine: Callable[[Column], Column], key: str
) -> DataFrame:
    """``law, cases, violations``: how often ``combine`` breaks each law on given states.

    ``states`` holds a unique ``key`` and three states ``a``, ``b`` and ``c`` per row; each row
    is one case.  The laws: a state alone stays as it is (identity), merged with itself too
    (idempotence), ``a, b`` equals ``b, a`` (commutativity), and ``a, b`` merged with ``c``
    equals both ``a`` merged with ``b, c`` and all three at once (associativity).  NaN equals
    NaN and null equals null.  States must be comparable, so maps are refused by Spark.  No
    states give three laws without cases and violations.
    """

    def merged(rows: DataFrame, trials: dict[str, Sequence[Column]]) -> DataFrame:
        members = [
            F.struct(F.lit(name).alias("trial"), F.lit(i).alias("place"), state.alias("state"))
            for name, group in trials.items()
            for i, state in enumerate(group)
        ]
        placed = rows.select("__key", F.inline(F.array(*members)))
        # An aggregate that looks at the order of its rows has to meet them in the order stated.
        placed = placed.repartition("__key").sortWithinPartitions("__key", "trial", "place")
        done = placed.groupBy("__key", "trial").agg(combine(F.col("state")).alias("state"))
        of = lambda name: F.max_by("state", F.col("trial") == name)
        return done.groupBy("__key").agg(*[of(name).alias(name) for name in trials])

    a, b, c = F.col("a"), F.col("b"), F.col("c")
    cases = states.select(F.col(key).alias("__key"), "a", "b", "c")
    once = merged(
        cases,
        {"alone": [a], "twice": [a, a], "ab": [a, b], "ba": [b, a], "bc": [b, c], "abc": [a, b, c]},
    )
    both = cases.join(once, "__key")
    again = merged(both, {"left": [F.col("ab"), c], "right": [a, F.col("bc")]})
    same = {
        "identity": F.col("alone").eqNullSafe(a),
        "idempotence": F.col("twice").eqNullSafe(a),
        "commutativity": F.col("ab").eqNullSafe(F.col("ba")),
        "associativity": F.col("left").eqNullSafe(F.col("right"))
        & F.col("left").eqNullSafe(F.col("abc")),
    }
    totals = both.join(again, "__key").agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.count_if(~holds).alias(law) for law, holds in same.items()],
    )
    rows = [F.struct(F.lit(law).alias("law"), "cases", F.col(law).alias("violations")) for law in LAWS]
    return totals.select(F.inline(F.array(*rows)))


def check_laws(spark: SparkSession, algorithm: SketchAlgorithm) -> None:
    """Raise if ``combine`` breaks a law on states of the algorithm's own making."""
    if algorithm.name in _LAWFUL:
        return
    choice = resolve_hash()
    numbers = spark.range(0, SAMPLE_STATES, 1, 1).select(
        F.col("id"),
        *[(F.col("id") * 3 + i).alias(f"__v{i}") for i in range(3)],
    )
    for i in range(3):
        numbers = choice.attach(numbers, f"__v{i}", f"__h{i}")
    states = numbers.select(
        "id", *[algorithm.project(F.col(f"__h{i}"))[1].alias(n) for i, n in enumerate("abc")]
    )
    found = law_violations(states, algorithm.combine, "id").where("violations > 0")
    broken = [row.law for row in found.collect()]
    if broken:
        raise ValueError(f"'combine' of algorithm '{algorithm.name}' breaks: {', '.join(broken)}")
    _LAWFUL.add(algorithm.name)


def register_algorithm(algorithm: SketchAlgorithm) -> SketchAlgorithm:
    """Check the protocol and make the algorithm available by name.

    The laws of ``combine`` are checked at once where a session is active, otherwise when the
    first sketch is built.
    """
    for part in ("project", "combine", "summarize", "estimate"):
        if not callable(getattr(algorithm, part, None)):
            raise ValueError(f"a sketch algorithm needs a method '{part}'")
    if not getattr(algorithm, "name", ""):
        raise ValueError("a sketch algorithm needs a name")
    _LAWFUL.discard(algorithm.name)
    session = SparkSession.getActiveSession()
    if session is not None:
        check_laws(session, algorithm)
    _ALGORITHMS[algorithm.name] = algorithm
    return algorithm


def algorithm_of(name: str) -> SketchAlgorithm:
    if name not in _ALGORITHMS:
        raise ValueError(f"unknown algorithm '{name}'; registered: {sorted(_ALGORITHMS)}")
    return _ALGORITHMS[name]


def build_custom(
    df: DataFrame, keys: Sequence[str], value: str, name: str, choice: HashChoice
) -> DataFrame:
    """``keys, idx, state`` for a registered algorithm."""
    algorithm = algorithm_of(name)
    check_laws(df.sparkSession, algorithm)
    idx, state = algorithm.project(F.col("h"))
    rows = hashed_rows(df, keys, value, [choice]).select(
        *keys, idx.alias("idx"), state.alias("state")
    )
    return rows.groupBy(*keys, "idx").agg(algorithm.combine(F.col("state")).alias("state"))


def merge_custom(registers: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    combined = algorithm_of(name).combine(F.col("state")).alias("state")
    return registers.groupBy(*by, "idx").agg(combined)


def estimate_custom(registers: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    algorithm = algorithm_of(name)
    summary = algorithm.summarize(F.col("idx"), F.col("state"))
    folded = registers.groupBy(*keys).agg(*[c.alias(n) for n, c in summary.items()])
    estimate = algorithm.estimate({n: F.col(n) for n in summary})
    return folded.select(*keys, estimate.alias("estimate"))
