import math

import pytest
from pyspark.sql import functions as F

from tallymark.operators.exact import pair_runs
from tallymark.operators.spec import SketchSpec, sketch
from tallymark.operators.statistics import finite_summary, group_medians, pair_summary
from tallymark.plans.grid import (
    MergeCase,
    context_pairs,
    experiment_grid,
    hash_mismatch_cases,
    legal_pairs,
    merge_case,
    precision_mismatch_cases,
)
from tallymark.plans.merge_eval import heterogeneous_eval, merge_eval
from tallymark.sources.generators import uniform_stream

SPECS = [sketch("hllpp", 10), sketch("hll", 9), sketch("ll", 7), sketch("pc", l=12), SketchSpec("naive")]


@pytest.fixture(scope="module")
def runs(spark):
    """Five strongly overlapping runs: 1,800 of 2,000 ids each; the fifth has no partner."""
    return uniform_stream(spark, 2000, 1800, 5, 11).cache()


@pytest.mark.parametrize("mode", ["dense", "auto"])
def test_merge_equals_serial(runs, mode):
    rows = merge_eval(runs, SPECS, 2000, seed=11, mode=mode).collect()
    assert len(rows) == 2 * len(SPECS) and {r.pair_index for r in rows} == {0, 1}
    assert all(r.delta_merge_serial_abs == 0 and r.delta_merge_serial_rel == 0 for r in rows)
    assert all(r.pairs == 2 and r.mode == "merge" for r in rows)
    exact = {r.pair_index: r.estimate_merge for r in rows if r.algorithm == "Naive"}
    for r in rows:
        if r.algorithm == "HyperLogLog++":
            assert abs(r.estimate_merge - exact[r.pair_index]) < 0.1 * exact[r.pair_index]


def test_pairing(spark, runs):
    assert pair_runs(runs).select("pair_index").distinct().count() == 2
    assert pair_runs(runs, run_count=3).select("pair_index").distinct().count() == 1
    assert pair_runs(runs.where("run_id = 0")).count() == 0
    with_one = merge_eval(runs.where("run_id = 0"), SPECS, 2000)
    assert with_one.count() == 0


def test_strategies(runs):
    cases = [
        merge_case(1, "xxhash64", 10, "direct", scenario="direct"),
        merge_case(1, "xxhash64", 10, "reject", scenario="reject"),
        merge_case(1, "xxhash64", 10, "unsafe_naive_merge", right_hash_seed=2, scenario="seed"),
        merge_case(1, left_k=12, right_k=8, strategy="reduce_then_merge", scenario="reduce"),
        merge_case(1, left_k=12, right_k=8, strategy="unsafe_naive_merge", scenario="naive"),
    ]
    for mode in ("dense", "auto"):
        rows = heterogeneous_eval(runs, cases, 2000, 1, mode=mode).collect()
        assert len(rows) == 10
        of = lambda name: [r for r in rows if r.scenario == name]
        for r in of("direct"):
            assert r.delta_vs_baseline == 0 and r.estimate_merge == r.estimate_serial
            assert r.validity == "valid"
        for r in of("reject"):
            assert math.isnan(r.estimate_merge) and math.isnan(r.error_merge_rel_exact)
            assert r.estimate_serial > 0 and r.exact_union > 0
        for r in of("seed"):
            # As if the two sets were disjoint.
            overlap = (2 * 1800 - r.exact_union) / r.exact_union
            assert abs(r.error_merge_rel_exact - overlap) < 0.15
            assert r.validity == "invalid"
        for r in of("reduce"):
            assert r.validity == "recoverable"
            if mode == "dense":
                assert r.delta_vs_baseline == 0 and r.estimate_merge == r.estimate_serial
        assert any(r.delta_vs_baseline > 0 for r in of("naive"))


def test_seedless_hashes_show_no_damage(runs):
    cases = [merge_case(1, "splitmix64", 10, "unsafe_naive_merge", right_hash_seed=2)]
    for r in heterogeneous_eval(runs, cases, 2000, 1).collect():
        assert r.validity == "invalid" and r.delta_vs_baseline == 0


def test_illegal_strategies(spark, runs):
    bad = [
        merge_case(1, "xxhash64", 10, "direct", right_hash_seed=2),
        merge_case(1, strategy="reduce_then_merge"),
        merge_case(1, strategy="unsafe_naive_merge"),
        merge_case(1, strategy="other"),
        MergeCase("xxhash64", 1, 10, "xxhash64", 2, 12, "unsafe_naive_merge"),
        merge_case(1, k=3),
    ]
    for case in bad:
        with pytest.raises(ValueError):
            heterogeneous_eval(runs, [case], 2000, 1)


def test_presets():
    hashes = hash_mismatch_cases(42)
    assert len(hashes) == 24 and all(c.problem is None for c in hashes)
    assert sum(c.scenario == "ctrl" for c in hashes) == 4
    assert all(c.validity == "valid" for c in hashes if c.scenario == "ctrl")
    precisions = precision_mismatch_cases(42)
    assert len(precisions) == 18 and {c.validity for c in precisions} == {"recoverable"}
    default = merge_case(7)
    assert (default.left_hash, default.left_hash_seed, default.left_k) == ("splitmix64", 7, 16)
    assert default.strategy == "direct" and default.target_k == 16


def test_legal_pairs(spark):
    contexts = [("xxhash64", 1, 10), ("xxhash64", 1, 12), ("siphash24", 1, 10)]
    every = context_pairs(
        spark, contexts, contexts, ["reject", "direct", "reduce_then_merge", "unsafe_naive_merge"]
    )
    assert every.count() == 36
    rows = legal_pairs(every).collect()
    count = lambda s: sum(r.strategy == s for r in rows)
    assert (count("reject"), count("direct"), count("reduce_then_merge"),
            count("unsafe_naive_merge")) == (9, 3, 2, 6)
    with pytest.raises(Exception, match="needs a"):
        legal_pairs(every, strict=True).count()


def test_experiment_grid(spark):
    rows = experiment_grid(spark, [1, 10, 100], [0.01, 0.1, 0.5, 1.0], [1, 2]).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.n, set()).add(r.d)
    assert sizes == {1: {1}, 10: {1, 5, 10}, 100: {1, 10, 50, 100}}
    assert len(rows) == 16
    for bad in ([0.0], [1.5]):
        with pytest.raises(ValueError):
            experiment_grid(spark, [10], bad)


def test_summaries(spark, runs):
    empty = merge_eval(runs.where("run_id = 0"), SPECS, 2000)
    row = pair_summary(empty).first()
    assert row.pairs == 0 and row.delta_abs_max == 0 and row.estimate_merge_mean == 0
    data = spark.createDataFrame(
        [("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", float("nan"))], "g string, x double"
    )
    got = {r.g: r for r in finite_summary(data, ["g"], ["x"]).collect()}
    assert got["a"].x_mean == 2 and got["a"].x_finite == 2
    assert math.isnan(got["b"].x_mean) and got["b"].x_finite == 0


def test_references_of_their_own(runs):
    cases = [
        merge_case(1, "xxhash64", 10, "direct", scenario="none", baseline=None),
        merge_case(
            1, "xxhash64", 10, "direct", scenario="own",
            serial=("siphash24", 5, 12), baseline=("murmurhash3", 3, 9),
        ),
        merge_case(1, "siphash24", 12, "direct", right_hash_seed=5, left_hash_seed=5, scenario="siphash"),
        merge_case(1, "murmurhash3", 9, "direct", right_hash_seed=3, left_hash_seed=3, scenario="murmur"),
    ]
    rows = {(r.scenario, r.pair_index): r for r in heterogeneous_eval(runs, cases, 2000, 1).collect()}
    for pair in (0, 1):
        none, own = rows["none", pair], rows["own", pair]
        assert math.isnan(none.baseline_homogeneous) and math.isnan(none.delta_vs_baseline)
        assert none.estimate_merge == none.estimate_serial == own.estimate_merge
        assert own.estimate_serial == rows["siphash", pair].estimate_serial != own.estimate_merge
        assert own.baseline_homogeneous == rows["murmur", pair].estimate_merge
        assert own.delta_vs_baseline == abs(own.estimate_merge - own.baseline_homogeneous)
    with pytest.raises(ValueError):
        heterogeneous_eval(runs, [merge_case(1, baseline=("xxhash64", 1, 3))], 2000, 1)


def test_a_wrong_merge_is_told_from_its_serial_sketch(spark):
    from tallymark.plans.reports import consistency_checks

    # the two sides differ, so a merge that is not reduced properly does not equal the serial sketch
    one = spark.range(3000).selectExpr("0 AS run_id", "id AS value")
    two = spark.range(1000, 9000).selectExpr("1 AS run_id", "id AS value")
    cases = [merge_case(1, left_k=12, right_k=8, strategy=s) for s in ("reduce_then_merge", "unsafe_naive_merge")]
    found = heterogeneous_eval(one.union(two), cases, 0, 1)
    checks = {r.check: r.value for r in consistency_checks(found).collect()}
    assert all(checks.values())
    swapped = found.withColumn("strategy", F.lit("reduce_then_merge"))
    assert not all(r.value for r in consistency_checks(swapped).collect())


@pytest.mark.parametrize("cuts", [2, 4, 256])
def test_medians(spark, cuts):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 500 == 0, F.lit(None)).otherwise(F.lit("b")).alias("g"),
        F.when(F.col("id") % 11 > 0, F.pow(F.rand(3) * 10 - 5, F.lit(3))).when(F.col("id") % 2 == 0, 1.5).alias("x"),
    )
    rows = rows.union(spark.createDataFrame([("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)], rows.schema)).cache()
    want = {r.g: r.m for r in rows.groupBy("g").agg(F.median("x").alias("m")).where("m IS NOT NULL").collect()}
    got = {r.g: r.median for r in group_medians(rows, ["g"], "x", cuts=cuts).collect()}
    assert len(want) == 5 and got == want
    assert group_medians(rows, [], "x", cuts=cuts).first().median == rows.agg(F.median("x")).first()[0]
