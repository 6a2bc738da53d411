import pytest
from pyspark.sql import functions as F

from tallymark.operators.estimate import distinct_estimates
from tallymark.operators.spec import SketchSpec, sketch
from tallymark.operators.statistics import error_statistics
from tallymark.plans.checkpoints import checkpoint_plan, interval_of
from tallymark.plans.prefix import prefix_estimates, prefix_eval, prefix_truth
from tallymark.sources.generators import constant_rho_stream, uniform_stream


def test_plan_cases():
    plan = checkpoint_plan(10**7, 200)
    assert len(plan) == 200 and plan[0] == 1 and plan[-1] == 10**7
    assert sum(t <= 10**5 for t in plan) >= 40 and sum(t >= 10**6 for t in plan) >= 50
    assert checkpoint_plan(1001, 2) == [1, 1001]
    assert checkpoint_plan(10**7, 3) == [1, 2 + (10**7 - 3) // 10, 10**7]
    assert len(checkpoint_plan(1000, 200)) == 200
    assert checkpoint_plan(0) == [] and checkpoint_plan(5, 0) == []
    assert checkpoint_plan(9, 1) == [9] and checkpoint_plan(5) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("n", [201, 333, 1999, 54321])
@pytest.mark.parametrize("budget", [2, 3, 17, 200])
def test_plan_is_strictly_increasing_within_budget(n, budget):
    plan = checkpoint_plan(n, budget)
    assert len(plan) == budget and plan[0] == 1 and plan[-1] == n
    assert all(a < b for a, b in zip(plan, plan[1:]))


def test_interval_lookup(spark):
    points = [1, 4, 9, 20, 50]
    rows = spark.range(1, 60).select("id", interval_of(F.col("id"), points).alias("i")).collect()
    for row in rows:
        later = [i for i, t in enumerate(points) if t >= row.id]
        assert row.i == (later[0] if later else None)


SPECS = [
    sketch("hllpp", 8), sketch("hllpp", 14), sketch("hll", 6, hash="xxhash64", seed=9),
    sketch("ll", 6), sketch("pc", l=10), SketchSpec("naive"),
]


@pytest.mark.parametrize("mode", ["dense", "auto", "sparse"])
def test_prefixes_equal_direct_estimates(spark, mode):
    runs = uniform_stream(spark, 600, 150, 3, 5).cache()
    points = checkpoint_plan(600, 12)
    rows = prefix_estimates(runs, SPECS, points, mode).cache()
    assert rows.count() == 3 * len(SPECS) * len(points)
    for t in (points[1], points[6], points[-1]):
        direct = distinct_estimates(runs.where(F.col("pos") <= t), ["run_id"], "value", SPECS, mode)
        want = {(r.run_id, r.algorithm, r.params, r.hash): r.estimate for r in direct.collect()}
        got = {(r.run_id, r.algorithm, r.params, r.hash): r.estimate
               for r in rows.where(F.col("t") == t).collect()}
        assert got == want


def test_open_lists_are_measured_along_the_stream(spark):
    """Between 4,096 codes and 0.75 m the format depends on the measured list."""
    runs = constant_rho_stream(spark, 16000, 16000, 1, 1).cache()
    points = [4000, 4096, 6000, 9000, 12000, 16000]
    specs = [sketch("hllpp", 15), sketch("hllpp", 16)]
    rows = prefix_estimates(runs, specs, points, "auto").collect()
    for t in points:
        direct = distinct_estimates(runs.where(F.col("pos") <= t), [], "value", specs, "auto")
        want = {r.params: r.estimate for r in direct.collect()}
        assert {r.params: r.estimate for r in rows if r.t == t} == want


@pytest.mark.parametrize("mode", ["dense", "auto", "sparse"])
def test_empty_prefixes_have_rows(spark, mode):
    """Runs that start late, hold nulls only, or have values beyond the last checkpoint only."""
    rows = [(1, 1, None), (1, 2, 7), (1, 3, 7), (1, 4, 8), (2, 1, None), (2, 2, None), (3, 9, 5)]
    runs = spark.createDataFrame(rows, "run_id int, pos bigint, value bigint")
    points = [1, 2, 4]
    got = prefix_estimates(runs, SPECS, points, mode).collect()
    assert len(got) == 3 * len(points) * len(SPECS)
    truth = {(r.run_id, r.t): r.truth for r in got}
    assert truth == {
        (1, 1): 0, (1, 2): 1, (1, 4): 2, **{(run, t): 0 for run in (2, 3) for t in points}
    }
    assert truth == {(r.run_id, r.t): r.truth for r in prefix_truth(runs, points).collect()}
    # the empty sketch: 0, but for the two whose formula has no zero
    empty = {"hllpp": 0, "hll": 0, "naive": 0, "ll": int(0.39701 * 64), "pc": 1}
    assert all(r.estimate == empty[r.algorithm] for r in got if r.truth == 0)
    direct = distinct_estimates(runs.where("run_id = 1"), [], "value", SPECS, mode).collect()
    want = {(r.algorithm, r.params, r.hash): r.estimate for r in direct}
    last = {(r.algorithm, r.params, r.hash): r.estimate for r in got if (r.run_id, r.t) == (1, 4)}
    assert last == want
    stats = prefix_eval(runs, SPECS, 4, mode=mode, checkpoints=points).collect()
    first = [r for r in stats if r.number_of_elements_processed == 1]
    assert len(first) == len(SPECS) and all(r.runs == 3 and r.f0_mean_t == 0 for r in first)


def test_one_exchange_of_cells_serves_all_levels(spark):
    """Levels are unfolded after the shuffle; windows and merges need none of their own."""
    runs = uniform_stream(spark, 600, 150, 3, 5)
    plain = [sketch("hllpp", k) for k in range(4, 15)]
    seeded = [sketch("hll", k, hash="xxhash64", seed=9) for k in (6, 12)]
    for specs in (plain, plain + seeded):
        for frame in (
            prefix_estimates(runs, specs, checkpoint_plan(600, 12)),
            distinct_estimates(runs, ["run_id"], "value", specs),
        ):
            text = frame._jdf.queryExecution().executedPlan().toString()
            lines = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
            assert sum("__coarsest" in line for line in lines) == 1
            assert not any(" idx#" in line and " k#" in line for line in lines)


def test_exact_counter_has_no_error(spark):
    runs = constant_rho_stream(spark, 1000, 100, 4, 3)
    rows = prefix_eval(runs, [SketchSpec("naive")], 1000, seed=3, budget=50).collect()
    assert len(rows) == 50
    assert all(r.mae == 0 and r.rmse == 0 and r.bias == 0 for r in rows)
    last = max(rows, key=lambda r: r.number_of_elements_processed)
    assert last.f0_mean_t == 100 and last.f0 == 100 and last.runs == 4 and last.seed == 3


def test_truth_follows_the_blocks(spark):
    runs = constant_rho_stream(spark, 1000, 100, 2, 3)
    rows = prefix_truth(runs, [1, 10, 11, 500, 1000]).collect()
    assert {(r.t, r.truth) for r in rows} == {(1, 1), (10, 1), (11, 2), (500, 50), (1000, 100)}


def test_error_statistics(spark):
    rows = [("a", 10, 8), ("a", 14, 8), ("b", 5, 0), ("b", 4, 2), ("c", 7, 7)]
    data = spark.createDataFrame(rows, "g string, estimate bigint, truth bigint")
    got = {r.g: r for r in error_statistics(data, ["g"]).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.f0_hat_mean_t, a.f0_mean_t, a.variance, a.bias, a.relative_bias) == (12, 8, 8, 4, 0.5)
    assert (a.mean_relative_error, a.mae, a.rmse) == (0.5, 4, 20**0.5)
    assert a.rse_observed == 8**0.5 / 8
    # A replica without elements adds nothing but counts in the divisor.
    assert b.mean_relative_error == 0.5
    assert c.variance == 0 and c.stddev == 0 and c.rmse == 0
