"""What the plans have to look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import checks.sketch_queries  # noqa: F401
from checks.registry import QUERIES
from tallymark.functions.hashing import resolve_hash
from tallymark.operators.cells import cells, levels, summarize
from tallymark.operators.estimate import distinct_estimates
from tallymark.operators.exact import exact_distinct
from tallymark.operators.sketches import build_sketches, estimate_sketches, merge_sketches
from tallymark.operators.sparse import settled_keys, without_settled
from tallymark.operators.spec import SketchSpec, sketch
from tallymark.plans.checkpoints import checkpoint_plan
from tallymark.plans.grid import hash_mismatch_cases
from tallymark.plans import reports
from tallymark.plans.merge_eval import heterogeneous_eval, merge_eval
from tallymark.plans.prefix import prefix_estimates


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")


def test_scan_reads_two_columns_and_pushes_the_null_filter(lines):
    text = plan(distinct_estimates(lines, ["l_returnflag"], "l_orderkey", [sketch("hll", 12)]))
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in text


def test_registers_are_combined_before_the_shuffle(lines):
    text = plan(distinct_estimates(lines, ["l_returnflag"], "l_orderkey", [sketch("hll", 12)]))
    assert "partial_max" in text
    # Shuffled by key and register, so that one heavy key is spread.
    assert "hashpartitioning(l_returnflag" in text and "idx" in text.split("hashpartitioning(")[2]
    assert text.count("Exchange hashpartitioning") == 2
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_a_sweep_reads_the_data_once(lines):
    specs = [sketch(a, k) for a in ("hllpp", "hll", "ll") for k in (4, 9, 14)] + [sketch("pc", l=9)]
    text = plan(distinct_estimates(lines, ["l_returnflag"], "l_orderkey", specs))
    assert text.count("FileScan") == 1 and "Cartesian" not in text and "NestedLoop" not in text


def test_sparse_mode_makes_no_registers_of_codes(lines):
    """A task holds each of its codes once, not once more as a register and once more per merge."""
    text = plan(distinct_estimates(lines, ["l_suppkey"], "l_orderkey", [sketch("hllpp", 14)], "sparse"))
    assert "__coarsest" not in text and "Window" not in text and "rho" not in text
    assert text.count("Exchange hashpartitioning") == 2 and text.count("HashAggregate") == 4

    # other algorithms keep their own precision
    specs = [sketch("hllpp", 9), sketch("hllpp", 14), sketch("ll", 6), sketch("pc", l=9)]
    both = distinct_estimates(lines, ["l_returnflag"], "l_orderkey", specs, "sparse")
    apart = [
        row
        for spec in specs
        for row in distinct_estimates(lines, ["l_returnflag"], "l_orderkey", [spec], "sparse").collect()
    ]
    assert sorted(map(str, both.collect())) == sorted(map(str, apart))


def test_auto_mode_fetches_codes_of_open_keys_only(spark):
    """The registers settle the large keys, so their codes are neither shuffled nor counted."""
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") < 50_000, F.lit("hot")).when(F.col("id") < 53_000, F.lit("few")).alias("g"),
        F.col("id").alias("v"),
    )
    choice = [resolve_hash()]
    registers = cells(rows, ["g"], "v", choice, 14)
    group = ["g", "hash_id"]
    summary = summarize(levels(registers, group, 14, [14]), group)
    settled = settled_keys(summary, ["g"], 1, 14, 14)
    assert [r.g for r in settled.collect()] == ["hot"]
    left = cells(without_settled(rows, ["g"], settled), ["g"], "v", choice, 25)
    counts = {r.g: r["count"] for r in left.groupBy("g").count().collect()}
    assert set(counts) == {"few", None}
    assert counts["few"] <= 3_000 and 6_000 < counts[None] <= 7_000

    frame = distinct_estimates(rows, ["g"], "v", [sketch("hllpp", 14)], "auto")
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    assert "LeftAnti" in final and "ReusedExchange" in final
    assert "Cartesian" not in final and "NestedLoop" not in final


def test_auto_mode_without_keys(spark):
    """The one sketch of a whole table is settled as well."""
    rows = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("v"))
    specs = [sketch("hllpp", 12), sketch("hllpp", 14)]
    auto = distinct_estimates(rows, [], "v", specs, "auto")
    dense = distinct_estimates(rows, [], "v", specs, "dense")
    assert sorted(auto.collect()) == sorted(dense.collect())
    assert "Cartesian" not in plan(auto)


def test_no_cross_joins_in_evaluations(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    runs = orders.select(
        (F.col("o_orderkey") % 10).cast("int").alias("run_id"),
        (F.expr("o_orderkey div 10") + 1).alias("pos"),
        F.col("o_custkey").alias("value"),
    )
    specs = [sketch("hllpp", 10), sketch("pc", l=9), SketchSpec("naive")]
    for frame in (
        prefix_estimates(runs, specs, checkpoint_plan(150, 20)),
        heterogeneous_eval(runs, hash_mismatch_cases(1), 150, 1),
    ):
        assert "Cartesian" not in plan(frame) and "NestedLoop" not in plan(frame)


def test_one_heavy_key(spark):
    """A key with most of the rows leaves at most 2**k rows per task for the shuffle."""
    rows = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
        (F.col("id") % 100_000).alias("value"),
    )
    frame = distinct_estimates(rows, ["key"], "value", [sketch("hllpp", 8)])
    hot = frame.where("key = 'hot'").first().estimate
    exact = exact_distinct(rows, ["key"], "value").where("key = 'hot'").first().exact
    assert exact == 90_000 and abs(hot - exact) < 4 * 0.065 * exact
    registers = cells(rows.where("key = 'hot'"), ["key"], "value", [resolve_hash()], 8)
    assert registers.count() == 256


def test_integer_sums_do_not_depend_on_partitioning(spark):
    rows = spark.range(50_000).withColumn("key", F.col("id") % 3)
    spec = [sketch("hllpp", 12), sketch("hll", 12), sketch("ll", 12), sketch("pc", l=31)]
    results = {
        tuple(sorted(map(tuple, distinct_estimates(part, ["key"], "id", spec).collect())))
        for part in (rows.coalesce(1), rows.repartition(13), rows.orderBy(F.desc("id")))
    }
    assert len(results) == 1


def test_heavy_hashes_get_a_branch_each(spark):
    choices = [resolve_hash(n, 1) for n in ("xxhash64", "splitmix64", "murmurhash3")]
    text = plan(cells(spark.range(100), [], "id", choices, 10))
    assert "Union" in text
    got = cells(spark.range(100), [], "id", choices, 10).groupBy("hash_id").count().count()
    assert got == 3


def final_plan(df):
    """The plan as it ran, subqueries included, without the plans it started from."""
    df.collect()
    kept, skipped = [], None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :"))
        if skipped is not None and depth > skipped:
            continue
        skipped = depth if "== Initial Plan ==" in line else None
        if skipped is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def order_runs(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    return orders.select(
        (F.col("o_orderkey") % 10).cast("int").alias("run_id"), F.col("o_custkey").alias("value")
    )


def test_evaluations_of_many_hashes_read_the_rows_once(order_runs):
    cases = hash_mismatch_cases(42)
    text = final_plan(heterogeneous_eval(order_runs, cases, 0, 42, run_count=10))
    # all branches and the subquery that counts the pairs reuse one shuffle of distinct values
    assert text.count("FileScan") == 1 and text.count("ReusedExchange") >= 4
    specs = [sketch("hllpp", 10, hash=h, seed=1) for h in ("splitmix64", "murmurhash3", "siphash24")]
    text = final_plan(merge_eval(order_runs, specs, 0, run_count=10))
    assert text.count("FileScan") == 1 and text.count("ReusedExchange") >= 3


def test_rollup_does_not_merge_beside_the_building(spark, sf_dir):
    """Sketches of neighbours hardly meet in the tasks that built them: rows go on as they are."""
    # from the scan: cells by register (two aggregates), then a shuffle, before anything is merged or unfolded
    above = plan(QUERIES["mrg12_rollup"](spark, sf_dir)).split("FileScan")[0]
    steps = re.findall(r"\b(HashAggregate|Exchange|Generate inline)", above)[::-1]
    assert steps[:4] == ["HashAggregate", "Exchange", "HashAggregate", "Exchange"]


def test_verified_merge_builds_its_sketches_once(lines):
    sketches = build_sketches(lines, ["l_returnflag", "l_linestatus"], "l_orderkey", sketch("hllpp", 12))
    frame = estimate_sketches(merge_sketches(sketches, ["l_returnflag"]), ["l_returnflag"], "dense", ks=[12])
    text = final_plan(frame)
    assert "ReusedExchange" in text and text.count("FileScan") == 1


def test_bias_is_no_nested_loop(lines):
    for ks in ([12], [10, 14]):
        text = plan(distinct_estimates(lines, ["l_returnflag"], "l_orderkey", [sketch("hllpp", k) for k in ks]))
        assert "NestedLoop" not in text and "BroadcastHashJoin" in text


def test_reports_hold_no_group_in_a_task(order_runs):
    pairs = heterogeneous_eval(order_runs, hash_mismatch_cases(42)[:4], 0, 42, run_count=10)
    text = plan(reports.hash_mismatch_global(pairs))
    assert "median(" not in text and "percentile(" not in text and "percentile_approx(" in text
