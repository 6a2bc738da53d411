import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions.bias import (
    bias_windows,
    expected_bias_points,
    load_bias_points,
    published_bias_points,
)
from tallymark.functions.hashing import resolve_hash
from tallymark.operators.cells import registers
from tallymark.operators.estimate import distinct_estimates
from tallymark.operators.exact import dense_distinct, exact_distinct
from tallymark.operators.sparse import check_mode
from tallymark.operators.spec import SketchSpec, requested_algorithms, sketch, sweep_specs
from tests import emulation


def frame(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v bigint")


def one(spark, values, spec, mode="dense", **options):
    rows = distinct_estimates(frame(spark, {"a": values}), ["g"], "v", [spec], mode, **options)
    return rows.first().estimate


@pytest.mark.parametrize("n", [1, 10, 300, 5000])
def test_against_emulation(spark, n):
    values = random.Random(n).sample(range(1 << 32), n)
    specs = [sketch("ll", 6), sketch("hll", 4), sketch("hll", 9), sketch("pc", l=9), sketch("pc", l=31)]
    got = distinct_estimates(frame(spark, {"a": values}), ["g"], "v", specs).collect()
    found = {(r.algorithm, r.params): r.estimate for r in got}
    assert found == {
        ("ll", "k=6,L=32"): emulation.loglog(values, 6),
        ("hll", "k=4,L=32"): emulation.hyperloglog(values, 4),
        ("hll", "k=9,L=32"): emulation.hyperloglog(values, 9),
        ("pc", "L=9"): emulation.probabilistic(values, 9),
        ("pc", "L=31"): emulation.probabilistic(values, 31),
    }


def test_registers_against_emulation(spark):
    values = random.Random(1).sample(range(1 << 32), 3000)
    for k in (4, 11, 18, 25):
        rows = registers(frame(spark, {"a": values}), ["g"], "v", k, resolve_hash()).collect()
        assert {r.idx: r.rho for r in rows} == emulation.registers(values, k)


@pytest.mark.parametrize("algo,k,limit", [("hllpp", 12, 3), ("hll", 12, 3), ("ll", 12, 4)])
def test_accuracy(spark, algo, k, limit):
    n = 200_000
    rse = (1.30 if algo == "ll" else 1.04) / 2 ** (k / 2)
    for name in ("splitmix64", "xxhash64"):
        rows = spark.range(n).withColumnRenamed("id", "v")
        got = distinct_estimates(rows, [], "v", [sketch(algo, k, hash=name, seed=1)]).first()
        assert abs(got.estimate - n) / n < limit * rse


def test_probabilistic_counting_is_rough(spark):
    got = distinct_estimates(spark.range(5000), [], "id", [sketch("pc", l=31)]).first().estimate
    assert 0.2 * 5000 < got < 3 * 5000


def test_domains():
    for bad in (3, 17):
        for algo in ("hll", "ll"):
            with pytest.raises(ValueError):
                sketch(algo, bad)
    for bad in (3, 19):
        with pytest.raises(ValueError):
            sketch("hllpp", bad)
    for bad in (0, 32):
        with pytest.raises(ValueError):
            sketch("pc", l=bad)
    with pytest.raises(ValueError):
        sketch("hll", 10, 16)
    with pytest.raises(ValueError):
        sketch("nope", 10)
    with pytest.raises(ValueError):
        check_mode("other")
    assert sketch("hllpp").k == 16 and sketch("hll").l == 32 and sketch("pc").l == 16
    assert sketch("HLL-pp", 10).params == "k=10" and sketch("ll", 10).params == "k=10,L=32"


def test_sweeps_and_selection():
    full = sweep_specs()
    count = lambda algo: sum(s.algo == algo for s in full)
    assert (count("hllpp"), count("hll"), count("ll"), count("pc")) == (15, 13, 13, 31)
    assert requested_algorithms(["all"]) == ["hllpp", "hll", "ll", "pc"]
    assert requested_algorithms(["LL", "hllpp"]) == ["hllpp", "ll"]


def test_sweep_equals_single_specs(spark):
    data = frame(spark, {"a": range(3000), "b": range(50)})
    specs = sweep_specs(ks=[4, 9, 14, 18], ls=[5, 31])
    together = {(r.g, r.algorithm, r.params): r.estimate
                for r in distinct_estimates(data, ["g"], "v", specs).collect()}
    assert len(together) == 2 * len(specs)
    for spec in specs[::3]:
        for row in distinct_estimates(data, ["g"], "v", [spec]).collect():
            assert together[row.g, spec.algo, spec.params] == row.estimate


def test_nulls_and_duplicates(spark):
    data = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", None), (None, 7), (None, 8), ("n", None)], "g string, v bigint"
    )
    specs = [sketch("hllpp", 14), SketchSpec("naive")]
    for mode in ("dense", "auto", "sparse"):
        rows = distinct_estimates(data, ["g"], "v", specs, mode).collect()
        found = {(r.g, r.algorithm): r.estimate for r in rows}
        assert found["a", "hllpp"] == 1 and found[None, "hllpp"] == 2
        assert ("n", "hllpp") not in found and found["n", "naive"] == 0
        assert found["a", "naive"] == 1 and found[None, "naive"] == 2


def test_format_rule(spark):
    """Sparse below 4,096 codes, then by the measured size of the list."""
    sizes = {"few": 4000, "more": 4200, "many": 30000}
    groups = {g: list(range(i * 10**6, i * 10**6 + n)) for i, (g, n) in enumerate(sizes.items())}
    groups[None] = list(range(7 * 10**6, 7 * 10**6 + 13000))
    data = frame(spark, groups)
    ks = (10, 14, 15, 16, 18)
    specs = [sketch("hllpp", k) for k in ks]
    by = lambda mode: {
        (r.g, r.params): r.estimate for r in distinct_estimates(data, ["g"], "v", specs, mode).collect()
    }
    auto, dense, sparse = by("auto"), by("dense"), by("sparse")
    kinds = set()
    for g, values in groups.items():
        for k in ks:
            n_codes, list_bits = emulation.sparse_list_bits(values, k)
            is_dense = n_codes >= 4096 and list_bits > 6 * (1 << k)
            kinds.add(is_dense)
            want = dense if is_dense else sparse
            assert auto[g, f"k={k}"] == want[g, f"k={k}"]
    assert kinds == {True, False}


def test_bias_steps_equal_six_nearest(spark):
    points = published_bias_points(spark)
    assert sorted(points) == list(range(4, 19))
    rng = random.Random(3)
    for k in (4, 9, 14, 18):
        table = points[k]
        steps = bias_windows(points, [k])
        for _ in range(300):
            raw = rng.uniform(0, 6 * (1 << k))
            near = sorted(range(len(table)), key=lambda i: (abs(table[i][0] - raw), i))[:6]
            want = sum(table[i][1] for i in near) / 6
            hit = [b for _, low, high, b in steps if low < raw <= high]
            assert len(hit) == 1 and abs(hit[0] - want) < 1e-9 * max(1, abs(want))


def test_expected_points_follow_published_ones(spark):
    """The computed table stays within a quarter of the standard error of one sketch."""
    published, computed = published_bias_points(spark), expected_bias_points([6, 10, 14])
    for k, table in computed.items():
        m = 1 << k
        for raw, bias in published[k]:
            near = min(table, key=lambda p: abs((p[0] - p[1]) - (raw - bias)))
            if abs((near[0] - near[1]) - (raw - bias)) < 0.5:
                assert abs(near[1] - bias) < 0.25 * 1.04 / m**0.5 * raw + 0.5


def test_bias_points_are_a_parameter(spark):
    values = list(range(3000))
    zero = {10: [(float(i), 0.0) for i in range(1, 6000, 25)]}
    assert one(spark, values, sketch("hllpp", 10), bias_points=zero) != one(
        spark, values, sketch("hllpp", 10)
    )
    computed = one(spark, values, sketch("hllpp", 10), bias_points=expected_bias_points([10]))
    assert abs(computed - 3000) < 3 * 0.0325 * 3000
    table = spark.createDataFrame([(10, i, r, b) for i, (r, b) in enumerate(zero[10])],
                                  "p int, ord int, raw double, bias double")
    assert load_bias_points(table) == zero


def test_exact_counters_agree(spark):
    data = frame(spark, {"a": [1, 1, 2, 70000], "b": [5]})
    want = {"a": 3, "b": 1}
    for counter in (exact_distinct, dense_distinct):
        assert {r.g: r.exact for r in counter(data, ["g"], "v").collect()} == want


def test_large_range_is_finite(spark):
    """Ranks that imply more than 2**32 elements must not take the log of a negative number."""
    from tallymark.functions.estimators import hyperloglog

    row = spark.range(1).select(
        hyperloglog(F.lit(16 * 2.0**-29), F.lit(16), 4).alias("far"),
        hyperloglog(F.lit(16 * 2.0**-26), F.lit(16), 4).alias("near"),
    ).first()
    assert row.far > 0 and row.near > 0
