import pytest
from pyspark.sql import functions as F

from tallymark.functions.hashing import resolve_hash
from tallymark.operators import extend
from tallymark.operators.cells import registers
from tallymark.operators.estimate import distinct_estimates
from tallymark.operators.sketches import (
    build_sketches,
    empty_estimates,
    estimate_sketches,
    incompatible_groups,
    merge_sketches,
    pack_registers,
    reduce_precision,
    to_dense,
    unpack_registers,
)
from tallymark.operators.spec import sketch

SPECS = [sketch("hllpp", 10), sketch("hll", 10), sketch("ll", 8), sketch("pc", l=20)]


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.range(12000).select(
        (F.col("id") % 3).alias("part"),
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("v"),
    )
    return rows.cache()


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.algo)
def test_merge_equals_serial(data, spec):
    parts = build_sketches(data, ["part"], "v", spec)
    merged = merge_sketches(parts, [])
    serial = build_sketches(data, [], "v", spec)
    assert content(merged.select("idx", "rho")) == content(serial.select("idx", "rho"))
    estimate = estimate_sketches(merged, [], "dense").first().estimate
    assert estimate == distinct_estimates(data, [], "v", [spec]).first().estimate


def test_merge_is_idempotent_and_independent_of_order_and_topology(data):
    parts = build_sketches(data, ["part"], "v", sketch("hllpp", 10))
    once = content(merge_sketches(parts, []))
    twice = parts.unionByName(parts)
    assert content(merge_sketches(twice, [])) == once
    pairs = parts.withColumn("half", F.col("part") < 2)
    tree = merge_sketches(merge_sketches(pairs, ["half"]), [])
    assert content(tree) == once
    assert content(merge_sketches(merge_sketches(parts, []), [])) == once


def test_sparse_resolution_survives_merging(spark, data):
    spec = sketch("hllpp", 14)
    parts = build_sketches(data, ["part"], "v", spec, sparse_resolution=True)
    merged = merge_sketches(parts, [])
    for mode in ("auto", "sparse", "dense"):
        got = estimate_sketches(merged, [], mode).first().estimate
        assert got == distinct_estimates(data, [], "v", [spec], mode).first().estimate
    direct = registers(data, [], "v", 14, resolve_hash())
    assert content(to_dense(merged, []).select("idx", "rho")) == content(direct)


def test_incompatible_sketches_are_rejected(data):
    base = build_sketches(data, ["part"], "v", sketch("hll", 10))
    others = [
        sketch("ll", 10),
        sketch("hll", 9),
        sketch("hll", 10, hash="xxhash64", seed=1),
        sketch("hll", 10, hash="splitmix64", seed=3),
    ]
    for spec in others:
        mixed = base.unionByName(build_sketches(data, ["part"], "v", spec))
        assert incompatible_groups(mixed, ["part"]).count() == 3
        with pytest.raises(Exception, match="cannot be merged"):
            merge_sketches(mixed, []).count()
        apart = merge_sketches(mixed, [], verify=False)
        assert estimate_sketches(apart, [], "dense").count() == 2
    assert incompatible_groups(base, []).count() == 0


@pytest.mark.parametrize("high,low", [(14, 10), (18, 10), (18, 14), (12, 4), (10, 10)])
def test_reduction_equals_direct(spark, high, low):
    ids = spark.range(200_000)
    start = build_sketches(ids, [], "id", sketch("hllpp", high))
    reduced = reduce_precision(start, [], low)
    direct = build_sketches(ids, [], "id", sketch("hllpp", low))
    assert content(reduced) == content(direct)
    if high > low:
        naive = reduce_precision(start, [], low, naive=True)
        assert content(naive) != content(direct)
        a, b = (estimate_sketches(x, [], "dense", [low]).first().estimate for x in (naive, direct))
        assert a != b


def test_reduction_in_steps_and_from_sparse(spark):
    ids = spark.range(3000)
    start = build_sketches(ids, [], "id", sketch("hllpp", 16))
    steps = reduce_precision(reduce_precision(start, [], 12), [], 7)
    assert content(steps) == content(reduce_precision(start, [], 7))
    sparse = build_sketches(ids, [], "id", sketch("hllpp", 16), sparse_resolution=True)
    assert content(reduce_precision(sparse, [], 7)) == content(steps)
    naive = reduce_precision(start, [], 7, naive=True)
    assert content(reduce_precision(sparse, [], 7, naive=True)) == content(naive)
    # At its own precision a sketch keeps its resolution.
    assert content(reduce_precision(sparse, [], 16)) == content(sparse)


def test_bad_reduction_targets(spark):
    start = build_sketches(spark.range(100), [], "id", sketch("hllpp", 10))
    for target in (3, 19):
        with pytest.raises(ValueError):
            reduce_precision(start, [], target)
    with pytest.raises(Exception, match="cannot reduce"):
        reduce_precision(start, [], 11).count()
    with pytest.raises(Exception, match="cannot reduce"):
        reduce_precision(build_sketches(spark.range(9), [], "id", sketch("pc", l=9)), [], 4).count()


def test_pack_and_unpack(data):
    rows = build_sketches(data, ["part"], "v", sketch("hll", 7))
    packed = pack_registers(rows, ["part"])
    assert all(len(r.registers) == 128 for r in packed.collect())
    back = unpack_registers(packed, ["part"]).select(rows.columns)
    assert content(back) == content(rows)


def test_pack_of_the_finest_sketch(spark):
    rows = build_sketches(spark.range(300_000), [], "id", sketch("hllpp", 18))
    packed = pack_registers(rows, []).collect()
    assert len(packed) == 1 and len(packed[0].registers) == 1 << 18
    want = {r.idx: r.rho for r in rows.collect()}
    assert {i: r for i, r in enumerate(packed[0].registers) if r} == want


def test_rollup_from_a_stored_table(spark, data, tmp_path):
    path = str(tmp_path / "sketches")
    build_sketches(data, ["part"], "v", sketch("hllpp", 11)).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("odd", F.col("part") % 2 == 1)
    rolled = merge_sketches(stored, ["odd"])
    got = {r.odd: r.estimate for r in estimate_sketches(rolled, ["odd"], "dense").collect()}
    want = distinct_estimates(data.withColumn("odd", F.col("part") % 2 == 1), ["odd"], "v",
                              [sketch("hllpp", 11)])
    assert got == {r.odd: r.estimate for r in want.collect()}


def test_bitmap_sketch_keeps_keys_that_set_no_bit(spark):
    data = spark.range(40).select(F.col("id").alias("key"), F.col("id").alias("v"))
    spec = sketch("pc", l=1)
    rows = build_sketches(data, ["key"], "v", spec)
    got = {r.key: r.estimate for r in estimate_sketches(rows, ["key"], "dense").collect()}
    want = distinct_estimates(data, ["key"], "v", [spec]).collect()
    assert len(got) == 40 and got == {r.key: r.estimate for r in want}
    assert set(got.values()) == {1, 2}


def test_empty_keys_on_request(spark):
    data = spark.createDataFrame([("a", 1), ("b", None)], "g string, v bigint")
    for spec, empty in ((sketch("pc", l=9), 1), (sketch("ll", 4), 6), (sketch("hll", 4), 0),
                        (sketch("hllpp", 4), 0)):
        rows = distinct_estimates(data, ["g"], "v", [spec])
        full = {r.g: r.estimate for r in empty_estimates(data, rows, ["g"], spec).collect()}
        assert full["b"] == empty and set(full) == {"a", "b"}


class Minimum:
    """Estimate from the smallest 31-bit hash of 64 buckets."""

    name = "bucket_minimum"

    def project(self, h):
        return F.shiftrightunsigned(h, 58).cast("int"), F.shiftrightunsigned(h, 27) % (1 << 31)

    def combine(self, state):
        return F.min(state)

    def summarize(self, idx, state):
        return {"total": F.sum(state / F.lit(float(1 << 31))), "used": F.count(idx)}

    def estimate(self, summary):
        return F.floor(summary["used"] * summary["used"] / summary["total"]).cast("bigint")


def test_own_algorithm(data):
    extend.register_algorithm(Minimum())
    parts = extend.build_custom(data, ["part"], "v", Minimum.name, resolve_hash())
    serial = extend.build_custom(data, [], "v", Minimum.name, resolve_hash())
    merged = extend.merge_custom(parts, [], Minimum.name)
    assert content(merged) == content(serial)
    estimate = extend.estimate_custom(merged, [], Minimum.name).first().estimate
    assert 2000 < estimate < 10000
    with pytest.raises(ValueError):
        extend.register_algorithm(object())
    with pytest.raises(ValueError):
        extend.algorithm_of("missing")


@pytest.mark.parametrize(
    "combine, broken",
    [
        (F.sum, {"idempotence"}),
        (F.avg, {"associativity"}),
        (F.first, {"commutativity"}),
        (F.count, {"identity", "idempotence", "associativity"}),
        (F.max, set()),
        (F.bit_or, set()),
    ],
)
def test_laws_of_own_algorithms(spark, combine, broken):
    class Own(Minimum):
        name = "own"

        def project(self, h):
            return F.lit(0), (h % 1000).cast("bigint")

        def combine(self, state):
            return combine(state)

    if not broken:
        assert extend.register_algorithm(Own()).name == "own"
        return
    with pytest.raises(ValueError, match="breaks") as problem:
        extend.register_algorithm(Own())
    assert all(law in str(problem.value) for law in broken)
    assert ("idempotence" in str(problem.value)) == ("idempotence" in broken)


def test_laws_without_states(spark):
    none = spark.createDataFrame([], "id int, a int, b int, c int")
    rows = extend.law_violations(none, F.max, "id").collect()
    assert [(r.law, r.cases, r.violations) for r in rows] == [(law, 0, 0) for law in extend.LAWS]
