import math

import pytest
from pyspark.sql import functions as F

from tallymark.functions import errors, labels
from tallymark.plans import reports
from tallymark.sources import results
from tallymark.sources.scratch import scratch_folder


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_number_text(spark):
    numbers = {
        0.006012024048096192: "0.006012024048", 1e-5: "1e-05", 123456789.123456: "123456789.1",
        1e10: "1e+10", 0.0: "0", -2.5: "-2.5", 100.0: "100", 12345678901.5: "1.23456789e+10",
        9999999999.9: "1e+10", 0.0001: "0.0001", 0.00001234567890123: "1.23456789e-05",
        -1.0 / 3: "-0.3333333333", float("inf"): "inf", 1e-300: "1e-300", 2.0**70: "1.180591621e+21",
    }
    for x, text in numbers.items():
        assert value(spark, results.number_text(F.lit(x))) == text
        if math.isfinite(x):
            assert text == f"{x:.10g}"
    assert value(spark, results.number_text(F.lit(float("nan")))) == "nan"


def sample(spark, namespace, estimate=1.5, params="k=10,L=32", algorithm='odd "name", x'):
    row = [(algorithm, params, "merge", 1, 10, 0, 42, estimate, 2.0, 0.5, float("nan"))]
    frame = spark.createDataFrame(row, results.MERGE_SCHEMA)
    return results.with_layout(frame, namespace, "hll", F.lit("xxhash64"), F.col("params"))


def test_csv_round_trip_with_quotes_and_nan(spark):
    root = scratch_folder(spark, "csv")
    results.append_results(sample(spark, "a b"), root, "csv")
    results.append_results(sample(spark, "a b", 2.5), root, "csv")
    rows = results.load_results(spark, root, "merge").orderBy("estimate_merge").collect()
    assert [r.estimate_merge for r in rows] == [1.5, 2.5]
    assert rows[0].algorithm == 'odd "name", x' and math.isnan(rows[0].delta_merge_serial_rel)
    assert "p_namespace=a_b/p_mode=merge/p_algorithm=hll/p_hash=xxhash64/p_params=k_10_L_32/" in (
        rows[0].source_path
    )


def test_replacing(spark):
    root = scratch_folder(spark, "replace")
    results.append_results(sample(spark, "one"), root)
    results.append_results(sample(spark, "one", params="k=11,L=32"), root)
    results.append_results(sample(spark, "two"), root)
    results.replace_results(sample(spark, "one", 9.0), root)
    read = lambda: sorted(
        (r.p_namespace, r.params, r.estimate_merge) for r in spark.read.parquet(root).collect()
    )
    assert read() == [("one", "k=10,L=32", 9.0), ("one", "k=11,L=32", 1.5), ("two", "k=10,L=32", 1.5)]
    results.replace_namespaces(sample(spark, "one", 7.0), root, ["one"])
    assert read() == [("one", "k=10,L=32", 7.0), ("two", "k=10,L=32", 1.5)]


def test_replacing_namespaces_once(spark):
    """Names are cleaned, the frame may come from the folder itself, and is computed once."""
    root = scratch_folder(spark, "namespaces")
    for name in ("a b", "b", "c"):
        results.append_results(sample(spark, name), root)
        results.append_results(sample(spark, name, params="k=11,L=32"), root)
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    stored = spark.read.parquet(root).where("params = 'k=10,L=32' and p_namespace <> 'c'")
    frame = stored.withColumn("estimate_merge", F.col("estimate_merge") + 1)
    frame = frame.mapInArrow(counted, frame.schema)
    results.replace_namespaces(frame, root, ["a b", "b", "c"])
    rows = spark.read.parquet(root).collect()
    got = sorted((r.p_namespace, r.params, r.estimate_merge) for r in rows)
    assert got == [("a_b", "k=10,L=32", 2.5), ("b", "k=10,L=32", 2.5)]
    assert computed.value == 2


def test_files_of_another_kind_are_passed_over(spark, tmp_path):
    """A tree with all kinds of files, in either layout, is loaded kind by kind."""
    root = str(tmp_path)
    results.append_results(sample(spark, "one"), root, "csv")
    other = spark.createDataFrame([(1, "x")], "p int, q string")
    results.write_table(other, f"{root}/p_namespace=one/p_mode=streaming/part")
    (tmp_path / "ns" / "merge" / "hll" / "xxhash64" / "k_9").mkdir(parents=True)
    for name in ("results_streaming.csv", "results_merge_heterogeneous.csv"):
        (tmp_path / "ns" / "merge" / "hll" / "xxhash64" / "k_9" / name).write_text("x,y\n1,2\n")
    loaded = results.load_results(spark, root, "merge")
    names = ["namespace", "mode_dir", "algorithm_dir", "hash", "params_dir", "k", "l"]
    row, = results.with_path_fields(loaded, names).collect()
    assert (row.namespace, row.mode_dir, row.algorithm_dir) == ("one", "merge", "hll")
    assert (row.hash, row.params_dir, row.estimate_merge) == ("xxhash64", "k_10_L_32", 1.5)
    assert (row.k, row.l) == (10, 32)


def test_unknown_kind():
    with pytest.raises(ValueError):
        results.columns_of("other")
    assert results.columns_of("streaming")[-1] == "mae" and len(results.columns_of("streaming")) == 20
    assert len(results.columns_of("merge")) == 11
    assert len(results.columns_of("merge_heterogeneous")) == 24


def test_labels(spark):
    cases = {"a--b": "a_b", "__x__": "x", "": "default", "***": "default", "k=14,L=32": "k_14_L_32"}
    for raw, clean in cases.items():
        assert value(spark, labels.sanitize(F.lit(raw))) == clean
    assert labels.algorithm_name("HLL-pp") == "HyperLogLog++"
    with pytest.raises(ValueError):
        labels.algorithm_name("hll++")
    assert value(spark, labels.algorithm_name_of(F.lit("L-L"))) == "LogLog"
    assert value(spark, labels.algorithm_name_of(F.lit("x"))) is None
    assert value(spark, labels.param_value(F.lit("k=14,L=32"), "L")) == 32
    assert value(spark, labels.param_value(F.lit("L=32"), "k")) is None
    with pytest.raises(Exception, match="parameter k is missing"):
        value(spark, labels.strict_param_value(F.lit("L=32"), "k"))
    assert labels.pair_hash_label("a", 1, "b", 2) == "left=a_seed=1__right=b_seed=2"


def test_path_fields(spark):
    path = "/r/merge_hpp_hom_d_1000/merge/hllpp/siphash24/k_18/results_merge.csv"
    fields = labels.path_fields(F.lit(path))
    row = spark.range(1).select(*[c.alias(n) for n, c in fields.items()]).first()
    assert (row.namespace, row["mode_dir"], row.hash, row.params_dir) == (
        "merge_hpp_hom_d_1000", "merge", "siphash24", "k_18")
    assert (row.d, row.k, row.l, row.scenario, row.left_k) == (1000, 18, None, None, None)
    path = "/r/x_d_5/streaming/ll/splitmix64/k_9_L_32/results_streaming.csv"
    row = spark.range(1).select(
        *[c.alias(n) for n, c in labels.path_fields(F.lit(path)).items()]).first()
    assert (row.k, row.l) == (9, 32)


def test_error_functions(spark):
    nan = float("nan")
    assert math.isnan(value(spark, errors.relative_error(F.lit(nan), F.lit(5.0))))
    assert math.isnan(value(spark, errors.relative_error(F.lit(1.0), F.lit(0.0))))
    assert value(spark, errors.relative_error(F.lit(4.0), F.lit(5.0))) == 0.2
    assert math.isnan(value(spark, errors.absolute_error(F.lit(float("inf")), F.lit(1.0))))
    assert value(spark, errors.merge_delta(F.lit(4.0), F.lit(0.0))[1]) == 0
    assert value(spark, errors.degradation_ratio(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert math.isnan(value(spark, errors.degradation_ratio(F.lit(0.0), F.lit(0.0))))
    rse = errors.theoretical_rse
    assert value(spark, rse(F.lit("hll"), F.lit(10))) == 0.0325
    assert value(spark, rse(F.lit("ll"), F.lit(10))) == 0.040625
    assert math.isnan(value(spark, rse(F.lit("pc"), F.lit(10))))
    low, high = errors.log_band(F.lit(100.0), F.lit(0.0))
    assert value(spark, low) == value(spark, high) == 100.0
    assert value(spark, errors.linear_band(F.lit(1.0), F.lit(5.0))[0]) == 1e-12


STREAM = (
    "algorithm string, params string, mode string, sample_size bigint, f0 bigint, seed bigint, "
    "number_of_elements_processed bigint, f0_mean_t double, f0_hat_mean_t double, stddev double, "
    "mean_relative_error double"
)


def test_prefix_reports(spark):
    rows = []
    for params, worst in (("k=10,L=32", 0.2), ("k=12,L=32", 0.1), ("k=14,L=32", 0.1)):
        for t, f0, mre in ((10, 5.0, 0.5), (20, 9.0, 0.4), (40, 20.0, worst)):
            rows.append(("LogLog", params, "streaming", 40, 20, 1, t, f0, f0 + 1, 2.0, mre))
    rows.append(("LogLog", "k=10,L=32", "streaming", 40, 20, 2, 40, 20.0, 21.0, 2.0, 0.9))
    rows.append(("LogLog", "k=10,L=32", "merge", 40, 20, 1, 40, 20.0, 21.0, 2.0, 0.9))
    data = spark.createDataFrame(rows, STREAM)
    chosen = reports.select_stream_results(data, 40, 1, [2])
    assert chosen.count() == 9
    assert reports.select_stream_results(data, 40, 1, [3]).count() == 0
    assert reports.standard_params_only(chosen).count() == 3
    ends = reports.endpoint_summary(chosen)
    assert {(r.param_value, r.endpoint_mre) for r in ends.collect()} == {(10, 0.2), (12, 0.1), (14, 0.1)}
    best = reports.best_params(ends).collect()
    assert [(r.param_name, r.param_value, r.rho) for r in best] == [("k", 12, 2)]
    points = reports.interpolated_points(chosen, [4, 5, 7, 20, 21]).where("param_value = 10")
    got = {r.f0_star: (r.rho_t, r.f0_hat, r.stddev) for r in points.collect()}
    assert got == {5: (2.0, 6.0, 2.0), 7: (15 / 7, 8.0, 2.0), 20: (2.0, 21.0, 2.0)}
    single = chosen.where("number_of_elements_processed = 10")
    assert reports.interpolated_points(single, [5]).count() == 0
    curve = reports.truth_curve(chosen).orderBy("number_of_elements_processed").collect()
    assert [(r.rho_t, r.progress_pct, r.is_boundary) for r in curve][0] == (2.0, 25.0, True)
    wide = reports.pivot_metric(ends, ["rho"], "param_value", [10, 12], "endpoint_mre").first()
    assert (wide["10"], wide["12"]) == (0.2, 0.1)


def test_malformed_result_files_fail(spark, tmp_path):
    from tallymark.sources.results import columns_of, load_results

    header = ",".join(columns_of("merge"))
    good, bad, other = tmp_path / "good", tmp_path / "bad", tmp_path / "other"
    row = "X,k=10,merge,{},1,0,42,1.5,1.5,0,0"
    for folder, text in (
        (good, f"{header}\n{row.format(3)}\n"),
        (bad, f"{header}\n{row.format('notanumber')}\n"),
        (other, f"{header.replace('pairs', 'runs')}\n{row.format(3)}\n"),
    ):
        folder.mkdir()
        (folder / "results.csv").write_text(text)
    assert load_results(spark, str(good), "merge").first().pairs == 3
    for folder in (bad, other):
        with pytest.raises(Exception):
            load_results(spark, str(folder), "merge").collect()
