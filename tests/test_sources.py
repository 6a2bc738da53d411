import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators.exact import (
    dataset_profile,
    integrity_violations,
    select_runs,
    with_truth_bit,
)
from tallymark.sources.generators import (
    constant_rho_stream,
    run_seed,
    uniform_stream,
    uniform_values,
    with_run_seed,
)
from tallymark.sources.run_files import (
    RunFileError,
    RunFileSource,
    located,
    read_index,
    read_run_files,
    run_index,
)


def write_runs(path, runs, n, d, seed, broken=None, **more):
    """A run file for tests; ``broken`` overrides header fields or blocks."""
    broken = {**(broken or {}), **more}
    head = struct.Struct("<8sIQQQQ")
    entry = struct.Struct("<QQQQQQIII")
    at = head.size + entry.size * len(runs)
    table, body = b"", b""
    for values in runs:
        seen, flags = set(), []
        for v in values:
            flags.append(v not in seen)
            seen.add(v)
        data = zlib.compress(np.array(values, dtype="<u4").tobytes() + broken.get("extra", b""))
        bits = zlib.compress(np.packbits(np.array(flags, dtype=bool), bitorder="little").tobytes())
        offset = at + len(body)
        table += entry.pack(
            offset + broken.get("shift", 0), len(data), offset + len(data), len(bits),
            broken.get("entry_n", n), d, broken.get("encoding", 1), 2, 0,
        )
        body += data + bits
    header = head.pack(broken.get("magic", b"SATPDBN2"), broken.get("version", 2), n,
                       broken.get("d", d), len(runs), broken.get("seed", seed))
    with open(path, "wb") as out:
        out.write((header + table + body)[: broken.get("cut")])


@pytest.fixture(scope="module")
def generated(spark):
    return constant_rho_stream(spark, 150_000, 15_000, 2, 8).cache()


def test_import_round_trip(spark, generated, tmp_path):
    """Runs longer than one batch come back whole, from several files at once."""
    rows = generated.orderBy("run_id", "pos").select("run_id", "value").toPandas()
    runs = [group.value.tolist() for _, group in rows.groupby("run_id")]
    write_runs(tmp_path / "a.bin", runs, 150_000, 15_000, 8)
    write_runs(tmp_path / "b.bin", runs[:1], 150_000, 15_000, 9)
    loaded = read_run_files(spark, str(tmp_path)).cache()
    assert loaded.rdd.getNumPartitions() == 3
    mine = loaded.where(F.col("seed") == 8).select("run_id", "pos", "value", "is_new")
    want = generated.select("run_id", "pos", "value", "is_new")
    assert mine.exceptAll(want).count() == 0 and want.exceptAll(mine).count() == 0
    assert loaded.where(F.col("seed") == 9).count() == 150_000
    assert integrity_violations(loaded.where(F.col("seed") == 8), 150_000, 15_000).count() == 0


def test_empty_and_odd_lengths(spark, tmp_path):
    write_runs(tmp_path / "odd.bin", [[5, 5, 9]], 3, 2, 1)
    rows = read_run_files(spark, str(tmp_path / "odd.bin")).orderBy("pos").collect()
    assert [(r.pos, r.value, r.is_new) for r in rows] == [(1, 5, True), (2, 5, False), (3, 9, True)]
    write_runs(tmp_path / "none.bin", [[]], 0, 0, 1)
    assert read_run_files(spark, str(tmp_path / "none.bin")).count() == 0
    high = (1 << 32) - 1
    write_runs(tmp_path / "high.bin", [[high]], 1, 1, 1)
    assert read_run_files(spark, str(tmp_path / "high.bin")).first().value == high


@pytest.mark.parametrize(
    "broken",
    [
        {"magic": b"WRONGMAG"}, {"version": 3}, {"seed": 1 << 32}, {"d": 9}, {"entry_n": 4},
        {"encoding": 7}, {"shift": 1 << 40}, {"cut": 20}, {"cut": 60},
    ],
    ids=str,
)
def test_broken_headers(tmp_path, broken):
    path = tmp_path / "broken.bin"
    write_runs(path, [[1, 2, 3]], 3, 3, 1, broken)
    with pytest.raises(RunFileError):
        read_index(str(path))


def test_broken_blocks(spark, tmp_path):
    write_runs(tmp_path / "long.bin", [[1, 2, 3]], 3, 3, 1, extra=b"1234")
    with pytest.raises(Exception, match="too much data"):
        read_run_files(spark, str(tmp_path / "long.bin")).count()
    write_runs(tmp_path / "short.bin", [[1, 2]], 3, 2, 1)
    with pytest.raises(Exception, match="too little data"):
        read_run_files(spark, str(tmp_path / "short.bin")).count()
    with pytest.raises(Exception, match="no run files"):
        read_run_files(spark, str(tmp_path / "missing*.bin")).count()


def test_folders_schemes_and_data_source(spark, tmp_path):
    """The same rows by folder, pattern, URI and data source; other files are left alone."""
    folder = tmp_path / "with blank"
    folder.mkdir()
    for i in range(3):
        write_runs(folder / f"r{i}.bin", [[i, 7, i], [7, 7, 9]], 3, 2, i)
    (folder / "notes.txt").write_text("not a run file")
    columns = ["run_id", "pos", "value", "is_new", "seed"]
    want = sorted(map(tuple, read_run_files(spark, str(folder)).select(columns).collect()))
    assert len(want) == 18 and (1, 3, 9, True, 2) in want
    for path in (f"{folder}/r*.bin", f"file:{folder}", f"file://{folder}"):
        got = read_run_files(spark, path).select(columns).collect()
        assert sorted(map(tuple, got)) == want
    spark.dataSource.register(RunFileSource)
    for path in (str(folder), f"{folder}/r*.bin"):
        source = spark.read.format("run_files").load(path)
        assert source.rdd.getNumPartitions() == 3
        assert sorted(map(tuple, source.select(columns).collect())) == want
    index = run_index(spark, str(folder))
    assert index.count() == 6 and index.agg(F.sum("elements")).first()[0] == 18
    assert "content" not in index._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty").mkdir()
    with pytest.raises(RunFileError, match="no run files"):
        read_run_files(spark, str(tmp_path / "empty"))
    assert located("/a/b.bin")[1] == located("file:/a/b.bin")[1] == "/a/b.bin"


def test_integrity_rules(spark):
    rows = [(0, 1, 5, True), (0, 2, 5, True), (1, 1, -1, True), (1, 2, 1 << 32, True), (1, 3, 2, True)]
    data = spark.createDataFrame(rows, "run_id int, pos bigint, value bigint, is_new boolean")
    found = {(r.run_id, r.rule) for r in integrity_violations(data, 2, 1).collect()}
    assert found == {
        (0, "truth bits"), (1, "elements per run"), (1, "distinct per run"), (1, "id at least 0"),
        (1, "id fits 32 bits"),
    }


def test_uniform_invariants(spark):
    for n, d, p, seed in ((30, 7, 4, 123), (120, 20, 6, 1), (500, 500, 2, 9), (64, 1, 3, 2)):
        rows = uniform_stream(spark, n, d, p, seed)
        sizes = rows.groupBy("run_id").agg(
            F.count("*").alias("n"), F.count_distinct("value").alias("d"),
            F.count_distinct("pos").alias("places"), F.min("value").alias("low"),
            F.max("value").alias("high"),
        ).collect()
        assert len(sizes) == p
        assert all((r.n, r.d, r.places) == (n, d, n) and 0 <= r.low and r.high < n for r in sizes)
    assert uniform_stream(spark, 0, 0, 3, 1).count() == 0


def test_constant_rho_invariants(spark):
    for n, d, p in ((120, 12, 3), (1000, 100, 2), (500, 50, 4), (40, 40, 1)):
        rows = constant_rho_stream(spark, n, d, p, 4)
        flagged = with_truth_bit(rows.drop("is_new")).select("run_id", "pos", "value", "is_new")
        assert flagged.exceptAll(rows.select(flagged.columns)).count() == 0
        new = rows.where("is_new").groupBy("run_id").agg(F.collect_list("pos").alias("pos"))
        assert all(sorted(r.pos) == list(range(1, n + 1, n // d)) for r in new.collect())
        profile = dataset_profile(rows, seed=4).first()
        assert (profile.runs, profile.sample_size, profile.f0, profile.seed) == (p, n, d, 4)


def test_generators_do_not_depend_on_layout(spark):
    places = spark.range(300).select(
        (F.col("id") % 3).cast("int").alias("run_id"), (F.expr("id div 3") + 1).alias("pos")
    )
    one = uniform_values(places.coalesce(1), 100, 30, 5)
    many = uniform_values(places.repartition(7), 100, 30, 5)
    assert one.exceptAll(many).count() == 0
    assert one.exceptAll(uniform_stream(spark, 100, 30, 3, 5).select(one.columns)).count() == 0
    other = uniform_values(places, 100, 30, 6)
    assert one.exceptAll(other).count() > 0


def test_generator_errors(spark):
    for n, d, p in ((5, 6, 1), (5, 0, 1), (5, 2, 0), (-1, 0, 1)):
        with pytest.raises(ValueError):
            uniform_stream(spark, n, d, p, 1)
    for n, d, p in ((101, 10, 1), (0, 0, 1), (10, 20, 1)):
        with pytest.raises(ValueError):
            constant_rho_stream(spark, n, d, p, 1)


def test_run_seeds(spark):
    rows = with_run_seed(spark.range(6).withColumnRenamed("id", "run"), "run", 21041998).collect()
    for r in rows:
        assert r.run_seed & ((1 << 64) - 1) == run_seed(21041998, r.run)


def test_run_selection_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "runs")
    uniform_stream(spark, 20, 5, 4, 1).write.partitionBy("run_id").parquet(path)
    chosen = select_runs(spark.read.parquet(path), [2, 3])
    assert chosen.count() == 40
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run_id" in plan.replace("#", "").replace("isnotnull", "") or (
        "PartitionFilters" in plan and "run_id" in plan.split("PartitionFilters")[1][:60]
    )
    assert os.path.exists(path)
