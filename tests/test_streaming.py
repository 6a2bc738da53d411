import pytest
from pyspark.sql import functions as F

from tallymark.operators.estimate import distinct_estimates
from tallymark.operators.sketches import build_sketches
from tallymark.operators.spec import sketch
from tallymark.sources.scratch import scratch_folder
from tallymark.streaming.live import SketchLog, live_union, maintain

SPEC = sketch("hllpp", 9)


def feed(spark, folder, low, high):
    rows = spark.range(low, high).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("key"),
        (F.col("id") % 700).alias("value"),
    )
    rows.coalesce(1).write.mode("append").parquet(folder)
    return rows


def source(spark, folder):
    return spark.readStream.schema("key bigint, value bigint").parquet(folder)


def estimates(frame):
    return {r.key: r.estimate for r in frame.collect()}


def run(spark, folder, root):
    query, log = maintain(source(spark, folder), ["key"], "value", SPEC, root, available_now=True)
    query.awaitTermination()
    return log


def test_incremental_equals_batch_across_restarts(spark):
    folder, root = scratch_folder(spark, "feed"), scratch_folder(spark, "state")
    feed(spark, folder, 0, 500)
    first = estimates(run(spark, folder, root).latest())
    feed(spark, folder, 400, 2500)
    log = run(spark, folder, root)
    everything = spark.read.parquet(folder)
    want = estimates(distinct_estimates(everything, ["key"], "value", [SPEC]))
    assert estimates(log.latest()) == want and first != want
    # Only registers that rose are written in the second run.
    registers = spark.read.parquet(f"{root}/registers")
    assert registers.where("batch_id = 1").count() < log.sketches().count()
    snapshots = log.estimates().where("batch_id = 0")
    assert estimates(snapshots) == first


def test_a_repeated_trigger_changes_nothing(spark):
    folder, root = scratch_folder(spark, "feed"), scratch_folder(spark, "state")
    feed(spark, folder, 0, 900)
    log = run(spark, folder, root)
    before = estimates(log.latest())
    whole = build_sketches(spark.read.parquet(folder), ["key"], "value", SPEC)
    log.put(whole, 0)
    log.snapshot(0, mode="dense", ks=[9], algorithms=["hllpp"])
    assert estimates(log.latest()) == before


def test_compaction(spark):
    folder, root = scratch_folder(spark, "feed"), scratch_folder(spark, "state")
    feed(spark, folder, 0, 300)
    run(spark, folder, root)
    feed(spark, folder, 300, 3000)
    log = run(spark, folder, root)
    compacted = log.compact(scratch_folder(spark, "compact"))
    rows = lambda x: sorted(map(tuple, x.sketches().collect()), key=repr)
    assert rows(compacted) == rows(log)


def test_union_of_messages_is_idempotent(spark):
    inbox = scratch_folder(spark, "inbox")
    rows = spark.range(4000).select((F.col("id") % 2).alias("node"), "id")
    sketches = build_sketches(rows, ["node"], "id", SPEC)
    for _ in range(2):
        sketches.write.mode("append").parquet(inbox)
    messages = spark.readStream.schema(sketches.schema).parquet(inbox)
    log = SketchLog(spark, scratch_folder(spark, "union"), [])
    query = (
        live_union(messages, []).writeStream.outputMode("update").foreachBatch(log.put)
        .option("checkpointLocation", scratch_folder(spark, "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    log.snapshot(0, mode="dense", ks=[9], algorithms=["hllpp"])
    want = distinct_estimates(rows, [], "id", [SPEC]).first().estimate
    assert log.latest().first().estimate == want


@pytest.mark.parametrize("spec", [sketch("pc", l=20), sketch("ll", 6)], ids=lambda s: s.algo)
def test_other_algorithms_live(spark, spec):
    folder, root = scratch_folder(spark, "feed"), scratch_folder(spark, "state")
    feed(spark, folder, 0, 900)
    query, log = maintain(source(spark, folder), ["key"], "value", spec, root, available_now=True)
    query.awaitTermination()
    want = distinct_estimates(spark.read.parquet(folder), ["key"], "value", [spec])
    assert estimates(log.latest()) == estimates(want)


def touched(spark, low, high, step=7):
    rows = spark.range(low, high).select((F.col("id") % step).alias("key"), F.col("id").alias("value"))
    return build_sketches(rows, ["key"], "value", SPEC)


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_what_a_trigger_reads_does_not_grow(spark):
    log = SketchLog(spark, scratch_folder(spark, "long"), ["key"], buckets=3, max_segments=3)
    reads = []
    for batch in range(24):
        log.put(touched(spark, 200 * batch, 200 * batch + 400), batch)
        reads.append(log.reads())
    current = log.sketches()
    want = touched(spark, 0, 200 * 23 + 400)
    assert as_rows(current) == as_rows(want.select(*current.columns))
    # at most the registers once, and what has been added since a bucket was rewritten
    assert max(reads) <= 2 * want.count()
    assert len(log._segments()) <= 3 * (4 + 1) * 2 and len(log._manifests()) == log.KEPT
    # segments that were replaced long ago are gone from the disk
    kept = {r.path.rsplit("/registers/", 1)[1] for r in log._segments() if "/registers/" in r.path}
    there = spark.read.parquet(f"{log.root}/registers").select("batch_id", "bucket").distinct().collect()
    assert {f"batch_id={r.batch_id}/bucket={r.bucket}" for r in there} <= kept


def test_a_trigger_reads_the_buckets_it_touches(spark):
    log = SketchLog(spark, scratch_folder(spark, "buckets"), ["key"], buckets=64)
    log.put(touched(spark, 0, 5000, step=200), 0)
    log.put(touched(spark, 5000, 6000, step=1), 1)
    assert len({s.bucket for s in log._segments(0)}) > 20
    assert len({s.bucket for s in log._segments(1) if "/batch_id=1/" in s.path}) == 1


def test_the_trigger_of_a_compaction_can_be_repeated(spark):
    log = SketchLog(spark, scratch_folder(spark, "again"), ["key"], buckets=1, max_segments=2)
    options = {"mode": "dense", "ks": [9], "algorithms": ["hllpp"]}
    for batch in (0, 1, 2, 2, 3, 3, 10, 10, 11):  # ids may jump
        log.put(touched(spark, 500 * batch, 500 * batch + 900), batch)
        log.snapshot(batch, **options)
        before = as_rows(log.sketches()), as_rows(log.latest())
        log.put(touched(spark, 500 * batch, 500 * batch + 900), batch)
        log.snapshot(batch, **options)
        assert (as_rows(log.sketches()), as_rows(log.latest())) == before
    assert any("/compacted/" in s.path for s in log._segments())
    # another session with the same root goes on
    again = SketchLog(spark, log.root, ["key"], buckets=1, max_segments=2)
    again.put(touched(spark, 50_000, 50_900), 12)
    assert again.sketches().count() >= len(before[0])


def test_a_trigger_without_news(spark):
    log = SketchLog(spark, scratch_folder(spark, "idle"), ["key"])
    log.put(touched(spark, 0, 300), 0)
    log.put(touched(spark, 0, 300), 1)
    log.snapshot(1, mode="dense", ks=[9], algorithms=["hllpp"])
    assert log.reads(0) == log.reads(1) and max(log._manifests()) == 1
