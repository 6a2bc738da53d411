"""Sketches maintained over unbounded streams.

A register sketch is a maximum per (key, register), which Structured Streaming keeps as
ordinary aggregation state: at most ``2**k`` rows per key, however long the stream.  In
update mode a trigger emits the registers it touched.  Because a maximum is idempotent,
replayed input and repeated messages change nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallymark.functions.bias import BiasPoints
from tallymark.functions.local import local_frame, null_safe_join
from tallymark.operators.sketches import (
    IDENTITY,
    build_sketches,
    estimate_sketches,
    merge_sketches,
)
from tallymark.operators.spec import SketchSpec


def live_sketches(
    stream: DataFrame, keys: Sequence[str], value: str, spec: SketchSpec
) -> DataFrame:
    """The sketch table of a stream, updated per trigger; to be run in update mode."""
    return build_sketches(stream, keys, value, spec)


def live_union(messages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of sketch rows arriving from several nodes, in update mode.

    ``messages`` is a stream of sketch table rows.  The sketch identity stays in the key, so
    incompatible sketches are never mixed.
    """
    return messages.groupBy(*by, *IDENTITY, "idx").agg(F.max("rho").alias("rho"))


class SketchLog:
    """A sketch table that grows by the registers that rose in each trigger.

    Keys are dealt to buckets. Below ``root`` a trigger appends one segment per bucket in which
    a register rose; a manifest lists the segments that make up each bucket.  A trigger reads
    only the buckets that it touches, and a bucket with more than ``max_segments`` of them is
    rewritten as one segment with one row per register.  So what a trigger reads is bounded by
    the registers of the buckets it touches, whatever the length of the stream.

    Segments and manifests are never changed once written.  The manifests of the last triggers
    are kept, and a segment that was replaced is deleted only when no kept manifest names it,
    so a trigger that is run again finds what it found before and writes the same again.
    """

    #: Manifests that are kept; each has a folder that the newest one takes over from the oldest.
    KEPT = 4
    _MANIFEST = "batch_id bigint, bucket int, path string, n_rows bigint, replaced bigint"

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keys: Sequence[str],
        buckets: int = 16,
        max_segments: int = 8,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = list(keys)
        self.buckets = buckets if self.keys else 1
        self.max_segments = max_segments

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        if not self.keys:
            return rows.withColumn("bucket", F.lit(0))
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _manifests(self) -> dict[int, tuple[int, list[Row]]]:
        """Of every kept manifest, by trigger: the folder it is in and its segments."""
        try:
            rows = self.spark.read.schema(f"{self._MANIFEST}, slot int").json(f"{self.root}/manifest").collect()
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        found: dict[int, tuple[int, list[Row]]] = {}
        for row in rows:
            listed = found.setdefault(row.batch_id, (row.slot, []))[1]
            if row.path is not None:
                listed.append(row)
        return found

    def _segments(self, batch_id: int | None = None, before: bool = False) -> list[Row]:
        """What made up the log after a trigger, or before it; by default after the last one."""
        known = self._manifests()
        wanted = [b for b in known if batch_id is None or b < batch_id or b == batch_id and not before]
        return known[max(wanted)][1] if wanted else []

    def _read(self, segments: Sequence[Row], schema: StructType) -> DataFrame:
        paths = [s.path for s in segments if s.replaced is None]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _append(self, rows: DataFrame, table: str, batch_id: int) -> list[Row]:
        """Rows (.., bucket) written as segments of a trigger; what the manifest says of them."""
        path = self._folder(table, batch_id)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(rows.schema).parquet(path).groupBy("bucket").count().collect()
        return [
            Row(batch_id=batch_id, bucket=w.bucket, path=f"{path}/bucket={w.bucket}", n_rows=w["count"], replaced=None)
            for w in sorted(written)
        ]

    def put(self, touched: DataFrame, batch_id: int) -> None:
        """Add the registers of one trigger that are higher than in the log so far."""
        columns = touched.columns
        arrived = f"{self.root}/arrived"
        self._with_bucket(touched).write.mode("overwrite").partitionBy("bucket").parquet(arrived)
        arrived_rows = self.spark.read.schema(self._with_bucket(touched).schema).parquet(arrived)
        # at most as many as there are buckets
        reached = {r.bucket for r in arrived_rows.select("bucket").distinct().collect()}

        segments = self._segments(batch_id, before=True)
        near = [s for s in segments if s.bucket in reached]
        on = [*self.keys, *IDENTITY, "idx"]
        known = merge_sketches(self._read(near, touched.schema), self.keys, verify=False)
        joined = null_safe_join(arrived_rows, known.withColumnRenamed("rho", "__old"), on, "left")
        risen = joined.where(F.col("__old").isNull() | (F.col("rho") > F.col("__old")))
        added = self._append(risen.select(*columns, "bucket"), "registers", batch_id)
        self._commit(batch_id, *self._compacted([*segments, *added], batch_id, touched.schema))

    def _compacted(
        self, segments: list[Row], batch_id: int, schema: StructType
    ) -> tuple[list[Row], list[str]]:
        """The segments once full buckets are rewritten, and the paths that can be deleted."""
        live = Counter(s.bucket for s in segments if s.replaced is None)
        full = {bucket for bucket, n in live.items() if n > self.max_segments}
        if full:
            whole = self._read([s for s in segments if s.bucket in full], schema)
            merged = merge_sketches(whole, self.keys, verify=False).select(*schema.names)
            # one task per bucket's segment: its registers are few
            bases = self._append(
                self._with_bucket(merged).repartition(len(full), "bucket"), "compacted", batch_id
            )
            segments = [
                Row(**{**s.asDict(), "replaced": batch_id}) if s.bucket in full and s.replaced is None else s
                for s in segments
            ] + bases
        gone = {s.path for s in segments if s.replaced is not None and s.replaced <= batch_id - self.KEPT}
        return [s for s in segments if s.path not in gone], sorted(gone)

    def _commit(self, batch_id: int, segments: list[Row], gone: list[str]) -> None:
        """Write the manifest of a trigger in place of the oldest, then delete what no manifest names."""
        known = self._manifests()
        previous = max((b for b in known if b < batch_id), default=None)
        taken = {slot: b for b, (slot, _) in known.items()}
        if batch_id in known:
            slot = known[batch_id][0]
        else:
            free = [s for s in range(self.KEPT) if s not in taken]
            slot = free[0] if free else min((s for s in taken if taken[s] != previous), key=taken.get)
        # a manifest without segments still has a row, so the trigger is known
        rows = [(batch_id, s.bucket, s.path, s.n_rows, s.replaced) for s in segments]
        listed = local_frame(self.spark, rows or [(batch_id, None, None, None, None)], self._MANIFEST)
        listed.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/slot={slot}")
        for path in gone:
            self._delete(path)

    def _delete(self, path: str) -> None:
        files, place = fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
        if files.get_file_info(place).type != fs.FileType.NotFound:
            files.delete_dir(place)

    def reads(self, batch_id: int | None = None) -> int:
        """Rows of all segments that a reader of the whole log meets."""
        return sum(s.n_rows for s in self._segments(batch_id) if s.replaced is None)

    def _schema(self) -> StructType:
        # any segment tells the columns
        return self.spark.read.parquet(self._segments()[-1].path).schema

    def sketches(self) -> DataFrame:
        """The current sketch table."""
        return merge_sketches(self._read(self._segments(), self._schema()), self.keys, verify=False)

    def snapshot(self, batch_id: int, **options) -> None:
        """Estimate the keys that changed in one trigger and store them under its id."""
        segments = self._segments(batch_id)
        own = [s for s in segments if s.path.startswith(self._folder("registers", batch_id) + "/")]
        if not own:
            return
        schema = self._schema()
        near = [s for s in segments if s.bucket in {o.bucket for o in own}]
        rows = self._read(near, schema)
        if self.keys:
            risen = self.spark.read.schema(schema).parquet(*(s.path for s in own))
            rows = null_safe_join(rows, risen.select(*self.keys).distinct(), self.keys, "left_semi")
        current = merge_sketches(rows, self.keys, verify=False)
        estimates = estimate_sketches(current, self.keys, **options)
        estimates.write.mode("overwrite").parquet(self._folder("estimates", batch_id))

    def estimates(self) -> DataFrame:
        """``keys, .., estimate, batch_id`` of all triggers so far."""
        return self.spark.read.parquet(f"{self.root}/estimates")

    def latest(self) -> DataFrame:
        """The last estimate of every key."""
        last = F.max_by(F.struct("estimate", "batch_id"), "batch_id").alias("last")
        by = [*self.keys, "algo", "params", "hash", "hash_seed"]
        return self.estimates().groupBy(*by).agg(last).select(*by, "last.estimate")

    def compact(self, target: str) -> SketchLog:
        """The log rewritten with one row per register, as a new log at ``target``."""
        compacted = SketchLog(self.spark, target, self.keys, self.buckets, self.max_segments)
        compacted.put(self.sketches(), 0)
        return compacted


def maintain(
    stream: DataFrame,
    keys: Sequence[str],
    value: str,
    spec: SketchSpec,
    root: str,
    mode: str = "dense",
    bias_points: BiasPoints | None = None,
    available_now: bool = False,
    trigger: str = "1 minute",
) -> tuple[StreamingQuery, SketchLog]:
    """Keep sketches of a stream and a snapshot of their estimates per trigger.

    Both tables and the query's checkpoint live below ``root``, which has to be shared
    storage.  The query survives restarts: state is in the checkpoint, and a trigger that is
    run again writes the same folders again.
    """
    spark = stream.sparkSession
    log = SketchLog(spark, root, keys)
    ks = [spec.k] if spec.k is not None else None

    def on_trigger(touched: DataFrame, batch_id: int) -> None:
        log.put(touched, batch_id)
        log.snapshot(
            batch_id, mode=mode, ks=ks, algorithms=[spec.algo], bias_points=bias_points
        )

    writer = (
        live_sketches(stream, keys, value, spec)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
        .foreachBatch(on_trigger)
    )
    timing = {"availableNow": True} if available_now else {"processingTime": trigger}
    return writer.trigger(**timing).start(), log
