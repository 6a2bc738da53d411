"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.sources.scratch import scratch_folder

#: A word is a run of characters other than these; the same set in every operator on words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut in the lineage."""
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def map_columns(
    df: DataFrame,
    function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list | np.ndarray]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` on plain Python columns: a batch is a dict of columns, in and out.

    Strings come as iterators, so that one text of a batch is held as a Python object at a time."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = (
            {
                n: (x.as_py() for x in c) if pa.types.is_string(c.type) else c.to_pylist()
                for n, c in zip(b.schema.names, b.columns)
            }
            for b in batches
        )
        for out in function(plain):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type, from_pandas=False) for f in wanted], schema=wanted
            )

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Memory that was freed goes back to the system, where its library can do so."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


_held: tuple[object, object] = (None, None)


def worker_state(key: object, make: Callable[[], object]) -> object:
    """The object of ``make()``, kept in a Python worker as long as the calls have the same ``key``.

    Workers outlive the stages of a job, so what one operator keeps there (vocabularies, caches) makes room
    for what the next one does: a worker holds one such object at a time."""
    global _held
    if _held[0] != key:
        _held = (None, None)
        _give_back()
        _held = (key, make())
    return _held[1]


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_digest(df: DataFrame) -> Column:
    """struct of two 64-bit hashes of all columns of a row; equal rows have equal digests."""
    # nulls alone would leave no trace
    parts = [part for c in df.columns for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.struct(F.xxhash64(*parts).alias("low"), F.xxhash64(F.lit("high"), *parts).alias("high"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
