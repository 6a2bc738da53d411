"""Small parameter frames, and joins on caller-chosen keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LOCAL_ROWS = 20_000


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D" if abs(value) < float("inf") and value == value else f"double('{value}')"
    if isinstance(value, int):
        return f"{value}L" if abs(value) >= 1 << 31 else str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A literal frame (SQL ``VALUES``, so the optimizer knows its size) with ``schema`` such as ``"k int, name string"``."""
    if len(rows) > MAX_LOCAL_ROWS:
        raise ValueError(f"a parameter frame holds at most {MAX_LOCAL_ROWS} rows")
    fields = [field.strip().split(None, 1) for field in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    names = ", ".join(f"`{name}`" for name, _ in fields)
    body = ",\n".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"cast(`{name}` as {kind}) as `{name}`" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL, as it does in ``groupBy``."""
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    condition = F.lit(True)
    for i, key in enumerate(keys):
        same = F.col(key).eqNullSafe(F.col(f"__right_{key}"))
        condition = same if i == 0 else condition & same
    joined = left.join(renamed, condition, how)
    return joined if how.startswith("left_") else joined.drop(*[f"__right_{k}" for k in keys])
