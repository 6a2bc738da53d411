"""Name -> (Spark query, DuckDB text) registry and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a Spark query, with its SQL where SQL can express it."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql if callable(sql) else (lambda: sql)
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten replicas with positions: orders dealt round robin by key, customers as values."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.pmod(key, F.lit(10)).cast("int").alias("run_id"),
        (F.expr("o_orderkey div 10") + 1).alias("pos"),
        F.col("o_custkey").alias("value"),
    )


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten strongly overlapping replicas: parts per group of suppliers."""
    return table(spark, sf_dir, "lineitem").select(
        F.pmod(F.col("l_suppkey"), F.lit(10)).cast("int").alias("run_id"),
        F.col("l_partkey").alias("value"),
    )


def event_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long stream with few distinct values: users in event order."""
    return table(spark, sf_dir, "events").select(
        F.lit(0).alias("run_id"),
        (F.col("event_id") + 1).alias("pos"),
        F.col("user_id").alias("value"),
    )


def late_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs along one common axis that start late: users with an error, per group of users."""
    return table(spark, sf_dir, "events").select(
        F.pmod(F.col("user_id"), F.lit(20)).cast("int").alias("run_id"),
        (F.col("event_id") + 1).alias("pos"),
        F.when(F.col("event_type") == "error", F.col("user_id")).alias("value"),
    )


def growing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long and a short run along one axis, of order keys: no value comes twice."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(F.pmod(F.col("o_custkey"), F.lit(8)) == 0, 1).otherwise(0).alias("run_id"),
        (key + 1).alias("pos"),
        key.alias("value"),
    )


ORDER_RUNS = (
    "(SELECT (o_orderkey % 10)::INT AS run_id, (o_orderkey // 10 + 1)::BIGINT AS pos, "
    "o_custkey::BIGINT AS value FROM orders)"
)
LINE_RUNS = "(SELECT (l_suppkey % 10)::INT AS run_id, l_partkey::BIGINT AS value FROM lineitem)"
EVENT_RUN = (
    "(SELECT 0::INT AS run_id, (event_id + 1)::BIGINT AS pos, user_id::BIGINT AS value FROM events)"
)
GROWING_RUNS = (
    "(SELECT (CASE WHEN o_custkey % 8 = 0 THEN 1 ELSE 0 END)::INT AS run_id, "
    "(o_orderkey + 1)::BIGINT AS pos, o_orderkey::BIGINT AS value FROM orders)"
)
LATE_RUNS = (
    "(SELECT (user_id % 20)::INT AS run_id, (event_id + 1)::BIGINT AS pos, "
    "CASE WHEN event_type = 'error' THEN user_id END::BIGINT AS value FROM events)"
)


def pairs_of(runs: str) -> str:
    return (
        f"(SELECT (run_id // 2)::INT AS pair_index, (run_id % 2)::INT AS side, value FROM {runs} "
        f"WHERE run_id // 2 < (SELECT (max(run_id) + 1) // 2 FROM {runs}))"
    )


def run_length(runs: DataFrame) -> int:
    """Elements of the longest run, by its last position; one small action."""
    return runs.agg(F.max("pos")).first()[0] or 0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on order in both engines."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded_sql(body: str, columns: list[str], digits: int = 6) -> str:
    replaced = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({body})"


