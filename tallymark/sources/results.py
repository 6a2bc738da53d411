"""Result tables: schemas, layout on disk, CSV text rules and loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.labels import path_fields, sanitize, sanitized
from tallymark.sources.scratch import scratch_folder

# Columns of the three kinds of result files.
STREAMING_SCHEMA = (
    "algorithm string, params string, mode string, runs bigint, sample_size bigint, "
    "number_of_elements_processed bigint, f0 bigint, seed bigint, f0_mean_t double, "
    "f0_hat_mean_t double, variance double, stddev double, rse_theoretical double, "
    "rse_observed double, bias double, absolute_bias double, relative_bias double, "
    "mean_relative_error double, rmse double, mae double"
)
MERGE_SCHEMA = (
    "algorithm string, params string, mode string, pairs bigint, sample_size bigint, "
    "pair_index bigint, seed bigint, estimate_merge double, estimate_serial double, "
    "delta_merge_serial_abs double, delta_merge_serial_rel double"
)
HETEROGENEOUS_SCHEMA = (
    "algorithm string, mode string, pairs bigint, sample_size bigint, pair_index bigint, "
    "dataset_seed bigint, left_hash string, right_hash string, left_hash_seed bigint, "
    "right_hash_seed bigint, left_params string, right_params string, strategy string, "
    "validity string, topology string, exact_union double, estimate_merge double, "
    "estimate_serial double, error_merge_abs_exact double, error_merge_rel_exact double, "
    "error_serial_abs_exact double, error_serial_rel_exact double, "
    "baseline_homogeneous double, delta_vs_baseline double"
)
SCHEMAS = {
    "streaming": STREAMING_SCHEMA,
    "merge": MERGE_SCHEMA,
    "merge_heterogeneous": HETEROGENEOUS_SCHEMA,
}
FILE_NAMES = {
    "streaming": "results_streaming.csv",
    "merge": "results_merge.csv",
    "merge_heterogeneous": "results_merge_heterogeneous.csv",
}
LAYOUT = ("namespace", "mode", "algorithm", "hash", "params")
SIGNIFICANT_DIGITS = 10


def columns_of(kind: str) -> list[str]:
    if kind not in SCHEMAS:
        raise ValueError(f"unknown result kind '{kind}'; known: {', '.join(SCHEMAS)}")
    return [part.strip().split()[0] for part in SCHEMAS[kind].split(",")]


def number_text(x: Column) -> Column:
    """A double with ten significant digits in shortest form, as ``%.10g`` prints it in C."""
    digits = SIGNIFICANT_DIGITS - 1
    scientific = F.format_string(f"%.{digits}e", x)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).cast("int")
    plain = scientific.try_cast("decimal(38,18)").cast("string")
    fixed = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(
        F.regexp_replace(F.regexp_extract(scientific, r"^([^e]*)e", 1), r"(\.\d*?)0+$", "$1"),
        r"\.$",
        "",
    )
    tail = F.regexp_extract(scientific, r"(e[+-]\d+)$", 1)
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, F.lit("0"))
        .when((exponent >= -4) & (exponent < SIGNIFICANT_DIGITS), fixed)
        .otherwise(F.concat(mantissa, tail))
    )


def as_text(df: DataFrame) -> DataFrame:
    """Every double column turned into its result-file text."""
    return df.select(
        *[
            number_text(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def with_layout(df: DataFrame, namespace: str, algorithm: str, hash: Column, params: Column):
    """Attach the layout columns under names of their own, cleaned for use in paths."""
    return df.withColumns(
        {
            "p_namespace": sanitize(F.lit(namespace)),
            "p_mode": sanitize(F.col("mode")),
            "p_algorithm": sanitize(F.lit(algorithm)),
            "p_hash": sanitize(hash),
            "p_params": sanitize(params),
        }
    )


LAYOUT_COLUMNS = tuple(f"p_{name}" for name in LAYOUT)


def append_results(df: DataFrame, root: str, format: str = "parquet") -> None:
    """Append rows below ``root/p_namespace=../p_mode=../p_algorithm=../p_hash=../p_params=..``.

    ``df`` carries the layout columns of :func:`with_layout`.  CSV output has one header per
    file, quotes fields that need it and doubles quotes inside.
    """
    _writer(df, format).mode("append").save(root)


def replace_results(df: DataFrame, root: str, format: str = "parquet") -> None:
    """Replace exactly the layout partitions that ``df`` has rows for; keep all others."""
    writer = _writer(df, format).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").save(root)


def replace_namespaces(
    df: DataFrame, root: str, namespaces: Sequence[str], format: str = "parquet"
) -> None:
    """Drop the named namespaces with everything in them and write their new rows.

    Names are cleaned as in :func:`with_layout`; rows of other namespaces are not written.  The
    frame is computed once, into a working folder, before anything is dropped, so it may even
    read from ``root`` itself.  A named namespace without rows is left empty.
    """
    spark, staged = df.sparkSession, scratch_folder(df.sparkSession, "namespaces")
    names = sorted({sanitized(name) for name in namespaces})
    _writer(df.where(F.col("p_namespace").isin(names)), "parquet").save(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    for name in names:
        mine = rows.where(F.col("p_namespace") == name).drop("p_namespace")
        writer = _writer(mine, format, LAYOUT_COLUMNS[1:])
        writer.mode("overwrite").save(f"{root.rstrip('/')}/p_namespace={name}")


def _writer(df: DataFrame, format: str, by: Sequence[str] = LAYOUT_COLUMNS):
    # Rows of one output folder are brought together to avoid tiny files; a folder that
    # holds much of the data is split again.
    rows = as_text(df) if format == "csv" else df
    writer = rows.hint("rebalance", *by).write.partitionBy(*by).format(format)
    if format == "csv":
        writer = writer.options(header=True, quote='"', escape='"')
    return writer


def write_table(df: DataFrame, path: str, format: str = "csv") -> None:
    """A summary table as files with a header."""
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.options(header=True, quote='"', escape='"')
    writer.save(path)


def load_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All result files of one kind below ``path`` as one frame with ``source_path``.

    The schema is explicit and has to match each file's header; a row that does not fit it makes
    the query fail.  Files are found recursively, and ``nan`` is read as NaN.  Files that by
    their name or by their ``p_mode`` folder are of another kind are passed over unread.
    """
    reader = spark.read.schema(SCHEMAS[kind]).options(
        header=True, recursiveFileLookup=True, quote='"', escape='"', nanValue="nan",
        positiveInf="inf", negativeInf="-inf", pathGlobFilter="*.csv", mode="FAILFAST",
        enforceSchema=False,
    )
    others = [other for other in SCHEMAS if other != kind]
    folders = [f"/p_mode={other}/" for other in others]
    file, whole = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    own = ~file.isin([FILE_NAMES[other] for other in others])
    for folder in folders:
        own = own & ~whole.contains(folder)
    return reader.csv(path).where(own).select("*", whole.alias("source_path"))


def with_path_fields(df: DataFrame, names: Sequence[str], path: str = "source_path") -> DataFrame:
    """Attach fields parsed from the file path; see :func:`path_fields` for their names."""
    fields = path_fields(F.col(path))
    return df.withColumns({name: fields[name] for name in names})
