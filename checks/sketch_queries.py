"""Queries over hashes, bits, estimators, merges and sources."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import sqltext as q
from checks.registry import (
    LINE_RUNS,
    ORDER_RUNS,
    line_runs,
    order_runs,
    pairs_of,
    query,
    rounded,
    table,
)
from tallymark.functions import bits as b
from tallymark.functions import errors, estimators, labels
from tallymark.functions.bias import subtract_bias
from tallymark.functions.hashing import hash32, register_hash, resolve_hash, with_hash
from tallymark.operators import exact, extend, sketches, sparse
from tallymark.operators.cells import levels, registers, summarize
from tallymark.operators.estimate import distinct_estimates
from tallymark.operators.spec import SketchSpec, requested_algorithms, sketch, sweep_specs
from tallymark.plans import grid
from tallymark.sources import generators, run_files
from tallymark.sources.scratch import scratch_folder

FLAG = ["l_returnflag"]
XX42 = resolve_hash("xxhash64", 42)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# --- sources and generators -----------------------------------------------------------


@query("src1_scan_runs", f"SELECT * FROM {ORDER_RUNS}")
def src1(spark, sf_dir):
    return order_runs(spark, sf_dir)


RUN_ELEMENTS = 4096


def _write_run_file(folder: str):
    """A function that writes one run, of at most ``RUN_ELEMENTS`` elements, as a file."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        run_id, n = int(rows.run_id.iloc[0]), len(rows)
        is_new = ~rows.value.duplicated().to_numpy()
        blocks = [
            zlib.compress(rows.value.to_numpy().astype("<u4").tobytes()),
            zlib.compress(np.packbits(is_new, bitorder="little").tobytes()),
        ]
        at = run_files.HEADER.size + run_files.ENTRY.size
        distinct = int(is_new.sum())
        header = run_files.HEADER.pack(run_files.MAGIC, run_files.VERSION, n, distinct, 1, run_id)
        entry = run_files.ENTRY.pack(
            at, len(blocks[0]), at + len(blocks[0]), len(blocks[1]), n, distinct,
            run_files.VALUES_U32_LE, run_files.BITS_LE, 0,
        )
        system, inner = run_files.located(f"{folder}/run-{run_id}.bin")
        system.create_dir(inner.rsplit("/", 1)[0])
        # Written under a name of its own first, so that a repeated task leaves no half a file.
        part = f"{inner}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as stream:
            stream.write(header + entry + b"".join(blocks))
        system.move(part, inner)
        return pd.DataFrame({"run_id": [run_id]})

    return write


@query(
    "src2_import_runs",
    f"""WITH s AS (SELECT (o_orderkey // {RUN_ELEMENTS})::BIGINT AS seed,
        (o_orderkey % {RUN_ELEMENTS} + 1)::BIGINT AS pos, o_custkey::BIGINT AS value FROM orders)
    SELECT seed, pos, value, (row_number() OVER (PARTITION BY seed, value ORDER BY pos) = 1)
        AS is_new FROM s""",
)
def src2(spark, sf_dir):
    """Orders written as run files, one per 4,096 of them, and imported again."""
    folder = scratch_folder(spark, "run-files")
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {RUN_ELEMENTS}").alias("run_id"),
        (F.pmod(key, F.lit(RUN_ELEMENTS)) + 1).alias("pos"),
        F.col("o_custkey").alias("value"),
    )
    runs.groupBy("run_id").applyInPandas(_write_run_file(folder), "run_id bigint").count()
    return run_files.read_run_files(spark, folder).select("seed", "pos", "value", "is_new")


@query(
    "src3_integrity",
    f"""WITH s AS (SELECT run_id, count(*) AS n, count(DISTINCT value) AS d FROM {LINE_RUNS}
        GROUP BY run_id), w AS (SELECT max(n) AS n, max(d) AS d FROM s)
    SELECT run_id, 'elements per run' AS rule, w.n::BIGINT AS expected, s.n::BIGINT AS actual
    FROM s, w WHERE s.n <> w.n UNION ALL
    SELECT run_id, 'distinct per run', w.d::BIGINT, s.d::BIGINT FROM s, w WHERE s.d <> w.d""",
)
def src3(spark, sf_dir):
    return exact.integrity_violations(line_runs(spark, sf_dir), is_new=None)


@query(
    "src4_profile",
    f"""SELECT count(*)::BIGINT AS runs, max(n)::BIGINT AS sample_size, max(d)::BIGINT AS f0,
        42::BIGINT AS seed FROM (SELECT run_id, count(*) AS n, count(DISTINCT value) AS d
        FROM {ORDER_RUNS} GROUP BY run_id)""",
)
def src4(spark, sf_dir):
    return exact.dataset_profile(order_runs(spark, sf_dir), seed=42)


@query(
    "src5_first_occurrence",
    f"""SELECT run_id, pos, value, pos = min(pos) OVER (PARTITION BY run_id, value) AS is_new
        FROM {ORDER_RUNS}""",
)
def src5(spark, sf_dir):
    return exact.with_truth_bit(order_runs(spark, sf_dir))


@query("src6_select_runs", f"SELECT * FROM {ORDER_RUNS} WHERE run_id IN (2, 3)")
def src6(spark, sf_dir):
    return exact.select_runs(order_runs(spark, sf_dir), [2, 3])


# The generators are driven by the positions of the orders, so that the streams grow with
# the table.  Their values are free; what is promised are the counts.
_SIZED = f"(SELECT run_id, max(pos) AS n FROM {ORDER_RUNS} GROUP BY run_id)"


@query(
    "gen1_uniform",
    f"""SELECT run_id, n::BIGINT AS n, (n // 5)::BIGINT AS d, true AS in_range
        FROM {_SIZED}""",
)
def gen1(spark, sf_dir):
    places = order_runs(spark, sf_dir).select("run_id", "pos")
    n = places.agg(F.max("pos")).scalar()
    stream = generators.uniform_values(places, n, F.floor(n / 5), 42)
    per_value = stream.groupBy("run_id", "value").agg(F.count(F.lit(1)).alias("times"))
    return per_value.groupBy("run_id").agg(
        F.sum("times").alias("n"),
        F.count("value").alias("d"),
        ((F.min("value") >= 0) & (F.max("value") < F.sum("times"))).alias("in_range"),
    )


@query(
    "gen2_constant_rho",
    f"""SELECT run_id, j::BIGINT AS block, (j + 1)::BIGINT AS f0
        FROM {_SIZED}, range(n // 5) r(j)""",
)
def gen2(spark, sf_dir):
    """Distinct values after every block of five positions: exactly one more per block."""
    places = order_runs(spark, sf_dir).select("run_id", "pos")
    n = places.agg(F.max("pos")).scalar()
    stream = generators.constant_rho_values(places, n, F.floor(n / 5), 42)
    first = exact.first_occurrences(stream)
    new = first.withColumn("block", F.expr("(first_pos - 1) div 5")).groupBy("run_id", "block")
    so_far = Window.partitionBy("run_id").orderBy("block")
    return new.agg(F.count(F.lit(1)).alias("new")).select(
        "run_id", "block", F.sum("new").over(so_far).alias("f0")
    )


@query(
    "gen3_run_seed",
    f"""SELECT s_suppkey::BIGINT AS run, {q.signed('s')} AS run_seed FROM
        (SELECT s_suppkey, {q.add(q.mul('s_suppkey', 0xBF58476D1CE4E5B9), q.u(42 * q.GAMMA))}
         AS s FROM supplier)""",
)
def gen3(spark, sf_dir):
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"))
    return generators.with_run_seed(runs, "run", 42)


@query(
    "gen4_experiment_grid",
    """SELECT DISTINCT n::BIGINT AS n,
        greatest(1, least(n, round_even(n * r, 0)))::BIGINT AS d, s::BIGINT AS seed,
        p AS params, h AS hash
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority),
    (VALUES (0.01::DOUBLE), (0.1), (0.5), (1.0)) a(r), (VALUES (42), (21041998)) b(s),
    (VALUES ('k=10'), ('k=14')) c(p), (VALUES ('splitmix64'), ('xxhash64')) e(h)""",
)
def gen4(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")
    )
    return grid.experiment_grid(
        spark, sizes, seeds=[42, 21041998], params=["k=10", "k=14"],
        hashes=["splitmix64", "xxhash64"],
    )


# --- hashes ---------------------------------------------------------------------------


def _hash_sql(name: str, seed: int) -> str:
    return (
        f"SELECT key, v AS value, {q.signed()} AS h FROM "
        f"{q.hashed('orders', 'o_orderkey AS key', 'o_custkey', name, seed)}"
    )


def _hash_query(spark, sf_dir, name, seed):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")
    )
    return with_hash(rows, "value", name, seed, "h")


for _name, _hash, _seed in (
    ("hsh1_splitmix64", "splitmix64", 7),
    ("hsh2_xxhash64", "xxhash64", 42),
    ("hsh2_xxhash64_seeded", "xxhash64", 21041998),
    ("hsh3_murmurhash3", "murmurhash3", 17),
    ("hsh4_siphash24", "siphash24", 5),
):
    query(_name, lambda h=_hash, s=_seed: _hash_sql(h, s))(
        lambda spark, sf_dir, h=_hash, s=_seed: _hash_query(spark, sf_dir, h, s)
    )


@query(
    "hsh5_hash32",
    lambda: f"SELECT key, v AS value, (h >> 32)::BIGINT AS h32 FROM "
    f"{q.hashed('orders', 'o_orderkey AS key', 'o_custkey')}",
)
def hsh5(spark, sf_dir):
    return _hash_query(spark, sf_dir, "splitmix64", 0).select(
        "key", "value", hash32(F.col("h")).alias("h32")
    )


ALIASES = (
    ("Split-Mix", "splitmix64"), ("XXHash", "xxhash64"), ("Murmur_3", "murmurhash3"),
    ("murmur", "murmurhash3"), ("", "splitmix64"),
)


@query(
    "hsh6_registry",
    lambda: " UNION ALL ".join(
        f"SELECT '{alias}' AS name, {q.signed('bit_xor(h)')} AS folded FROM "
        f"{q.hashed('orders', '', 'o_custkey', name, 17)}"
        for alias, name in ALIASES
    ),
)
def hsh6(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("value"))
    for i, (alias, _) in enumerate(ALIASES):
        rows = with_hash(rows, "value", alias, 17, f"h{i}")
    folded = rows.agg(*[F.bit_xor(f"h{i}").alias(f"h{i}") for i in range(len(ALIASES))])
    named = [
        F.struct(F.lit(alias).alias("name"), F.col(f"h{i}").alias("folded"))
        for i, (alias, _) in enumerate(ALIASES)
    ]
    return folded.select(F.inline(F.array(*named)))


# --- bits -----------------------------------------------------------------------------

_HASHED_ORDERS = q.hashed("orders", "o_orderkey AS key", "o_custkey")


@query(
    "bit1_register_update",
    f"SELECT key, {q.index('h', 10)} AS idx, {q.rank('h', 10, 32)} AS rho FROM {_HASHED_ORDERS}",
)
def bit1(spark, sf_dir):
    h = F.col("h")
    return _hash_query(spark, sf_dir, "splitmix64", 0).select(
        "key",
        b.register_idx(h, 10).alias("idx"),
        b.rho32(b.register_rho(h, 10), 10).cast("int").alias("rho"),
    )


@query(
    "bit2_dense_update",
    f"SELECT key, {q.index('h', 14)} AS idx, {q.rank('h', 14)} AS rho FROM {_HASHED_ORDERS}",
)
def bit2(spark, sf_dir):
    h = F.col("h")
    return _hash_query(spark, sf_dir, "splitmix64", 0).select(
        "key", b.register_idx(h, 14).alias("idx"), b.register_rho(h, 14).alias("rho")
    )


def _pc_bit(length: int) -> str:
    x = f"((h >> 32) & {q.u((1 << length) - 1)})"
    return (
        f"CASE WHEN {x} = 0 THEN 0 ELSE 1::BIGINT << "
        f"(length(bin({x})) - length(rtrim(bin({x}), '0')))::INT END"
    )


@query("bit3_bitmap_update", f"SELECT key, ({_pc_bit(31)})::BIGINT AS bit FROM {_HASHED_ORDERS}")
def bit3(spark, sf_dir):
    return _hash_query(spark, sf_dir, "splitmix64", 0).select(
        "key", b.bitmap_bit(F.col("h")).alias("bit")
    )


_CODES = f"(SELECT key, {q.index('h', 25)} AS idx, {q.rank('h', 25)} AS rho FROM {_HASHED_ORDERS})"


@query(
    "bit4_sparse_encode",
    f"""SELECT key, idx AS sparse_idx, (idx::BIGINT * 128 + CASE WHEN (idx & 2047) = 0
        THEN rho * 2 + 1 ELSE 0 END)::BIGINT AS entry FROM {_CODES}""",
)
def bit4(spark, sf_dir):
    h = F.col("h")
    code, rho = b.sparse_code(h), b.register_rho(h, b.SPARSE_PRECISION)
    return _hash_query(spark, sf_dir, "splitmix64", 0).select(
        "key", code.alias("sparse_idx"), b.sparse_entry(code, rho, 14).alias("entry")
    )


@query(
    "bit5_sparse_decode",
    f"SELECT key, {q.index('h', 14)} AS idx, {q.rank('h', 14)} AS rho FROM {_HASHED_ORDERS}",
)
def bit5(spark, sf_dir):
    """Decoding a sparse code gives the registers of the dense update."""
    h = F.col("h")
    coded = _hash_query(spark, sf_dir, "splitmix64", 0).select(
        "key",
        b.sparse_code(h).alias("code"),
        b.register_rho(h, b.SPARSE_PRECISION).alias("crho"),
    )
    return coded.select(
        "key",
        b.reduced_idx(F.col("code"), 25, 14).cast("int").alias("idx"),
        b.reduced_rho(F.col("code"), F.col("crho"), 25, 14).alias("rho"),
    )


# --- labels and small functions -------------------------------------------------------


@query(
    "mth1_theoretical_rse",
    """SELECT c_custkey, a AS algo, k, round(CASE WHEN a IN ('hll', 'hllpp')
        THEN 1.04::DOUBLE / sqrt(pow(2.0::DOUBLE, k)) WHEN a = 'll'
        THEN 1.30::DOUBLE / sqrt(pow(2.0::DOUBLE, k)) ELSE NULL END, 9) AS rse
    FROM (SELECT c_custkey, (4 + c_nationkey % 13)::INT AS k FROM customer),
    (VALUES ('hllpp'), ('hll'), ('ll'), ('pc')) t(a)""",
)
def mth1(spark, sf_dir):
    algos = F.explode(F.array(*[F.lit(a) for a in labels.PUBLIC_ALGORITHMS])).alias("algo")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_nationkey") % 13 + 4).cast("int").alias("k"), algos
    )
    rse = errors.null_if_nan(estimators.theoretical_rse(F.col("algo"), F.col("k")))
    return rows.select("c_custkey", "algo", "k", F.round(rse, 9).alias("rse"))


@query(
    "flt3_choose_algorithms",
    """SELECT a AS algo, count(*)::BIGINT AS customers FROM customer,
        (VALUES ('hllpp'), ('ll')) t(a) GROUP BY a""",
)
def flt3(spark, sf_dir):
    algos = F.explode(F.array(*[F.lit(a) for a in labels.PUBLIC_ALGORITHMS])).alias("algo")
    rows = table(spark, sf_dir, "customer").select(algos)
    chosen = rows.where(F.col("algo").isin(*requested_algorithms(["LL", "HLLpp"])))
    return chosen.groupBy("algo").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "str1_sanitize",
    """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url,
        '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), ''), 'default') AS label FROM pages""",
)
def str1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", labels.sanitize(F.col("url")).alias("label")
    )


@query(
    "str2_algorithm_names",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'HyperLogLog++' WHEN 1 THEN
        'HyperLogLog' WHEN 2 THEN 'LogLog' WHEN 3 THEN 'Probabilistic Counting' WHEN 4 THEN
        'Naive' END AS name FROM orders""",
)
def str2(spark, sf_dir):
    spellings = F.array(*[F.lit(s) for s in ("HLL-pp", "h-l-l", "LL", "P.C.", "naive", "hll++")])
    index = (F.pmod(F.col("o_orderkey"), F.lit(6)) + 1).cast("int")
    spelled = F.element_at(spellings, index)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.algorithm_name_of(spelled).alias("name")
    )


@query(
    "str3_params_text",
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'k=' || k WHEN c_nationkey % 3 = 1
        THEN 'k=' || k || ',L=32' ELSE 'L=' || k END AS params,
        CASE WHEN c_nationkey % 3 = 2 THEN -1 ELSE k END AS k,
        CASE WHEN c_nationkey % 3 = 0 THEN -1 WHEN c_nationkey % 3 = 1 THEN 32 ELSE k END AS l
    FROM (SELECT c_custkey, c_nationkey, (4 + c_nationkey % 13)::INT AS k FROM customer)""",
)
def str3(spark, sf_dir):
    kind = F.col("c_nationkey") % 3
    number = (F.col("c_nationkey") % 13 + 4).cast("int")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        labels.params_text(
            F.when(kind != 2, number),
            F.when(kind == 1, F.lit(32)).when(kind == 2, number),
        ).alias("params"),
    )
    return rows.select(
        "c_custkey",
        "params",
        F.coalesce(labels.param_value(F.col("params"), "k"), F.lit(-1)).alias("k"),
        F.coalesce(labels.param_value(F.col("params"), "L"), F.lit(-1)).alias("l"),
    )


@query(
    "str4_path_fields",
    """SELECT o_orderkey, 'family_rev' AS scenario, (o_custkey + 1)::BIGINT AS d,
        'murmurhash3' AS left_hash, o_orderkey::BIGINT AS left_hash_seed,
        'xxhash64' AS right_hash, 17::BIGINT AS right_hash_seed, 10::INT AS left_k,
        (4 + o_orderkey % 15)::INT AS right_k, 'unsafe_naive_merge' AS strategy FROM orders""",
)
def str4(spark, sf_dir):
    c = lambda e: e.cast("string")
    path = F.concat(
        F.lit("/results/merge_hpp_hash_mismatch_min_family_rev_d_"),
        c(F.col("o_custkey") + 1),
        F.lit("/merge_heterogeneous/hllpp/left_murmurhash3_seed_"),
        c(F.col("o_orderkey")),
        F.lit("_right_xxhash64_seed_17/left_k_10_right_k_"),
        c(F.col("o_orderkey") % 15 + 4),
        F.lit("_strategy_unsafe_naive_merge/results_merge_heterogeneous.csv"),
    )
    fields = labels.path_fields(path)
    names = (
        "scenario", "d", "left_hash", "left_hash_seed", "right_hash", "right_hash_seed",
        "left_k", "right_k", "strategy",
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", *[fields[n].alias(n) for n in names]
    )


# --- aggregations ---------------------------------------------------------------------

_EXACT = """SELECT l_returnflag, count(DISTINCT l_orderkey)::BIGINT AS exact FROM lineitem
    GROUP BY l_returnflag"""


@query("agg1_exact", _EXACT)
def agg1(spark, sf_dir):
    return exact.exact_distinct(lines(spark, sf_dir), FLAG, "l_orderkey")


@query("agg1_exact_bitmaps", _EXACT)
def agg1_bitmaps(spark, sf_dir):
    return exact.dense_distinct(lines(spark, sf_dir), FLAG, "l_orderkey")


def _line_hashes(name: str = "splitmix64", seed: int = 0) -> str:
    return q.hashed("lineitem", "l_returnflag, l_suppkey", "l_orderkey", name, seed)


def _one(spark, sf_dir, keys, spec: SketchSpec, mode: str = "dense"):
    rows = distinct_estimates(lines(spark, sf_dir), keys, "l_orderkey", [spec], mode)
    return rows.select(*keys, "estimate")


for _name, _spec, _keys in (
    ("agg2_probabilistic_counting", sketch("pc", l=20), FLAG),
    ("agg2_probabilistic_counting_by_supplier", sketch("pc", l=31), ["l_suppkey"]),
    ("agg3_loglog", sketch("ll", 10), FLAG),
    ("agg3_loglog_by_supplier", sketch("ll", 6), ["l_suppkey"]),
    ("agg4_hyperloglog", sketch("hll", 12, hash="xxhash64", seed=42), FLAG),
    ("agg4_hyperloglog_by_supplier", sketch("hll", 5), ["l_suppkey"]),
    ("agg5_hllpp_dense", sketch("hllpp", 14), FLAG),
    ("agg5_hllpp_dense_by_supplier", sketch("hllpp", 8), ["l_suppkey"]),
    ("agg5_hllpp_dense_small", sketch("hllpp", 4, hash="xxhash64", seed=42), ["l_suppkey"]),
):
    query(
        _name,
        lambda s=_spec, ks=_keys: "SELECT * FROM "
        + q.estimate(s.algo, _line_hashes(s.hash.name, s.hash.seed), ks, s.k, s.l),
    )(lambda spark, sf_dir, s=_spec, ks=_keys: _one(spark, sf_dir, ks, s))


@query(
    "agg6_bias_correction",
    lambda: "SELECT l_suppkey, round(raw, 6) AS raw, round(corrected, 6) AS corrected FROM "
    + q.corrected(q.registers(_line_hashes(), ["l_suppkey"], 6), ["l_suppkey"], 6),
)
def agg6(spark, sf_dir):
    cells = registers(lines(spark, sf_dir), ["l_suppkey"], "l_orderkey", 6, resolve_hash())
    sums = summarize(cells.withColumn("k", F.lit(6)), ["l_suppkey"])
    c = F.col
    inverse = estimators.inverse_sum(c("inv_high"), c("inv_low"), c("occupied"), 6)
    raw = sums.withColumn("raw", estimators.raw_estimate(inverse, 6))
    fixed = subtract_bias(raw, "raw", "k", [6])
    return rounded(fixed.select("l_suppkey", "raw", "corrected"))


@query(
    "agg8_sparse_estimate",
    lambda: "SELECT * FROM "
    + q.hllpp_sparse(q.registers(_line_hashes(), ["l_suppkey"], 25), ["l_suppkey"]),
)
def agg8(spark, sf_dir):
    return _one(spark, sf_dir, ["l_suppkey"], sketch("hllpp", 14), "sparse")


@query("agg9_sparse_codes", lambda: "SELECT * FROM " + q.registers(_line_hashes(), FLAG, 25))
def agg9(spark, sf_dir):
    return registers(lines(spark, sf_dir), FLAG, "l_orderkey", 25, resolve_hash())


@query(
    "agg10_format_choice",
    lambda: " UNION ALL ".join(
        f"SELECT l_returnflag, {k}::INT AS k, n_codes, "
        f"n_codes >= 4096 AND list_bits > {6 << k} AS dense FROM "
        + q.list_bits(q.registers(_line_hashes(), FLAG, 25), FLAG, k)
        for k in (10, 13, 14, 15, 16)
    ),
)
def agg10(spark, sf_dir):
    ks = [10, 13, 14, 15, 16]
    codes = registers(lines(spark, sf_dir), FLAG, "l_orderkey", 25, resolve_hash())
    summary = summarize(levels(codes, FLAG, 25, [*ks, 25]), FLAG)
    return sparse.with_format(summary, codes, FLAG, ks).select(
        "l_returnflag", "k", "n_codes", "dense"
    )


@query(
    "agg10_hllpp_auto",
    lambda: " UNION ALL ".join(
        f"SELECT l_returnflag, 'k={k}' AS params, estimate FROM "
        + q.hllpp_auto(_line_hashes(), FLAG, k)
        for k in (10, 14, 16)
    ),
)
def agg10_auto(spark, sf_dir):
    specs = [sketch("hllpp", k) for k in (10, 14, 16)]
    rows = distinct_estimates(lines(spark, sf_dir), FLAG, "l_orderkey", specs, "auto")
    return rows.select("l_returnflag", "params", "estimate")


#: One key with most orders, one with few, and null: on both sides of the switch.
UNEVEN = (
    "CASE WHEN l_suppkey % 16 = 0 THEN 'few' WHEN l_suppkey % 16 = 1 THEN NULL ELSE 'many' END"
)


def _uneven_hashes() -> str:
    return q.hashed(f"(SELECT {UNEVEN} AS part, l_orderkey FROM lineitem)", "part", "l_orderkey")


for _name, _ks in (("agg10_hllpp_auto_settled", (12, 13)), ("agg10_hllpp_auto_uneven", (14, 16))):

    def _uneven_auto(spark, sf_dir, ks=_ks):
        rows = lines(spark, sf_dir).select(F.expr(UNEVEN).alias("part"), "l_orderkey")
        specs = [sketch("hllpp", k) for k in ks]
        found = distinct_estimates(rows, ["part"], "l_orderkey", specs, "auto")
        return found.select("part", "params", "estimate")

    query(
        _name,
        lambda ks=_ks: " UNION ALL ".join(
            f"SELECT part, 'k={k}' AS params, estimate FROM "
            + q.hllpp_auto(_uneven_hashes(), ["part"], k)
            for k in ks
        ),
    )(_uneven_auto)


@query("agg11_sparse_to_dense", lambda: "SELECT * FROM " + q.registers(_line_hashes(), FLAG, 12))
def agg11(spark, sf_dir):
    table_ = sketches.build_sketches(
        lines(spark, sf_dir), FLAG, "l_orderkey", sketch("hllpp", 12), sparse_resolution=True
    )
    dense = sketches.to_dense(table_, FLAG)
    return dense.select("l_returnflag", F.col("idx").cast("int").alias("idx"), "rho")


# --- merge and reduction --------------------------------------------------------------


@query(
    "mrg1_exact_union",
    """SELECT (l_suppkey // 10)::INT AS region, count(DISTINCT l_partkey)::BIGINT AS exact
        FROM lineitem GROUP BY 1""",
)
def mrg1(spark, sf_dir):
    values = exact.exact_values(lines(spark, sf_dir), ["l_suppkey"], "l_partkey")
    coarse = values.withColumn("region", F.expr("cast(l_suppkey div 10 as int)"))
    return exact.exact_union(coarse, ["region"], "l_partkey")


def _merged(spark, sf_dir, spec: SketchSpec, sparse_resolution: bool = False, mode: str = "dense"):
    """Sketches per (flag, supplier), rolled up to the flag, then estimated."""
    table_ = sketches.build_sketches(
        lines(spark, sf_dir), ["l_returnflag", "l_suppkey"], "l_orderkey", spec, sparse_resolution
    )
    merged = sketches.merge_sketches(table_, FLAG)
    ks = [spec.k] if spec.k else None
    rows = sketches.estimate_sketches(merged, FLAG, mode, ks, [spec.algo])
    return rows.select("l_returnflag", "estimate")


for _name, _spec in (
    ("mrg2_merge_pc", sketch("pc", l=31)),
    ("mrg3_merge_loglog", sketch("ll", 10)),
    ("mrg4_merge_hyperloglog", sketch("hll", 10)),
    ("mrg5_merge_hllpp_dense", sketch("hllpp", 12)),
):
    query(
        _name,
        lambda s=_spec: "SELECT * FROM "
        + q.estimate(s.algo, _line_hashes(), FLAG, s.k, s.l),
    )(lambda spark, sf_dir, s=_spec: _merged(spark, sf_dir, s))


@query(
    "mrg5_merge_hllpp_sparse",
    lambda: "SELECT * FROM " + q.hllpp_auto(_line_hashes(), FLAG, 14),
)
def mrg5_sparse(spark, sf_dir):
    return _merged(spark, sf_dir, sketch("hllpp", 14), True, "auto")


@query(
    "mrg6_incompatible_groups",
    """SELECT l_returnflag, 3::BIGINT AS identities FROM lineitem GROUP BY l_returnflag""",
)
def mrg6(spark, sf_dir):
    """Three kinds of sketches put under one key are found out."""
    rows = lines(spark, sf_dir)
    mixed = None
    for spec in (sketch("hll", 8), sketch("ll", 8), sketch("hll", 8, hash="xxhash64", seed=1)):
        part = sketches.build_sketches(rows, FLAG, "l_orderkey", spec)
        mixed = part if mixed is None else mixed.unionByName(part)
    return sketches.incompatible_groups(mixed, FLAG).select("l_returnflag", "identities")


def _reduced(spark, sf_dir, naive: bool):
    table_ = sketches.build_sketches(lines(spark, sf_dir), FLAG, "l_orderkey", sketch("hllpp", 14))
    reduced = sketches.reduce_precision(table_, FLAG, 10, naive)
    return reduced.select("l_returnflag", F.col("idx").cast("int").alias("idx"), "rho")


@query("mrg7_reduce_precision", lambda: "SELECT * FROM " + q.registers(_line_hashes(), FLAG, 10))
def mrg7(spark, sf_dir):
    return _reduced(spark, sf_dir, False)


@query(
    "mrg8_reduce_naive",
    lambda: "SELECT * FROM " + q.reduce(q.registers(_line_hashes(), FLAG, 14), FLAG, 14, 10, True),
)
def mrg8(spark, sf_dir):
    return _reduced(spark, sf_dir, True)


def _contexts(spark, sf_dir) -> DataFrame:
    """Pairs of sketch contexts made from the customers, with a strategy each."""
    hashes = F.array(F.lit("splitmix64"), F.lit("xxhash64"))
    strategies = F.array(*[F.lit(s) for s in grid.STRATEGIES])
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.element_at(hashes, (key % 2 + 1).cast("int")).alias("left_hash"),
        F.element_at(hashes, (nation % 2 + 1).cast("int")).alias("right_hash"),
        (key % 3).alias("left_hash_seed"),
        (nation % 3).cast("bigint").alias("right_hash_seed"),
        (key % 2 + 10).cast("int").alias("left_k"),
        (F.floor(key / 2) % 2 + 10).cast("int").alias("right_k"),
        F.element_at(strategies, (F.floor(key / 4) % 4 + 1).cast("int")).alias("strategy"),
    )


_CONTEXTS = """(SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'splitmix64' ELSE 'xxhash64' END
    = CASE c_nationkey % 2 WHEN 0 THEN 'splitmix64' ELSE 'xxhash64' END
    AND c_custkey % 3 = c_nationkey % 3 AS same_hash,
    c_custkey % 2 = (c_custkey // 2) % 2 AS same_k,
    CASE (c_custkey // 4) % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'direct' WHEN 2
    THEN 'reduce_then_merge' ELSE 'unsafe_naive_merge' END AS strategy FROM customer)"""
_VALIDITY = """CASE WHEN same_hash AND same_k THEN 'valid' WHEN same_hash THEN 'recoverable'
    ELSE 'invalid' END"""


@query("mrg9_compatibility", f"SELECT c_custkey, {_VALIDITY} AS validity FROM {_CONTEXTS}")
def mrg9(spark, sf_dir):
    return _contexts(spark, sf_dir).select("c_custkey", grid.pair_validity().alias("validity"))


@query(
    "mrg10_legal_strategies",
    f"""SELECT c_custkey, strategy, validity FROM (SELECT *, {_VALIDITY} AS validity
        FROM {_CONTEXTS}) WHERE strategy = 'reject' OR (strategy = 'direct' AND validity = 'valid')
        OR (strategy = 'reduce_then_merge' AND validity = 'recoverable')
        OR (strategy = 'unsafe_naive_merge' AND validity <> 'valid')""",
)
def mrg10(spark, sf_dir):
    legal = grid.legal_pairs(_contexts(spark, sf_dir))
    return legal.select("c_custkey", "strategy", "validity")


@query(
    "mrg12_rollup",
    lambda: " UNION ALL ".join(
        f"SELECT '{level}' AS level, {key}::BIGINT AS key, estimate FROM "
        + q.estimate(
            "hll",
            q.hashed(
                "lineitem", "l_suppkey // 10 AS ten, l_suppkey // 50 AS fifty, 0 AS every",
                "l_orderkey",
            ),
            [key], 10,
        )
        for level, key in (("ten", "ten"), ("fifty", "fifty"), ("every", "every"))
    ),
)
def mrg12(spark, sf_dir):
    """One stored sketch table answers every coarser key."""
    spec = sketch("hll", 10)
    base = sketches.build_sketches(lines(spark, sf_dir), ["l_suppkey"], "l_orderkey", spec)
    tens = sketches.merge_sketches(
        base.withColumn("ten", F.expr("l_suppkey div 10")), ["ten"], verify=False, combine=False
    )
    keys = F.array(
        F.struct(F.lit("ten").alias("level"), F.col("ten").alias("key")),
        F.struct(F.lit("fifty").alias("level"), F.expr("ten div 5").alias("key")),
        F.struct(F.lit("every").alias("level"), F.lit(0).cast("bigint").alias("key")),
    )
    unfolded = tens.select(F.inline(keys), *sketches.IDENTITY, "idx", "rho")
    merged = sketches.merge_sketches(unfolded, ["level", "key"], verify=False)
    rows = sketches.estimate_sketches(merged, ["level", "key"], "dense", [10], ["hll"])
    return rows.select("level", "key", "estimate")


@query(
    "set1_bag_union",
    f"SELECT run_id, value FROM {ORDER_RUNS} UNION ALL SELECT run_id, value FROM {LINE_RUNS}",
)
def set1(spark, sf_dir):
    return order_runs(spark, sf_dir).drop("pos").unionByName(line_runs(spark, sf_dir))


@query(
    "set2_distinct_sizes",
    f"""SELECT DISTINCT d::BIGINT AS d FROM (SELECT count(DISTINCT value) AS d
        FROM {ORDER_RUNS} GROUP BY run_id)""",
)
def set2(spark, sf_dir):
    return exact.run_sizes(order_runs(spark, sf_dir)).select("d").distinct()


@query("jon1_pair_runs", f"SELECT pair_index, side, value FROM {pairs_of(LINE_RUNS)}")
def jon1(spark, sf_dir):
    return exact.pair_runs(line_runs(spark, sf_dir)).select("pair_index", "side", "value")


# Fixed values of the test tables.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "jon3_context_pairs",
    f"""SELECT a.o_orderpriority AS left_name, b AS right_name, s AS strategy
        FROM (SELECT DISTINCT o_orderpriority FROM orders) a,
        (SELECT unnest({list(PRIORITIES)!r}) AS b), (VALUES ('reject'), ('direct')) t(s)
        WHERE s = 'reject' OR a.o_orderpriority = b""",
)
def jon3(spark, sf_dir):
    """Contexts named after the priorities found, against the list of priorities."""
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("left_hash")).distinct()
    found = names.select("left_hash", F.lit(1).cast("bigint").alias("left_hash_seed"), F.lit(10).alias("left_k"))
    known = [(name, 1, 10) for name in PRIORITIES]
    pairs = grid.context_pairs(spark, found, known, ["reject", "direct"])
    return grid.legal_pairs(pairs).select(
        F.col("left_hash").alias("left_name"), F.col("right_hash").alias("right_name"), "strategy"
    )


# --- sweeps and extensions ------------------------------------------------------------


@query(
    "evl5_parameter_sweep",
    lambda: f"WITH hs AS MATERIALIZED (SELECT * FROM {_line_hashes()}) "
    + " UNION ALL ".join(
        f"SELECT l_returnflag, '{s.algo}' AS algorithm, '{s.params}' AS params, estimate FROM "
        + q.estimate(s.algo, "hs", FLAG, s.k, s.l)
        for s in sweep_specs()
    ),
)
def evl5(spark, sf_dir):
    """All algorithms and precisions from one scan and one shuffle of the raw rows."""
    specs = sweep_specs()
    rows = distinct_estimates(lines(spark, sf_dir), FLAG, "l_orderkey", specs)
    return rows.select("l_returnflag", "algorithm", "params", "estimate")


class LinearCounting:
    """A bitmap of 2**16 cells with linear counting, as an example of an own algorithm."""

    name = "linear_counting_16"

    def project(self, h):
        return b.register_idx(h, 16), F.lit(1)

    def combine(self, state):
        return F.max(state)

    def summarize(self, idx, state):
        return {"used": F.count(idx)}

    def estimate(self, summary):
        cells = F.lit(65536.0)
        return estimators.truncate(estimators.linear_counting(cells, cells - summary["used"]))


extend.register_algorithm(LinearCounting())


@query(
    "udx1_custom_algorithm",
    lambda: f"""SELECT l_returnflag, floor(65536::DOUBLE * ln(65536::DOUBLE /
        (65536 - count(DISTINCT {q.index('h', 16)}))))::BIGINT AS estimate
        FROM {_line_hashes()} GROUP BY l_returnflag""",
)
def udx1(spark, sf_dir):
    name = LinearCounting.name
    built = extend.build_custom(
        lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], "l_orderkey", name, resolve_hash()
    )
    return extend.estimate_custom(extend.merge_custom(built, FLAG, name), FLAG, name)




_LAW_COUNTS = {
    "max": ["0", "0", "0", "0"],
    "sum": ["0", "count_if(a <> 0)", "0", "0"],
    "avg": ["0", "0", "0", "count_if(a <> c OR a + c <> 2 * b)"],
}


@query(
    "udx3_algorithm_laws",
    lambda: " UNION ALL ".join(
        f"""SELECT '{name}' AS combine, '{law}' AS law, count(*)::BIGINT AS cases,
        {count}::BIGINT AS violations FROM (SELECT o_custkey AS a, o_orderkey AS b,
        o_orderkey % 7 AS c FROM orders)"""
        for name, counts in _LAW_COUNTS.items()
        for law, count in zip(extend.LAWS, counts)
    ),
)
def udx3(spark, sf_dir):
    """Which laws the ways of merging keep or break, over the states of a whole table."""
    states = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("a"),
        F.col("o_orderkey").alias("b"),
        F.pmod(F.col("o_orderkey"), F.lit(7)).alias("c"),
    )
    out = None
    for name, combine in (("max", F.max), ("sum", F.sum), ("avg", F.avg)):
        rows = extend.law_violations(states, combine, "o_orderkey")
        rows = rows.select(F.lit(name).alias("combine"), "law", "cases", "violations")
        out = rows if out is None else out.unionByName(rows)
    return out


def _md5_top(df: DataFrame, value: str, seed: int, out: str) -> DataFrame:
    """The first 64 bits of the MD5 of ``seed:value``, as an example of an own hash."""
    text = F.concat(F.lit(f"{seed}:"), F.col(value).cast("string"))
    return df.withColumn(out, F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("bigint"))


register_hash("md5top", _md5_top)


@query(
    "udx2_custom_hash",
    lambda: "SELECT * FROM "
    + q.estimate(
        "hll",
        """(SELECT l_returnflag, l_suppkey,
            ('0x' || substr(md5('7:' || l_orderkey::BIGINT::VARCHAR), 1, 16))::UBIGINT AS h
            FROM lineitem WHERE l_orderkey IS NOT NULL)""",
        FLAG,
        12,
    ),
)
def udx2(spark, sf_dir):
    return _one(spark, sf_dir, FLAG, sketch("hll", 12, hash="md5top", seed=7))
