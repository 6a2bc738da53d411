"""Queries over evaluations, reports, result tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks import sqltext as q
from checks.registry import (
    EVENT_RUN,
    GROWING_RUNS,
    LATE_RUNS,
    LINE_RUNS,
    ORDER_RUNS,
    event_run,
    growing_runs,
    late_runs,
    line_runs,
    order_runs,
    pairs_of,
    query,
    rounded,
    rounded_sql,
    run_length,
    table,
)
from tallymark.functions import errors
from tallymark.functions.labels import HASH_ORDER, SCENARIO_LABELS, order_of
from tallymark.operators import exact, statistics
from tallymark.operators.sketches import build_sketches
from tallymark.operators.spec import SketchSpec, sketch
from tallymark.plans import grid, merge_eval, prefix, reports
from tallymark.plans.checkpoints import checkpoint_plan, interval_of
from tallymark.sources import results
from tallymark.sources.scratch import scratch_folder
from tallymark.streaming import live

SEED = 42
BUDGET = 200

# --- prefix evaluation ----------------------------------------------------------------

PREFIX_SPECS = [
    sketch("hllpp", 10),
    sketch("hllpp", 14),
    sketch("hll", 10),
    sketch("ll", 10),
    sketch("pc", l=31),
    SketchSpec("naive"),
]
NAMES = {"hllpp": "HyperLogLog++", "hll": "HyperLogLog", "ll": "LogLog",
         "pc": "Probabilistic Counting", "naive": "Naive"}


def _length_of(runs: str) -> str:
    return f"(SELECT max(pos) FROM {runs})"


def points_sql(runs: str) -> str:
    return f"WITH src AS MATERIALIZED (SELECT * FROM {runs}), pts AS MATERIALIZED (" \
        f"SELECT t FROM {q.plan_points(_length_of(runs), BUDGET)}) "


def prefix_estimates_sql(runs: str, specs=PREFIX_SPECS) -> str:
    """run_id, t, truth, algorithm, params, estimate by brute force over every prefix."""
    keys = ["run_id", "t"]
    parts = []
    for s in specs:
        if s.algo == "naive":
            body = "(SELECT run_id, t, truth AS estimate FROM tru)"
        else:
            body = q.estimate(s.algo, "pre", keys, s.k, s.l)
        parts.append(
            f"SELECT e.run_id, e.t, u.truth, '{s.algo}' AS algorithm, '{s.params}' AS params, "
            f"e.estimate FROM {body} e JOIN tru u ON e.run_id = u.run_id AND e.t = u.t"
        )
    return (
        points_sql(runs)
        + f", hsh AS MATERIALIZED (SELECT * FROM {q.hashed('src', 'run_id, pos', 'value')}), "
        "pre AS MATERIALIZED (SELECT run_id, t, v, h FROM hsh JOIN pts ON pos <= t), "
        "tru AS MATERIALIZED (SELECT run_id, t, count(DISTINCT v)::BIGINT AS truth FROM pre "
        "GROUP BY run_id, t), est AS MATERIALIZED (" + " UNION ALL ".join(parts) + ") "
    )


STAT_DOUBLES = [
    "f0_mean_t", "f0_hat_mean_t", "variance", "stddev", "rse_observed", "bias",
    "absolute_bias", "relative_bias", "mean_relative_error", "rmse", "mae",
]
_STATS = """SELECT algorithm, params, t, count(*)::BIGINT AS runs, avg(truth) AS f0_mean_t,
    avg(estimate) AS f0_hat_mean_t, coalesce(var_samp(estimate), 0.0) AS variance,
    sqrt(coalesce(var_samp(estimate), 0.0)) AS stddev,
    sqrt(coalesce(var_samp(estimate), 0.0)) / avg(truth) AS rse_observed,
    avg(estimate) - avg(truth) AS bias, abs(avg(estimate) - avg(truth)) AS absolute_bias,
    (avg(estimate) - avg(truth)) / avg(truth) AS relative_bias,
    avg(CASE WHEN truth > 0 THEN abs(estimate - truth) / truth ELSE 0 END) AS mean_relative_error,
    sqrt(avg((estimate - truth) * (estimate - truth))) AS rmse,
    avg(abs(estimate - truth)) AS mae FROM est GROUP BY algorithm, params, t"""


def prefix_eval_sql(runs: str, specs=PREFIX_SPECS) -> str:
    """CTEs ending in ``pe``: the result rows of a prefix evaluation."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())
    k = "nullif(regexp_extract(params, 'k=(\\d+)', 1), '')::INT"
    return prefix_estimates_sql(runs, specs) + f""", st AS ({_STATS}),
    pe AS MATERIALIZED (SELECT CASE algorithm {cases} END AS algorithm, params,
        'streaming' AS mode, runs, (SELECT max(pos) FROM src)::BIGINT AS sample_size,
        t::BIGINT AS number_of_elements_processed,
        floor(arg_max(f0_mean_t, t) OVER (PARTITION BY algorithm, params))::BIGINT AS f0,
        {SEED}::BIGINT AS seed, f0_mean_t, f0_hat_mean_t, variance, stddev,
        CASE WHEN algorithm IN ('hll', 'hllpp') THEN 1.04::DOUBLE / sqrt(pow(2.0::DOUBLE, {k}))
        WHEN algorithm = 'll' THEN 1.3::DOUBLE / sqrt(pow(2.0::DOUBLE, {k}))
        ELSE 'nan'::DOUBLE END AS rse_theoretical, rse_observed, bias, absolute_bias,
        relative_bias, mean_relative_error, rmse, mae FROM st) """


def prefix_results(runs: DataFrame, specs=PREFIX_SPECS) -> DataFrame:
    return prefix.prefix_eval(runs, specs, run_length(runs), SEED, BUDGET).drop(
        "hash", "hash_seed"
    )


def _plain_prefix(runs: DataFrame, mode: str = "dense", specs=PREFIX_SPECS) -> DataFrame:
    points = checkpoint_plan(run_length(runs), BUDGET)
    rows = prefix.prefix_estimates(runs, specs, points, mode)
    return rows.select("run_id", "t", "truth", "algorithm", "params", "estimate")


@query(
    "evl1_checkpoint_plan",
    lambda: f"SELECT i::INT AS i, t::BIGINT AS t FROM "
    f"{q.plan_points(f'(SELECT count(*) FROM lineitem)', BUDGET)}",
)
def evl1(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").count()
    rows = list(enumerate(checkpoint_plan(n, BUDGET)))
    return spark.createDataFrame(rows, "i int, t bigint")


@query(
    "jon4_checkpoint_interval",
    lambda: points_sql(ORDER_RUNS)
    + "SELECT run_id, pos, (SELECT count(*) FROM pts WHERE t < pos)::INT AS ckpt FROM src",
)
def jon4(spark, sf_dir):
    runs = order_runs(spark, sf_dir)
    points = checkpoint_plan(run_length(runs), BUDGET)
    return runs.select("run_id", "pos", interval_of(F.col("pos"), points).alias("ckpt"))


@query(
    "win1_prefix_truth",
    lambda: prefix_estimates_sql(ORDER_RUNS, [SketchSpec("naive")])
    + "SELECT run_id, t::BIGINT AS t, truth FROM tru",
)
def win1(spark, sf_dir):
    runs = order_runs(spark, sf_dir)
    return prefix.prefix_truth(runs, checkpoint_plan(run_length(runs), BUDGET))


@query(
    "win2_prefix_estimate",
    lambda: prefix_estimates_sql(ORDER_RUNS)
    + "SELECT run_id, t::BIGINT AS t, truth, algorithm, params, estimate FROM est",
)
def win2(spark, sf_dir):
    return _plain_prefix(order_runs(spark, sf_dir))


def _empty_estimate(s: SketchSpec) -> int:
    """What the formula of a sketch without elements gives."""
    return {"ll": int(0.39701 * (1 << (s.k or 0))), "pc": int(1 / 0.77351)}.get(s.algo, 0)


def late_sql(specs) -> str:
    """Every run at every checkpoint, also before its first value."""
    rows = ", ".join(f"('{s.algo}', '{s.params}', {_empty_estimate(s)})" for s in specs)
    return (
        prefix_estimates_sql(LATE_RUNS, specs)
        + "SELECT f.run_id, f.t::BIGINT AS t, coalesce(u.truth, 0)::BIGINT AS truth, a.algorithm, "
        "a.params, coalesce(e.estimate, a.empty)::BIGINT AS estimate "
        "FROM (SELECT run_id, t FROM (SELECT DISTINCT run_id FROM src), pts) f "
        f"CROSS JOIN (VALUES {rows}) a(algorithm, params, empty) "
        "LEFT JOIN tru u ON u.run_id = f.run_id AND u.t = f.t "
        "LEFT JOIN est e ON e.run_id = f.run_id AND e.t = f.t "
        "AND e.algorithm = a.algorithm AND e.params = a.params"
    )


@query(
    "win1_prefix_truth_late",
    lambda: f"SELECT run_id, t, truth FROM ({late_sql([SketchSpec('naive')])})",
)
def win1_late(spark, sf_dir):
    runs = late_runs(spark, sf_dir)
    return prefix.prefix_truth(runs, checkpoint_plan(run_length(runs), BUDGET))


@query("win2_prefix_estimate_late", lambda: late_sql(PREFIX_SPECS))
def win2_late(spark, sf_dir):
    return _plain_prefix(late_runs(spark, sf_dir))


def _sparse_prefix_sql() -> str:
    keys = ["run_id", "t"]
    return (
        prefix_estimates_sql(EVENT_RUN, [SketchSpec("naive")])
        + f"SELECT e.run_id, e.t::BIGINT AS t, u.truth, 'hllpp' AS algorithm, 'k=12' AS params, "
        f"e.estimate FROM {q.hllpp_auto('pre', keys, 12)} e JOIN tru u USING (run_id, t)"
    )


@query("win2_prefix_estimate_auto", _sparse_prefix_sql)
def win2_auto(spark, sf_dir):
    return _plain_prefix(event_run(spark, sf_dir), "auto", [sketch("hllpp", 12)])


def _growing_sql() -> str:
    keys = ["run_id", "t"]
    rows = " UNION ALL ".join(
        f"SELECT f.run_id, f.t::BIGINT AS t, coalesce(u.truth, 0)::BIGINT AS truth, "
        f"'hllpp' AS algorithm, 'k={k}' AS params, coalesce(e.estimate, 0)::BIGINT AS estimate "
        f"FROM frame f LEFT JOIN tru u ON u.run_id = f.run_id AND u.t = f.t "
        f"LEFT JOIN {q.hllpp_auto('pre', keys, k)} e ON e.run_id = f.run_id AND e.t = f.t"
        for k in (14, 16)
    )
    frame = "frame AS (SELECT run_id, t FROM (SELECT DISTINCT run_id FROM src), pts)"
    start = prefix_estimates_sql(GROWING_RUNS, [SketchSpec("naive")]).rstrip()
    return f"{start}, {frame} {rows}"


@query("win2_prefix_estimate_auto_lists", _growing_sql)
def win2_lists(spark, sf_dir):
    """Runs that pass from lists to registers (k=14) or whose lists are measured (k=16)."""
    specs = [sketch("hllpp", 14), sketch("hllpp", 16)]
    return _plain_prefix(growing_runs(spark, sf_dir), "auto", specs)


@query(
    "sta1_error_statistics",
    lambda: rounded_sql(
        prefix_estimates_sql(ORDER_RUNS) + _STATS.replace("params, t,", "params, t::BIGINT AS t,", 1),
        STAT_DOUBLES,
    ),
)
def sta1(spark, sf_dir):
    rows = _plain_prefix(order_runs(spark, sf_dir))
    by = ["algorithm", "params", "t"]
    return rounded(statistics.error_statistics(rows, by, "estimate", "truth"))


_ORDER_EVAL = lambda: prefix_eval_sql(ORDER_RUNS)
EVAL_DOUBLES = [*STAT_DOUBLES, "rse_theoretical"]


@query(
    "evl2_prefix_eval",
    lambda: rounded_sql(_ORDER_EVAL() + "SELECT * FROM pe", EVAL_DOUBLES),
)
def evl2(spark, sf_dir):
    return rounded(prefix_results(order_runs(spark, sf_dir)))


@query(
    "evl2_prefix_eval_events",
    lambda: rounded_sql(prefix_eval_sql(EVENT_RUN) + "SELECT * FROM pe", EVAL_DOUBLES),
)
def evl2_events(spark, sf_dir):
    return rounded(prefix_results(event_run(spark, sf_dir)))


# --- reports over prefix results ------------------------------------------------------


def both_results(spark, sf_dir, specs=PREFIX_SPECS) -> DataFrame:
    """Results of two experiments: the order runs and the long event stream."""
    first = prefix_results(order_runs(spark, sf_dir), specs)
    return first.unionByName(prefix_results(event_run(spark, sf_dir), specs))


def both_sql() -> str:
    return (
        f"WITH raw AS MATERIALIZED (SELECT * FROM ({_ORDER_EVAL()} SELECT * FROM pe) UNION ALL "
        f"SELECT * FROM ({prefix_eval_sql(EVENT_RUN)} SELECT * FROM pe)), "
        "sel AS (SELECT *, algorithm AS algorithm_label, "
        "CASE WHEN params LIKE '%k=%' THEN 'k' ELSE 'L' END AS param_name, "
        "CASE WHEN params LIKE '%k=%' THEN regexp_extract(params, 'k=(\\d+)', 1) "
        "ELSE nullif(regexp_extract(params, 'L=(\\d+)', 1), '') END::INT AS param_value, "
        "floor(sample_size / f0::DOUBLE)::INT AS rho FROM raw "
        "WHERE mode = 'streaming' AND f0_mean_t > 0 AND f0_hat_mean_t > 0 AND params <> '') "
    )


def _selected(spark, sf_dir) -> DataFrame:
    rows = both_results(spark, sf_dir).where(F.col("params") != "")
    return reports.select_stream_results(rows, seed=SEED)


@query(
    "flt1_select_results",
    lambda: rounded_sql(
        both_sql() + "SELECT algorithm, params, number_of_elements_processed, rho, f0_hat_mean_t "
        "FROM sel WHERE rho = 1",
        ["f0_hat_mean_t"],
    ),
)
def flt1(spark, sf_dir):
    rows = reports.select_stream_results(
        both_results(spark, sf_dir).where(F.col("params") != ""), seed=SEED, rhos=[1]
    )
    return rounded(
        rows.select("algorithm", "params", "number_of_elements_processed", "rho", "f0_hat_mean_t")
    )


@query(
    "flt2_standard_params",
    lambda: rounded_sql(
        both_sql() + "SELECT algorithm, params, number_of_elements_processed, rho, f0_hat_mean_t "
        "FROM sel WHERE (algorithm, params) IN (('HyperLogLog++', 'k=14'), "
        "('HyperLogLog', 'k=14,L=32'), ('LogLog', 'k=14,L=32'), "
        "('Probabilistic Counting', 'L=31'))",
        ["f0_hat_mean_t"],
    ),
)
def flt2(spark, sf_dir):
    rows = reports.standard_params_only(_selected(spark, sf_dir))
    return rounded(
        rows.select("algorithm", "params", "number_of_elements_processed", "rho", "f0_hat_mean_t")
    )


_ENDPOINTS = (
    "SELECT algorithm_label, param_name, param_value, rho, mean_relative_error AS endpoint_mre "
    "FROM sel QUALIFY row_number() OVER (PARTITION BY algorithm_label, param_name, param_value, "
    "f0 ORDER BY number_of_elements_processed DESC) = 1"
)


@query("win3_endpoint_summary", lambda: rounded_sql(both_sql() + _ENDPOINTS, ["endpoint_mre"]))
def win3(spark, sf_dir):
    return rounded(reports.endpoint_summary(_selected(spark, sf_dir)))


@query(
    "win4_best_params",
    lambda: rounded_sql(
        both_sql() + f"SELECT * FROM ({_ENDPOINTS}) QUALIFY row_number() OVER (PARTITION BY "
        "algorithm_label, rho ORDER BY endpoint_mre, param_value) = 1",
        ["endpoint_mre"],
    ),
)
def win4(spark, sf_dir):
    return rounded(reports.best_params(reports.endpoint_summary(_selected(spark, sf_dir))))


TARGETS = (20, 50, 100, 120, 150, 400, 900)


def _interpolated_sql() -> str:
    values = ", ".join(f"({float(t)!r}::DOUBLE)" for t in TARGETS)
    by = "algorithm_label, param_name, param_value, rho"

    def line(name: str) -> str:
        return (
            f"CASE WHEN hi = lo THEN {name}0 ELSE {name}0 + ({name}1 - {name}0) * "
            f"(f - lo) / (hi - lo) END"
        )

    return (
        both_sql()
        + f", ser AS (SELECT {by}, f0_mean_t AS x, avg(number_of_elements_processed) AS t, "
        f"avg(f0_hat_mean_t) AS y, avg(stddev) AS s FROM sel GROUP BY ALL), "
        f"big AS (SELECT {by}, min(x) AS a, max(x) AS z FROM ser GROUP BY ALL HAVING count(*) >= 2), "
        f"hit AS (SELECT {by}, f, max(x) FILTER (x <= f) AS lo, min(x) FILTER (x >= f) AS hi "
        f"FROM ser JOIN big USING ({by}), (VALUES {values}) v(f) WHERE f BETWEEN a AND z "
        f"GROUP BY {by}, f), "
        f"seg AS (SELECT h.*, p.t AS t0, p.y AS y0, p.s AS s0, n.t AS t1, n.y AS y1, n.s AS s1 "
        f"FROM hit h JOIN ser p ON (p.algorithm_label, p.param_name, p.param_value, p.rho, p.x) = "
        f"(h.algorithm_label, h.param_name, h.param_value, h.rho, h.lo) JOIN ser n ON "
        f"(n.algorithm_label, n.param_name, n.param_value, n.rho, n.x) = "
        f"(h.algorithm_label, h.param_name, h.param_value, h.rho, h.hi)) "
        f"SELECT {by}, f::BIGINT AS f0_star, ({line('t')}) / f AS rho_t, {line('y')} AS f0_hat, "
        f"{line('s')} AS stddev FROM seg"
    )


@query(
    "win5_interpolated_points",
    lambda: rounded_sql(_interpolated_sql(), ["rho_t", "f0_hat", "stddev"]),
)
def win5(spark, sf_dir):
    return rounded(reports.interpolated_points(_selected(spark, sf_dir), TARGETS))


@query(
    "win5_interpolated_error",
    lambda: rounded_sql(
        f"SELECT algorithm_label, count(*)::BIGINT AS points, "
        f"avg(abs(f0_hat - f0_star) / f0_star) AS mean_relative_error "
        f"FROM ({_interpolated_sql()}) GROUP BY algorithm_label",
        ["mean_relative_error"],
    ),
)
def win5_error(spark, sf_dir):
    points = reports.interpolated_points(_selected(spark, sf_dir), TARGETS)
    return rounded(reports.interpolated_error(points))


@query(
    "sta9_truth_curve",
    lambda: rounded_sql(
        both_sql() + "SELECT *, floor(sample_size / f0::DOUBLE)::INT AS rho_final, "
        "number_of_elements_processed / f0_mean_t AS rho_t, "
        "100.0::DOUBLE * number_of_elements_processed / sample_size AS progress_pct, "
        "number_of_elements_processed % floor(sample_size / f0::DOUBLE)::INT = 0 AS is_boundary "
        "FROM (SELECT sample_size, f0, seed, number_of_elements_processed, "
        "min(f0_mean_t) AS f0_mean_t FROM sel GROUP BY ALL)",
        ["f0_mean_t", "rho_t", "progress_pct"],
    ),
)
def sta9(spark, sf_dir):
    return rounded(reports.truth_curve(_selected(spark, sf_dir)))


@query(
    "mth5_bands",
    lambda: rounded_sql(
        both_sql() + "SELECT algorithm, params, rho, number_of_elements_processed, "
        "c * exp(-g) AS log_band_low, c * exp(g) AS log_band_high, "
        "greatest(f0_hat_mean_t - stddev, 1e-12) AS band_low, f0_hat_mean_t + stddev AS band_high "
        "FROM (SELECT *, greatest(f0_hat_mean_t, 1e-12) AS c, "
        "sqrt(ln(1 + pow(stddev / greatest(f0_hat_mean_t, 1e-12), 2))) AS g FROM sel)",
        ["log_band_low", "log_band_high", "band_low", "band_high"],
    ),
)
def mth5(spark, sf_dir):
    rows = reports.with_bands(_selected(spark, sf_dir))
    return rounded(
        rows.select(
            "algorithm", "params", "rho", "number_of_elements_processed", "log_band_low",
            "log_band_high", "band_low", "band_high",
        )
    )


@query(
    "sta10_pivot",
    lambda: rounded_sql(
        both_sql() + f"SELECT algorithm_label, rho, "
        + ", ".join(
            f'max(endpoint_mre) FILTER (param_value = {v}) AS "{v}"' for v in (10, 14, 31)
        )
        + f" FROM ({_ENDPOINTS}) GROUP BY algorithm_label, rho",
        ['"10"', '"14"', '"31"'],
    ),
)
def sta10(spark, sf_dir):
    endpoints = reports.endpoint_summary(_selected(spark, sf_dir))
    return rounded(
        reports.pivot_metric(
            endpoints, ["algorithm_label", "rho"], "param_value", [10, 14, 31], "endpoint_mre"
        )
    )


# --- merge evaluation -----------------------------------------------------------------

MERGE_SPECS = [
    sketch("hllpp", 10), sketch("hllpp", 14), sketch("hll", 10), sketch("ll", 10),
    sketch("pc", l=31), SketchSpec("naive"),
]
PAIRED = pairs_of(LINE_RUNS)


def merge_sql(specs=MERGE_SPECS, source: str = "lineitem") -> str:
    """CTEs ending in ``me``: pair_index, algorithm, params, merged and serial estimates."""
    parts = []
    for s in specs:
        if s.algo == "naive":
            serial = "(SELECT pair_index, count(DISTINCT value)::BIGINT AS estimate FROM prs " \
                "GROUP BY pair_index)"
            merged = serial
        elif s.algo == "pc":
            serial = q.estimate("pc", "hp", ["pair_index"], None, s.l)
            merged = serial
        else:
            width = 64 if s.algo == "hllpp" else 32
            each = q.registers("hp", ["pair_index", "side"], s.k, width)
            union = f"(SELECT pair_index, idx, max(rho) AS rho FROM {each} GROUP BY ALL)"
            maker = {"hllpp": q.hllpp_dense, "hll": q.hyperloglog, "ll": q.loglog}[s.algo]
            merged = maker(union, ["pair_index"], s.k)
            serial = q.estimate(s.algo, "hp", ["pair_index"], s.k)
        parts.append(
            f"SELECT a.pair_index, '{NAMES[s.algo]}' AS algorithm, '{s.params}' AS params, "
            f"a.estimate::DOUBLE AS estimate_merge, b.estimate::DOUBLE AS estimate_serial "
            f"FROM {merged} a JOIN {serial} b ON a.pair_index = b.pair_index"
        )
    return (
        f"WITH prs AS MATERIALIZED (SELECT * FROM {PAIRED}), hp AS MATERIALIZED (SELECT * FROM "
        f"{q.hashed('prs', 'pair_index, side', 'value')}), me AS MATERIALIZED ("
        + " UNION ALL ".join(parts)
        + ") "
    )


_MERGE_ROWS = (
    "SELECT algorithm, params, 'merge' AS mode, count(*) OVER (PARTITION BY algorithm, params) "
    "AS pairs, (SELECT count(*) // 10 FROM lineitem)::BIGINT AS sample_size, pair_index, "
    f"{SEED}::BIGINT AS seed, estimate_merge, estimate_serial, "
    "abs(estimate_merge - estimate_serial) AS delta_merge_serial_abs, "
    "abs(estimate_merge - estimate_serial) / estimate_serial AS delta_merge_serial_rel FROM me"
)


def merge_results(spark, sf_dir) -> DataFrame:
    runs = line_runs(spark, sf_dir)
    rows = merge_eval.merge_eval(runs, MERGE_SPECS, 0, SEED)
    size = F.floor(runs.agg(F.count(F.lit(1))).scalar() / 10).cast("bigint")
    return rows.withColumn("sample_size", size)


@query("evl3_merge_eval", lambda: merge_sql() + _MERGE_ROWS)
def evl3(spark, sf_dir):
    return merge_results(spark, sf_dir).drop("hash", "hash_seed")


@query(
    "evl3_merge_eval_auto",
    lambda: f"WITH prs AS MATERIALIZED (SELECT * FROM {PAIRED}), hp AS MATERIALIZED (SELECT * "
    f"FROM {q.hashed('prs', 'pair_index', 'value')}) "
    f"SELECT pair_index, estimate::DOUBLE AS estimate_merge, estimate::DOUBLE AS estimate_serial "
    f"FROM {q.hllpp_auto('hp', ['pair_index'], 14)}",
)
def evl3_auto(spark, sf_dir):
    rows = merge_eval.merge_pairs(line_runs(spark, sf_dir), [sketch("hllpp", 14)], mode="auto")
    return rows.select("pair_index", "estimate_merge", "estimate_serial")


@query(
    "mth3_merge_delta",
    lambda: f"""SELECT pair_index, round(abs(a - b), 6) AS delta_abs,
        round(abs(a - b) / b, 9) AS delta_rel FROM (SELECT pair_index,
        count(DISTINCT value) FILTER (side = 0)::DOUBLE AS a,
        count(DISTINCT value) FILTER (side = 1)::DOUBLE AS b FROM {PAIRED} GROUP BY pair_index)""",
)
def mth3(spark, sf_dir):
    paired = exact.pair_runs(line_runs(spark, sf_dir))
    sides = exact.exact_distinct(paired, ["pair_index", "side"], "value")
    both = sides.groupBy("pair_index").agg(
        *[F.max(F.when(F.col("side") == i, F.col("exact"))).cast("double").alias(n)
          for i, n in ((0, "a"), (1, "b"))]
    )
    gap, share = errors.merge_delta(F.col("a"), F.col("b"))
    return both.select(
        "pair_index", F.round(gap, 6).alias("delta_abs"), F.round(share, 9).alias("delta_rel")
    )


@query(
    "sta2_pair_summary",
    lambda: rounded_sql(
        merge_sql() + f"SELECT algorithm, params, count(*)::BIGINT AS pairs, "
        "avg(estimate_merge) AS estimate_merge_mean, avg(estimate_serial) AS estimate_serial_mean, "
        "avg(delta_merge_serial_abs) AS delta_abs_mean, max(delta_merge_serial_abs) AS "
        "delta_abs_max, avg(delta_merge_serial_rel) AS delta_rel_mean, "
        "sqrt(avg(pow(delta_merge_serial_abs, 2))) AS delta_rmse FROM "
        f"({_MERGE_ROWS}) GROUP BY algorithm, params",
        ["estimate_merge_mean", "estimate_serial_mean", "delta_abs_mean", "delta_abs_max",
         "delta_rel_mean", "delta_rmse"],
    ),
)
def sta2(spark, sf_dir):
    return rounded(
        statistics.pair_summary(merge_results(spark, sf_dir), ["algorithm", "params"])
    )


HOM_HASHES = ("splitmix64", "xxhash64", "murmurhash3", "siphash24")
HOM_KS = (10, 14, 18)


def _hom_sql() -> str:
    """Merge = serial holds, so the summary follows from the serial estimates."""
    parts = []
    for name in HOM_HASHES:
        for k in HOM_KS:
            hashes = q.hashed("prs", "pair_index", "value", name, SEED)
            parts.append(
                f"SELECT '{name}' AS hash, {k}::INT AS k, pair_index, estimate FROM "
                f"{q.hllpp_dense(q.registers(hashes, ['pair_index'], k), ['pair_index'], k)}"
            )
    return (
        f"WITH prs AS MATERIALIZED (SELECT * FROM {PAIRED}), e AS ({' UNION ALL '.join(parts)}), "
        f"s AS (SELECT count(*) AS n, count(DISTINCT value) AS d FROM {LINE_RUNS} GROUP BY run_id), "
        "z AS (SELECT max(n) AS n, max(d) AS d FROM s) "
        "SELECT 'lines' AS namespace, z.d::BIGINT AS d, floor(z.n / z.d::DOUBLE)::INT AS rho, hash, k, "
        "count(*)::BIGINT AS pairs, avg(estimate) AS estimate_merge_mean, "
        "avg(estimate) AS estimate_serial_mean, 0.0::DOUBLE AS delta_abs_mean, 0.0::DOUBLE AS "
        "delta_abs_max, 0.0::DOUBLE AS delta_abs_rmse, 0.0::DOUBLE AS delta_rel_mean, "
        "0.0::DOUBLE AS delta_rel_max, 0::BIGINT AS nonzero_pairs, 0.0::DOUBLE AS nonzero_share "
        "FROM e, z GROUP BY z.n, z.d, hash, k"
    )


def _with_sizes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Attach d and rho of the experiment, read from its runs."""
    sizes = exact.run_sizes(runs).agg(F.max("n").alias("n"), F.max("d").alias("d"))
    sized = rows.withColumn("d", sizes.select("d").scalar())
    return sized.withColumn("rho", errors.repetition(sizes.select("n").scalar(), F.col("d")))


def _homogeneous(spark, sf_dir) -> DataFrame:
    runs = line_runs(spark, sf_dir)
    specs = [sketch("hllpp", k, hash=h, seed=SEED) for h in HOM_HASHES for k in HOM_KS]
    pairs = _with_sizes(merge_eval.merge_pairs(runs, specs), runs).withColumns(
        {
            "namespace": F.lit("lines"),
            "k": F.regexp_extract("params", r"k=(\d+)", 1).cast("int"),
        }
    )
    return reports.homogeneous_summary(pairs)


_HOM_DOUBLES = ["estimate_merge_mean", "estimate_serial_mean"]


@query("sta4_homogeneous_summary", lambda: rounded_sql(_hom_sql(), _HOM_DOUBLES))
def sta4(spark, sf_dir):
    return rounded(_homogeneous(spark, sf_dir))


@query(
    "srt2_worst_cells",
    lambda: rounded_sql(
        f"SELECT * FROM ({_hom_sql()}) ORDER BY delta_rel_max DESC, delta_abs_max DESC, namespace, "
        "rho, hash, k LIMIT 10",
        _HOM_DOUBLES,
    ),
)
def srt2(spark, sf_dir):
    return rounded(reports.worst_cells(_homogeneous(spark, sf_dir), 10))


# --- heterogeneous merge --------------------------------------------------------------

HASH_CASES = grid.hash_mismatch_cases(SEED)
PRECISION_CASES = grid.precision_mismatch_cases(SEED)
ORDER_PAIRS = pairs_of(ORDER_RUNS)


def het_sql(cases) -> str:
    """CTEs ending in ``he``: one row per case and pair, in result columns plus scenario."""
    contexts: dict[tuple[str, int], str] = {}
    for c in cases:
        own = [(c.left_hash, c.left_hash_seed), (c.right_hash, c.right_hash_seed)]
        for context in [*own, *(x[:2] for x in (c.serial, c.baseline) if isinstance(x, tuple))]:
            contexts.setdefault(context, f"h{len(contexts)}")
    ctes = [f"prs AS MATERIALIZED (SELECT * FROM {ORDER_PAIRS})"]
    for (name, seed), alias in contexts.items():
        hashes = q.hashed("prs", "pair_index, side", "value", name, seed)
        ctes.append(f"{alias} AS MATERIALIZED (SELECT * FROM {hashes})")
    keys = ["case_id", "role", "pair_index"]
    rows: dict[int, list[str]] = {}

    def side(case_id: int, role: str, context, k: int, to: int, naive: bool, which: str) -> None:
        source = f"(SELECT * FROM {contexts[context]} WHERE side IN ({which}))"
        regs = q.reduce(q.registers(source, ["pair_index"], k), ["pair_index"], k, to, naive)
        rows.setdefault(to, []).append(
            f"SELECT {case_id} AS case_id, '{role}' AS role, pair_index, idx, rho FROM {regs}"
        )

    described = []
    for i, c in enumerate(cases):
        left, right = (c.left_hash, c.left_hash_seed), (c.right_hash, c.right_hash_seed)
        low = min(c.left_k, c.right_k)
        recoverable = left == right and c.left_k != c.right_k
        if c.strategy != "reject":
            naive = recoverable and c.strategy == "unsafe_naive_merge"
            side(i, "merge", left, c.left_k, low, naive, "0")
            side(i, "merge", right, c.right_k, low, naive, "1")
        serial = c.serial or (*left, low if recoverable else c.left_k)
        side(i, "serial", serial[:2], serial[2], serial[2], False, "0, 1")
        baseline = (*left, low) if c.baseline == grid.DERIVED else c.baseline
        if baseline:
            side(i, "baseline", baseline[:2], baseline[2], baseline[2], False, "0, 1")
        validity = "recoverable" if recoverable else ("valid" if left == right else "invalid")
        described.append(
            f"({i}, '{c.scenario}', '{c.left_hash}', '{c.right_hash}', "
            f"{c.left_hash_seed}::BIGINT, {c.right_hash_seed}::BIGINT, 'k={c.left_k}', "
            f"'k={c.right_k}', '{c.strategy}', '{validity}')"
        )
    estimates = []
    for k, parts in rows.items():
        ctes.append(
            f"r{k} AS MATERIALIZED (SELECT case_id, role, pair_index, idx, max(rho) AS rho FROM "
            f"({' UNION ALL '.join(parts)}) GROUP BY ALL)"
        )
        estimates.append(f"SELECT * FROM {q.hllpp_dense(f'r{k}', keys, k)}")
    ctes += [
        f"es AS ({' UNION ALL '.join(estimates)})",
        "ex AS (SELECT pair_index, count(DISTINCT value)::DOUBLE AS exact_union FROM prs "
        "GROUP BY pair_index)",
        "ds(case_id, scenario, left_hash, right_hash, left_hash_seed, right_hash_seed, "
        f"left_params, right_params, strategy, validity) AS (VALUES {', '.join(described)})",
        "wide AS (SELECT case_id, pair_index, "
        + ", ".join(
            f"coalesce(max(estimate) FILTER (role = '{r}')::DOUBLE, 'nan'::DOUBLE) AS {n}"
            for r, n in (
                ("merge", "estimate_merge"), ("serial", "estimate_serial"),
                ("baseline", "baseline_homogeneous"),
            )
        )
        + " FROM es GROUP BY case_id, pair_index)",
        "he AS MATERIALIZED (SELECT 'HyperLogLog++' AS algorithm, 'merge_heterogeneous' AS mode, "
        "count(*) OVER (PARTITION BY case_id)::BIGINT AS pairs, 0::BIGINT AS sample_size, "
        f"pair_index, {SEED}::BIGINT AS dataset_seed, left_hash, right_hash, left_hash_seed, "
        "right_hash_seed, left_params, right_params, strategy, validity, 'pairwise' AS topology, "
        "exact_union, estimate_merge, estimate_serial, "
        "abs(estimate_merge - exact_union) AS error_merge_abs_exact, "
        "abs(estimate_merge - exact_union) / exact_union AS error_merge_rel_exact, "
        "abs(estimate_serial - exact_union) AS error_serial_abs_exact, "
        "abs(estimate_serial - exact_union) / exact_union AS error_serial_rel_exact, "
        "baseline_homogeneous, abs(estimate_merge - baseline_homogeneous) AS delta_vs_baseline, "
        "scenario FROM wide JOIN ex USING (pair_index) JOIN ds USING (case_id))",
    ]
    return "WITH " + ", ".join(ctes) + " "


HET_DOUBLES = ["error_merge_rel_exact", "error_serial_rel_exact"]


def _het(spark, sf_dir, cases) -> DataFrame:
    return merge_eval.heterogeneous_eval(order_runs(spark, sf_dir), cases, 0, SEED)


@query(
    "evl6_hash_mismatch",
    lambda: rounded_sql(het_sql(HASH_CASES) + "SELECT * FROM he", HET_DOUBLES),
)
def evl6_hash(spark, sf_dir):
    return rounded(_het(spark, sf_dir, HASH_CASES))


@query(
    "evl6_precision_mismatch",
    lambda: rounded_sql(het_sql(PRECISION_CASES) + "SELECT * FROM he", HET_DOUBLES),
)
def evl6_precision(spark, sf_dir):
    return rounded(_het(spark, sf_dir, PRECISION_CASES))


DEFAULT_CASE = [grid.merge_case(SEED, left_k=12, right_k=11, strategy="reduce_then_merge")]


@query(
    "evl4_heterogeneous_merge",
    lambda: rounded_sql(het_sql(DEFAULT_CASE) + "SELECT * FROM he", HET_DOUBLES),
)
def evl4(spark, sf_dir):
    return rounded(_het(spark, sf_dir, DEFAULT_CASE))


_UNSAFE = [grid.merge_case(SEED, "xxhash64", 12, "unsafe_naive_merge", right_hash_seed=17)]


#: References of their own: none for the baseline, or other hashes and precisions.
REFERENCE_CASES = [
    grid.merge_case(SEED, "xxhash64", 12, "reject", right_hash_seed=17, scenario="none", baseline=None),
    grid.merge_case(
        SEED, "xxhash64", 12, "unsafe_naive_merge", right_hash_seed=17, scenario="foreign",
        serial=("murmurhash3", SEED, 11), baseline=("splitmix64", SEED, 10),
    ),
    grid.merge_case(
        SEED, "xxhash64", left_k=13, right_k=11, strategy="reduce_then_merge", scenario="reduced",
        serial=("xxhash64", SEED, 13), baseline=None,
    ),
]


@query(
    "evl4_references",
    lambda: rounded_sql(het_sql(REFERENCE_CASES) + "SELECT * FROM he", HET_DOUBLES),
)
def evl4_references(spark, sf_dir):
    return rounded(_het(spark, sf_dir, REFERENCE_CASES))


@query(
    "evl7_defaults",
    lambda: rounded_sql(het_sql([grid.merge_case(SEED)]) + "SELECT * FROM he", HET_DOUBLES),
)
def evl7_defaults(spark, sf_dir):
    """Every parameter but the seed of the data set left at its default."""
    return rounded(_het(spark, sf_dir, [grid.merge_case(SEED)]))


@query(
    "mrg11_strategy_auto",
    lambda: f"WITH prs AS MATERIALIZED (SELECT * FROM {ORDER_PAIRS}), "
    f"a AS (SELECT * FROM {q.hashed('prs', 'pair_index, side', 'value', 'xxhash64', SEED)}), "
    f"b AS (SELECT * FROM {q.hashed('prs', 'pair_index, side', 'value', 'xxhash64', 17)}), "
    "m AS (SELECT pair_index, v, h FROM a WHERE side = 0 UNION ALL "
    "SELECT pair_index, v, h FROM b WHERE side = 1) "
    f"SELECT x.pair_index, x.estimate::DOUBLE AS estimate_merge, "
    f"y.estimate::DOUBLE AS estimate_serial FROM {q.hllpp_auto('m', ['pair_index'], 12)} x "
    f"JOIN {q.hllpp_auto('a', ['pair_index'], 12)} y ON x.pair_index = y.pair_index",
)
def mrg11(spark, sf_dir):
    rows = merge_eval.heterogeneous_pairs(order_runs(spark, sf_dir), _UNSAFE, mode="auto")
    return rows.select("pair_index", "estimate_merge", "estimate_serial")


@query(
    "sta3_finite_summary",
    lambda: rounded_sql(
        het_sql(PRECISION_CASES)
        + "SELECT strategy, coalesce(avg(CASE WHEN isfinite(estimate_merge) THEN estimate_merge "
        "END), 'nan'::DOUBLE) AS estimate_merge_mean, count(*) FILTER "
        "(isfinite(estimate_merge))::BIGINT AS estimate_merge_finite, avg(estimate_serial) AS "
        "estimate_serial_mean, count(*)::BIGINT AS estimate_serial_finite FROM he GROUP BY strategy",
        ["estimate_merge_mean", "estimate_serial_mean"],
    ),
)
def sta3(spark, sf_dir):
    rows = _het(spark, sf_dir, PRECISION_CASES)
    return rounded(
        statistics.finite_summary(rows, ["strategy"], ["estimate_merge", "estimate_serial"])
    )


# --- reports over heterogeneous merges ------------------------------------------------

_SIZES = (
    f", sz AS (SELECT max(n) AS n, max(d)::BIGINT AS d FROM (SELECT count(*) AS n, "
    f"count(DISTINCT value) AS d FROM {ORDER_RUNS} GROUP BY run_id)), "
    "hx AS (SELECT he.*, sz.d, floor(sz.n / sz.d::DOUBLE)::INT AS rho, "
    "CASE WHEN isnan(error_merge_rel_exact) THEN NULL ELSE error_merge_rel_exact END AS mrel, "
    "CASE WHEN isnan(delta_vs_baseline) THEN NULL ELSE delta_vs_baseline END AS gap, "
    "CASE WHEN isnan(estimate_merge) THEN NULL ELSE "
    "abs(estimate_merge - baseline_homogeneous) / exact_union END AS gaprel, "
    "CASE WHEN isnan(error_merge_rel_exact) THEN NULL WHEN error_serial_rel_exact = 0 THEN "
    "CASE WHEN error_merge_rel_exact = 0 THEN NULL ELSE 'inf'::DOUBLE END "
    "ELSE error_merge_rel_exact / error_serial_rel_exact END AS ratio FROM he, sz) "
)


def _aggregates(gap_rel: bool) -> str:
    extra = "avg(gaprel) AS baseline_gap_rel_mean, " if gap_rel else ""
    return (
        "count(*)::BIGINT AS pairs, avg(mrel) AS merge_rel_mean, median(mrel) AS merge_rel_median, "
        "max(mrel) AS merge_rel_max, avg(error_serial_rel_exact) AS serial_rel_mean, "
        "avg(gap) AS baseline_gap_abs_mean, max(gap) AS baseline_gap_abs_max, "
        f"{extra}avg(ratio) AS degradation_ratio_mean"
    )


_AGG_DOUBLES = [
    "merge_rel_mean", "merge_rel_median", "merge_rel_max", "serial_rel_mean",
    "baseline_gap_abs_mean", "baseline_gap_abs_max", "degradation_ratio_mean",
]


def _het_rows(spark, sf_dir, cases) -> DataFrame:
    return _with_sizes(_het(spark, sf_dir, cases), order_runs(spark, sf_dir))


_HASH_RUNS = "SELECT scenario, strategy, validity, d, rho, left_hash, right_hash, {} FROM hx GROUP BY ALL"


@query(
    "sta5_hash_mismatch_runs",
    lambda: rounded_sql(
        het_sql(HASH_CASES) + _SIZES + _HASH_RUNS.format(_aggregates(True)),
        [*_AGG_DOUBLES, "baseline_gap_rel_mean"],
    ),
)
def sta5_runs(spark, sf_dir):
    return rounded(reports.hash_mismatch_runs(_het_rows(spark, sf_dir, HASH_CASES)))


@query(
    "sta5_hash_mismatch_global",
    lambda: rounded_sql(
        het_sql(HASH_CASES) + _SIZES
        + f"SELECT scenario, strategy, validity, {_aggregates(False)} FROM hx GROUP BY ALL",
        _AGG_DOUBLES,
    ),
)
def sta5_global(spark, sf_dir):
    return rounded(reports.hash_mismatch_global(_het_rows(spark, sf_dir, HASH_CASES)))


@query(
    "sta5_control_summary",
    lambda: rounded_sql(
        f"SELECT d, rho, left_hash, merge_rel_mean, serial_rel_mean, baseline_gap_abs_mean FROM "
        f"({het_sql(HASH_CASES) + _SIZES + _HASH_RUNS.format(_aggregates(True))}) "
        "WHERE scenario = 'ctrl'",
        ["merge_rel_mean", "serial_rel_mean", "baseline_gap_abs_mean"],
    ),
)
def sta5_control(spark, sf_dir):
    runs = reports.hash_mismatch_runs(_het_rows(spark, sf_dir, HASH_CASES))
    return rounded(reports.control_summary(runs))


def _labels_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCENARIO_LABELS.items())
    return f"CASE scenario {cases} END"


@query(
    "jon6_unsafe_by_scenario",
    lambda: rounded_sql(
        f"SELECT scenario, rho, avg(merge_rel_mean) AS merge_rel_mean, {_labels_sql()} AS "
        f"scenario_label FROM ({het_sql(HASH_CASES) + _SIZES + _HASH_RUNS.format(_aggregates(True))}) "
        "WHERE strategy = 'unsafe_naive_merge' GROUP BY scenario, rho",
        ["merge_rel_mean"],
    ),
)
def jon6(spark, sf_dir):
    runs = reports.hash_mismatch_runs(_het_rows(spark, sf_dir, HASH_CASES))
    return rounded(reports.unsafe_by_scenario(reports.unsafe_summary(runs)))


_PAIRING = (
    ", px AS (SELECT *, regexp_extract(left_params, '(\\d+)', 1) || '->' || "
    "regexp_extract(right_params, '(\\d+)', 1) AS pairing, "
    "least(regexp_extract(left_params, '(\\d+)', 1)::INT, "
    "regexp_extract(right_params, '(\\d+)', 1)::INT) || ' vs ' || "
    "greatest(regexp_extract(left_params, '(\\d+)', 1)::INT, "
    "regexp_extract(right_params, '(\\d+)', 1)::INT) AS pair_group FROM hx) "
)


@query(
    "sta6_precision_runs",
    lambda: rounded_sql(
        het_sql(PRECISION_CASES) + _SIZES + _PAIRING
        + f"SELECT pairing, pair_group, strategy, validity, d, rho, {_aggregates(True)}, "
        "bool_and(estimate_merge = estimate_serial) AS merge_eq_serial_all, "
        "bool_and(estimate_merge = baseline_homogeneous) AS merge_eq_baseline_all "
        "FROM px GROUP BY ALL",
        [*_AGG_DOUBLES, "baseline_gap_rel_mean"],
    ),
)
def sta6_runs(spark, sf_dir):
    return rounded(reports.precision_mismatch_runs(_het_rows(spark, sf_dir, PRECISION_CASES)))


@query(
    "sta6_precision_global",
    lambda: rounded_sql(
        het_sql(PRECISION_CASES) + _SIZES
        + f"SELECT strategy, validity, {_aggregates(False)} FROM hx GROUP BY ALL",
        _AGG_DOUBLES,
    ),
)
def sta6_global(spark, sf_dir):
    return rounded(reports.precision_mismatch_global(_het_rows(spark, sf_dir, PRECISION_CASES)))


@query(
    "sta6_pair_groups",
    lambda: rounded_sql(
        het_sql(PRECISION_CASES) + _SIZES + _PAIRING
        + "SELECT pair_group, strategy, d, rho, avg(mrel) AS merge_rel_mean, "
        "avg(error_serial_rel_exact) AS serial_rel_mean, avg(gaprel) AS baseline_gap_rel_mean, "
        "avg(ratio) AS degradation_ratio_mean FROM px GROUP BY ALL",
        ["merge_rel_mean", "serial_rel_mean", "baseline_gap_rel_mean", "degradation_ratio_mean"],
    ),
)
def sta6_groups(spark, sf_dir):
    rows = _het_rows(spark, sf_dir, PRECISION_CASES)
    return rounded(reports.precision_mismatch_pair_groups(rows))


@query(
    "sta7_consistency_checks",
    lambda: het_sql(PRECISION_CASES)
    + "SELECT 'reduce_then_merge == serial for all pairs' AS \"check\", "
    "bool_and(estimate_merge = estimate_serial) AS value FROM he WHERE strategy = "
    "'reduce_then_merge' UNION ALL SELECT 'reduce_then_merge == baseline for all pairs', "
    "bool_and(estimate_merge = baseline_homogeneous) FROM he WHERE strategy = "
    "'reduce_then_merge' UNION ALL SELECT 'reject produces NaN merge estimates', "
    "bool_and(isnan(estimate_merge)) FROM he WHERE strategy = 'reject'",
)
def sta7(spark, sf_dir):
    return reports.consistency_checks(_het(spark, sf_dir, PRECISION_CASES))


@query(
    "sta8_findings",
    lambda: rounded_sql(
        f"WITH g AS ({het_sql(HASH_CASES) + _SIZES}"
        f"SELECT scenario, strategy, validity, {_aggregates(False)} FROM hx GROUP BY ALL) "
        "SELECT 'homogeneous control' AS finding, max(merge_rel_mean) AS value FROM g "
        "WHERE scenario = 'ctrl' AND strategy = 'direct' UNION ALL "
        "SELECT 'unsafe invalid merge', avg(merge_rel_mean) FROM g WHERE strategy = "
        "'unsafe_naive_merge' UNION ALL SELECT 'worst-case unsafe invalid merge', "
        "max(merge_rel_max) FROM g WHERE strategy = 'unsafe_naive_merge'",
        ["value"],
    ),
)
def sta8(spark, sf_dir):
    summary = reports.hash_mismatch_global(_het_rows(spark, sf_dir, HASH_CASES))
    return rounded(reports.hash_mismatch_findings(summary))


@query(
    "sta8_precision_findings",
    lambda: rounded_sql(
        f"WITH g AS ({het_sql(PRECISION_CASES) + _SIZES}"
        f"SELECT strategy, validity, {_aggregates(False)} FROM hx GROUP BY ALL) "
        "SELECT 'reduce_then_merge global mean relative error' AS finding, merge_rel_mean AS value "
        "FROM g WHERE strategy = 'reduce_then_merge' UNION ALL "
        "SELECT 'unsafe_naive_merge global mean relative error', merge_rel_mean FROM g "
        "WHERE strategy = 'unsafe_naive_merge' UNION ALL SELECT 'worst-case unsafe_naive_merge', "
        "merge_rel_max FROM g WHERE strategy = 'unsafe_naive_merge'",
        ["value"],
    ),
)
def sta8_precision(spark, sf_dir):
    summary = reports.precision_mismatch_global(_het_rows(spark, sf_dir, PRECISION_CASES))
    return rounded(reports.precision_mismatch_findings(summary))


@query(
    "mth6_merge_ratios",
    lambda: rounded_sql(
        het_sql(PRECISION_CASES) + _SIZES
        + "SELECT scenario, strategy, pair_index, ratio AS degradation_ratio, "
        "gaprel AS baseline_gap_rel FROM hx",
        ["degradation_ratio", "baseline_gap_rel"],
    ),
)
def mth6(spark, sf_dir):
    rows = reports.with_merge_ratios(_het(spark, sf_dir, PRECISION_CASES))
    return rounded(
        rows.select(
            "scenario", "strategy", "pair_index",
            errors.null_if_nan(F.col("degradation_ratio")).alias("degradation_ratio"),
            errors.null_if_nan(F.col("baseline_gap_rel")).alias("baseline_gap_rel"),
        )
    )


@query(
    "srt1_category_order",
    lambda: "SELECT hash, n, row_number() OVER (ORDER BY list_position("
    f"[{', '.join(repr(h) for h in HASH_ORDER)}], hash))::INT AS place FROM (SELECT CASE "
    "o_custkey % 4 WHEN 0 THEN 'siphash24' WHEN 1 THEN 'murmurhash3' WHEN 2 THEN 'xxhash64' "
    "ELSE 'splitmix64' END AS hash, count(*)::BIGINT AS n FROM orders GROUP BY 1)",
)
def srt1(spark, sf_dir):
    """Four category rows put into their explicit order."""
    names = F.array(*[F.lit(h) for h in ("siphash24", "murmurhash3", "xxhash64", "splitmix64")])
    rows = table(spark, sf_dir, "orders").select(
        F.element_at(names, (F.col("o_custkey") % 4 + 1).cast("int")).alias("hash")
    )
    counted = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(order_of(F.col("hash"), HASH_ORDER))
    return counted.withColumn("place", F.row_number().over(order))


# --- result tables --------------------------------------------------------------------


@query(
    "snk1_streaming_results",
    lambda: rounded_sql(_ORDER_EVAL() + "SELECT * FROM pe", EVAL_DOUBLES),
)
def snk1(spark, sf_dir):
    """Prefix results appended to a partitioned table and read back."""
    root = scratch_folder(spark, "streaming-results")
    rows = prefix_results(order_runs(spark, sf_dir))
    laid = results.with_layout(rows, "orders d=1", "all", F.lit("splitmix64"), F.col("params"))
    results.append_results(laid, root)
    return rounded(spark.read.parquet(root).select(*results.columns_of("streaming")))


@query("snk2_merge_results", lambda: merge_sql() + _MERGE_ROWS)
def snk2(spark, sf_dir):
    """Merge results appended twice to a CSV table with headers, read back once each."""
    root = scratch_folder(spark, "merge-results")
    rows = merge_results(spark, sf_dir)
    laid = results.with_layout(rows, "lines", "all", F.col("hash"), F.col("params"))
    laid = laid.drop("hash", "hash_seed")
    half = F.col("pair_index") < 2
    results.append_results(laid.where(half), root, "csv")
    results.append_results(laid.where(~half), root, "csv")
    return results.load_results(spark, root, "merge").drop("source_path").withColumn(
        "pair_index", F.col("pair_index").cast("int")
    ).fillna({"params": ""})


@query(
    "snk3_heterogeneous_results",
    lambda: rounded_sql(
        het_sql(PRECISION_CASES) + "SELECT * EXCLUDE (scenario, pair_index), "
        "pair_index::BIGINT AS pair_index FROM he",
        HET_DOUBLES,
    ),
)
def snk3(spark, sf_dir):
    """Heterogeneous results as CSV text and back, NaN included."""
    root = scratch_folder(spark, "het-results")
    rows = _het(spark, sf_dir, PRECISION_CASES).drop("scenario")
    hash_label = F.concat_ws("__", "left_hash", "right_hash")
    params = F.concat_ws("__", "left_params", "right_params", "strategy")
    results.append_results(
        results.with_layout(rows, "orders", "hllpp", hash_label, params), root, "csv"
    )
    loaded = results.load_results(spark, root, "merge_heterogeneous").drop("source_path")
    return rounded(loaded)


@query(
    "snk5_csv_numbers",
    "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.10g', "
    "l_extendedprice / 7.0::DOUBLE / pow(10.0::DOUBLE, l_linenumber * 2)) AS text FROM lineitem",
)
def snk5(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    x = F.col("l_extendedprice") / F.lit(7.0) / F.pow(F.lit(10.0), F.col("l_linenumber") * 2)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", results.number_text(x).alias("text")
    )


@query("snk6_summary_table", lambda: rounded_sql(_hom_sql(), _HOM_DOUBLES))
def snk6(spark, sf_dir):
    """A summary written as files with a header and read with its schema."""
    root = scratch_folder(spark, "summary")
    summary = _homogeneous(spark, sf_dir)
    results.write_table(summary, root)
    return rounded(spark.read.schema(summary.schema).csv(root, header=True, escape='"'))


@query("snk7_replace_partitions", lambda: merge_sql() + _MERGE_ROWS)
def snk7(spark, sf_dir):
    """A wrong version of the results is replaced; only the right one is left."""
    root = scratch_folder(spark, "replaced")
    rows = merge_results(spark, sf_dir)
    laid = results.with_layout(rows, "lines", "all", F.col("hash"), F.col("params"))
    results.append_results(laid.withColumn("estimate_merge", F.lit(-1.0)), root)
    results.replace_results(laid, root)
    return spark.read.parquet(root).select(*results.columns_of("merge"))


@query(
    "src7_load_results",
    lambda: merge_sql()
    + "SELECT trim(regexp_replace(algorithm, '[^A-Za-z0-9]+', '_', 'g'), '_') AS algorithm_dir, "
    "trim(regexp_replace(params, '[^A-Za-z0-9]+', '_', 'g'), '_') AS params_dir, "
    "count(*)::BIGINT AS rows FROM me WHERE params <> '' GROUP BY 1, 2",
)
def src7(spark, sf_dir):
    """Result files found recursively, their layout read from the path."""
    root = scratch_folder(spark, "tagged")
    rows = merge_results(spark, sf_dir).where(F.col("params") != "")
    laid = results.with_layout(rows, "lines", "all", F.col("hash"), F.col("params"))
    laid = laid.withColumn("p_algorithm", results.sanitize(F.col("algorithm")))
    results.append_results(laid.drop("hash", "hash_seed"), root, "csv")
    loaded = results.load_results(spark, root, "merge")
    placed = results.with_path_fields(loaded, ["algorithm_dir", "params_dir"])
    return placed.groupBy("algorithm_dir", "params_dir").agg(F.count(F.lit(1)).alias("rows"))


@query("snk7_replace_namespaces", lambda: merge_sql() + _MERGE_ROWS)
def snk7_namespaces(spark, sf_dir):
    """Two namespaces of wrong results, one replaced whole; the other is filtered out again."""
    root = scratch_folder(spark, "namespaces")
    rows = merge_results(spark, sf_dir)
    wrong = rows.withColumns({"estimate_merge": F.lit(-1.0), "params": F.lit("k=3")})
    for name in ("order lines", "other"):
        laid = results.with_layout(wrong, name, "all", F.col("hash"), F.col("params"))
        results.append_results(laid, root)
    laid = results.with_layout(rows, "order lines", "all", F.col("hash"), F.col("params"))
    results.replace_namespaces(laid, root, ["order lines"])
    kept = spark.read.parquet(root).where(F.col("p_namespace") == "order_lines")
    return kept.select(*results.columns_of("merge"))


# --- streams --------------------------------------------------------------------------


def event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


_EVENTS = q.hashed("events", "event_type", "user_id")


def _run_live(spark, sf_dir, spec) -> live.SketchLog:
    running, log = live.maintain(
        event_stream(spark, sf_dir), ["event_type"], "user_id", spec,
        scratch_folder(spark, "live"), available_now=True,
    )
    running.awaitTermination()
    return log


@query("stm1_live_registers", lambda: "SELECT * FROM " + q.registers(_EVENTS, ["event_type"], 10))
def stm1(spark, sf_dir):
    log = _run_live(spark, sf_dir, sketch("hllpp", 10))
    return log.sketches().select("event_type", "idx", "rho")


@query(
    "stm2_live_estimates",
    lambda: "SELECT * FROM " + q.estimate("hllpp", _EVENTS, ["event_type"], 10),
)
def stm2(spark, sf_dir):
    return _run_live(spark, sf_dir, sketch("hllpp", 10)).latest().select("event_type", "estimate")


@query(
    "stm3_union_of_nodes",
    lambda: "SELECT * FROM " + q.registers(_EVENTS, ["event_type"], 10, 32),
)
def stm3(spark, sf_dir):
    """Sketches of two nodes arrive as messages, one of them twice."""
    inbox = scratch_folder(spark, "inbox")
    events = table(spark, sf_dir, "events").withColumn("node", F.col("event_id") % 2)
    sketches = build_sketches(events, ["node", "event_type"], "user_id", sketch("hll", 10))
    for node in (0, 1, 1):
        sketches.where(F.col("node") == node).write.mode("append").parquet(inbox)
    reader = spark.readStream.schema(sketches.schema).option("maxFilesPerTrigger", 1)
    messages = reader.parquet(inbox)
    log = live.SketchLog(spark, scratch_folder(spark, "union"), ["event_type"])
    running = (
        live.live_union(messages, ["event_type"])
        .writeStream.outputMode("update")
        .option("checkpointLocation", scratch_folder(spark, "union-checkpoint"))
        .foreachBatch(log.put)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return log.sketches().select("event_type", "idx", "rho")
