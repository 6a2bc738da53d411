"""Bias correction data of HyperLogLog++.

The correction needs, per precision, about 200 points ``(raw estimate, mean bias)`` that
were published with the algorithm.  They are not spelled out here.  The default source is
the copy Spark itself ships for ``approx_count_distinct``; any other table can be passed in
as a parameter, and :func:`expected_bias_points` computes a table from the distribution of
the registers for sessions where neither is at hand.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.local import local_frame

# Linear counting is trusted up to this estimate, for precision 4, 5, .. 18.
THRESHOLDS = [
    10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000,
]
NEIGHBOURS = 6
MIN_K, MAX_K = 4, 18

BiasPoints = Mapping[int, Sequence[tuple[float, float]]]

_published: dict[int, list[tuple[float, float]]] = {}


def alpha(m: int) -> float:
    # Fixed values of the published estimator.
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1.0 + 1.079 / m))


def published_bias_points(spark: SparkSession) -> dict[int, list[tuple[float, float]]]:
    """The published points, read once per process from the running Spark."""
    if not _published:
        jvm = getattr(spark, "_jvm", None)
        if jvm is None:
            raise RuntimeError(
                "this session gives no access to Spark's bias table; pass bias_points="
                "load_bias_points(...) or bias_points=expected_bias_points()"
            )
        helper = jvm.org.apache.spark.sql.catalyst.util.HyperLogLogPlusPlusHelper
        text = jvm.java.util.Arrays.toString
        raw, bias = (
            [[float(v) for v in text(row).strip("[]").split(",")] for row in table]
            for table in (helper.RAW_ESTIMATE_DATA(), helper.BIAS_DATA())
        )
        for k, (r, b) in enumerate(zip(raw, bias, strict=True), MIN_K):
            _published[k] = list(zip(r, b, strict=True))
    return _published


def load_bias_points(frame: DataFrame) -> dict[int, list[tuple[float, float]]]:
    """Points from a table ``(p, ord, raw, bias)``; at most a few thousand rows by nature."""
    out: dict[int, list[tuple[float, float]]] = {}
    rows = frame.select("p", "ord", "raw", "bias").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a bias table has a few hundred points per precision")
    for row in sorted(rows, key=lambda r: (r.p, r.ord)):
        out.setdefault(row.p, []).append((row.raw, row.bias))
    return out


def _poisson_raw_mean(load: np.ndarray, m: int) -> np.ndarray:
    """Mean raw estimate when each register receives Poisson(load) elements.

    Uses E[1/Z] = integral of E[exp(-tZ)] dt, where E[exp(-tZ)] is the m-th power of a
    one-register transform; Gauss-Laguerre nodes are scaled to the mean of Z.
    """
    nodes, weights = np.polynomial.laguerre.laggauss(64)
    powers = 2.0 ** -np.arange(66)
    prob = np.diff(np.exp(-load[:, None] * powers), axis=1, prepend=0.0)
    mean = prob @ powers
    t = nodes[None, :] / (mean[:, None] * m)
    log_phi = np.log1p(np.einsum("nkr,nr->nk", np.expm1(-t[:, :, None] * powers), prob))
    integral = (np.exp(m * log_phi + nodes) * weights).sum(axis=1) / (mean * m)
    return alpha(m) * m * m * integral


def expected_bias_points(precisions: Sequence[int] = range(MIN_K, MAX_K + 1)) -> dict:
    """Points computed from the expectation of the raw estimate on an even grid up to 5m."""
    out = {}
    for k in precisions:
        m = 1 << k
        n = np.unique(np.floor(1 + np.arange(200) * (5 * m - 1) / 200))
        step = np.where(n > 0.02 * m, 0.02 * m, n / 2)
        centre = _poisson_raw_mean(n / m, m)
        curvature = (
            _poisson_raw_mean((n + step) / m, m)
            - 2 * centre
            + _poisson_raw_mean((n - step) / m, m)
        ) / step**2
        raw = centre - n / 2 * curvature
        out[k] = [(float(r), float(r - c)) for r, c in zip(raw, n)]
    return out


def bias_windows(points: BiasPoints, precisions: Sequence[int]) -> list[tuple]:
    """Rows ``(k, lo, hi, bias)``: the mean bias of the six nearest points as a step function.

    With points sorted by raw estimate the six nearest are contiguous, and the window moves
    on where the point entering is strictly nearer than the one leaving.
    """
    rows = []
    for k in precisions:
        table = sorted(points[k], key=lambda point: point[0])
        width = min(NEIGHBOURS, len(table))
        starts = len(table) - width + 1
        edges = [
            (table[i][0] + table[i + width][0]) / 2 for i in range(starts - 1)
        ]
        # A raw estimate is never negative, so the outer steps need no infinities.
        lows, highs = [-1.0, *edges], [*edges, 1e300]
        for i in range(starts):
            mean = sum(bias for _, bias in table[i : i + width]) / width
            rows.append((k, lows[i], highs[i], mean))
    return rows


#: Buckets that the range in which estimates are corrected, up to 5 * 2**k, is cut into.
BUCKETS = 64


def _bucket(raw: float, k: int) -> int:
    return min(BUCKETS, math.floor(raw * BUCKETS / (5.0 * (1 << k))))


def bias_frame(
    spark: SparkSession, precisions: Sequence[int], points: BiasPoints | None = None
) -> DataFrame:
    """The step function as a small frame, at most about 270 rows per precision: every step
    once for each bucket that it reaches into."""
    wanted = sorted(set(precisions))
    source = points if points is not None else published_bias_points(spark)
    rows = [
        (k, bucket, lo, hi, mean)
        for k, lo, hi, mean in bias_windows(source, wanted)
        for bucket in range(_bucket(max(lo, 0.0), k), _bucket(hi, k) + 1)
    ]
    return local_frame(
        spark, rows, "bias_k int, bias_bucket int, bias_lo double, bias_hi double, bias_mean double"
    ).hint("broadcast")


def subtract_bias(
    df: DataFrame,
    raw: str,
    k: str,
    precisions: Sequence[int],
    points: BiasPoints | None = None,
    out: str = "corrected",
) -> DataFrame:
    """Attach ``out``: the raw estimate less its bias where ``raw <= 5m``, floored at 0.

    The step function is joined as a broadcast of fixed size, by precision and bucket, and
    within a bucket by range; each row meets exactly one step, so none is lost or repeated.
    """
    steps = bias_frame(df.sparkSession, precisions, points)
    size = F.lit(5.0) * F.pow(F.lit(2.0), F.col(k))
    bucket = F.least(F.lit(BUCKETS), F.floor(F.col(raw) * F.lit(float(BUCKETS)) / size)).cast("int")
    joined = df.withColumn("__bucket", bucket).join(
        steps,
        (F.col(k) == F.col("bias_k"))
        & (F.col("__bucket") == F.col("bias_bucket"))
        & (F.col(raw) > F.col("bias_lo"))
        & (F.col(raw) <= F.col("bias_hi")),
        "left",
    )
    limit = F.lit(5.0) * F.pow(F.lit(2.0), F.col(k))
    value = F.when(
        F.col(raw) <= limit, F.greatest(F.col(raw) - F.col("bias_mean"), F.lit(0.0))
    ).otherwise(F.col(raw))
    return joined.withColumn(out, value).drop(
        "__bucket", "bias_k", "bias_bucket", "bias_lo", "bias_hi", "bias_mean"
    )
