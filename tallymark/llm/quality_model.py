"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

A text becomes a few statistics; cosines of random projections of them approximate a Gaussian kernel.
Ridge weights solve the normal equations, whose matrices are summed per partition and then in a tree.
Scores are calibrated by isotonic regression of the labels on leave-one-out scores of the learning
rows, which ridge regression has in closed form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import id_remainder, map_columns, stored

FEATURES = 256
RIDGE = 1.0
SEED = 7
#: Bins of a leave-one-out score between -0.5 and 1.5 that calibration works on.
BINS = 1024

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_STOP = np.array([b in b".,;:?" for b in range(256)])
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)]) & ~_STOP
_ENDED = re.compile(rb"[.?!][\"')]*\s*$", re.M)


def text_statistics(text: str) -> list[float]:
    """Statistics of a whole text; zeros, all defined, for an empty one."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    sizes = np.fromiter(map(len, words), dtype=float, count=n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        sizes.mean(),
        sizes.std(),
        sizes.max() ** 0.5,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        share[_UPPER].sum(),
        share[_DIGIT].sum(),
        share[_STOP].sum(),
        share[_SYMBOL].sum() ** 0.5,
        share[128:].sum(),
        share[_SPACE].sum(),
        np.log1p(len(data) / len(lines)),
        1 - len(set(lines)) / len(lines),
        len(_ENDED.findall(data)) / len(lines),
    ]


N_STATISTICS = 15


def statistics_of(text: Column) -> Column:
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[float(x) for x in text_statistics(t.as_py() or "")] for t in texts],
            pa.list_(pa.float64()),
        )

    return F.arrow_udf(measure, "array<double>")(text)


@dataclass(frozen=True)
class QualityModel:
    """Everything a score needs: scaling, projections, weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    inverse: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, statistics: np.ndarray) -> np.ndarray:
        scaled = np.clip((statistics - self.mean) / self.scale, -6, 6)
        waves = np.cos(scaled @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack((waves, np.ones((len(waves), 1))))

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.features(statistics) @ self.weights

    def left_out(self, statistics: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Raw scores of learning rows as if each had been left out."""
        made = self.features(statistics)
        pull = np.einsum("ij,jk,ik->i", made, self.inverse, made).clip(0, 0.999)
        return (made @ self.weights - pull * labels) / (1 - pull)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(statistics), *self.curve).clip(0, 1).round(6)


def isotonic_curve(
    at: np.ndarray, mean: np.ndarray, weight: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least squares through weighted means: block centres and block values."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at.tolist(), mean.tolist(), weight.tolist()):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return (
        np.array([b[0] / b[2] for b in blocks]),
        np.array([b[1] / b[2] for b in blocks]),
    )


def inverse_of_positive(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix by elimination, a plain numpy operation per row: the
    driver's threaded linear algebra was seen to wait for ever beside a running JVM."""
    n = len(matrix)
    both = np.hstack((matrix, np.eye(n)))
    for i in range(n):
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        both -= factors[:, None] * both[i]
    return both[:, n:]


def _rows(batches: Iterator[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch["label"]:
            yield np.array(batch["statistics"]), np.array(batch["label"], dtype=float)


def fit_quality_model(
    labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED
) -> QualityModel:
    """Learn from rows (statistics array<double>, label double in 0..1).

    The driver receives (``features`` + 1)^2 sums and at most ``BINS`` + 1 calibration bins. Without
    any row every score is 0.5; with one label only, every score is that label.
    """
    places = [F.col("statistics")[i] for i in range(N_STATISTICS)]
    moments = labelled.agg(
        F.count(F.lit(1)),
        *[F.avg(p) for p in places],
        *[F.stddev_pop(p) for p in places],
    ).first()
    rows = moments[0]
    if not rows:
        mean, spread = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
    else:
        mean, spread = np.array(moments[1:], dtype=float).reshape(2, N_STATISTICS)
    rng = np.random.default_rng(seed)
    size = features + 1
    model = QualityModel(
        mean=mean,
        scale=np.where(spread > 1e-9, spread, 1.0),
        projection=rng.normal(0, N_STATISTICS**-0.5, (N_STATISTICS, features)),
        phase=rng.uniform(0, 2 * np.pi, features),
        weights=np.zeros(size),
        inverse=np.zeros((size, size)),
        curve=(np.array([0.0]), np.array([0.5])),
    )
    if not rows:
        return model

    def partial(batches: Iterator[dict]) -> Iterator[dict]:
        sums = np.zeros((size, size + 1))
        for statistics, labels in _rows(batches):
            made = model.features(statistics)
            sums += made.T @ np.hstack((made, labels[:, None]))
        yield {"sums": [sums.tobytes()]}

    sums = (
        map_columns(labelled, partial, "sums binary")
        .rdd.map(lambda row: np.frombuffer(row.sums).reshape(size, size + 1))
        .treeReduce(np.add, depth=3)
    )
    inverse = inverse_of_positive(sums[:, :size] + ridge * np.eye(size))
    weights = (inverse * sums[:, size]).sum(axis=1)
    model = QualityModel(**{**vars(model), "weights": weights, "inverse": inverse})

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        for statistics, labels in _rows(batches):
            at = model.left_out(statistics, labels).clip(-0.5, 1.5)
            yield {"bin": np.rint((at + 0.5) * (BINS / 2)).astype(int).tolist(), "label": labels.tolist()}

    bins = (
        map_columns(labelled, place, "bin int, label double")
        .groupBy("bin")
        .agg(F.avg("label").alias("label"), F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
        .collect()
    )
    curve = isotonic_curve(
        np.array([b.bin * 2 / BINS - 0.5 for b in bins]),
        np.array([b.label for b in bins]),
        np.array([float(b.n) for b in bins]),
    )
    return QualityModel(**{**vars(model), "curve": curve})


def quality_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label): the mean of an id's labels; ids and labels that are null or not 0/1 are left out."""
    return (
        labels.selectExpr(f"`{id_col}` AS id", f"`{label_col}` AS label")
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.avg("label").alias("label"))
    )


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    held_out_fold: int = 2,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Scores of all whole texts, learnt from the labels of all rows outside the held-out fold.

    Returns ``id_col``, held_out (crc32 of the id modulo ``folds`` is ``held_out_fold``), score (0 to 1)
    and predicted (1 if the score is at least ``threshold``), a row per row of ``docs``. A null text
    counts as empty; empty texts have all statistics 0 and a score like others. A row without an id is
    not held out and has no label. Repeated documents teach once per row; an id with several labels
    has their mean. The statistics are kept in the shared folder, so texts are read once.
    """
    fold = id_remainder(F.col("id"), folds)
    measured = stored(
        docs.select(
            F.col(id_col).alias("id"), statistics_of(F.col(text_col)).alias("statistics")
        ).withColumn("held_out", F.coalesce(fold == held_out_fold, F.lit(False))),
        "quality-statistics",
    )
    learn = measured.where(~F.col("held_out")).join(quality_labels(labels, id_col, label_col), "id")
    model = fit_quality_model(stored(learn.select("statistics", "label"), "quality-labelled"))

    def score(statistics: pa.Array) -> pa.Array:
        rows = np.array(statistics.to_pylist(), dtype=float).reshape(-1, N_STATISTICS)
        return pa.array(model.score(rows), pa.float64())

    return measured.select(
        F.col("id").alias(id_col),
        "held_out",
        F.arrow_udf(score, "double")("statistics").alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
