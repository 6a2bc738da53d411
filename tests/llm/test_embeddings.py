import math

import numpy as np
import pytest

from tallymark.llm import embedding_dedup
from tallymark.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, cosine):
    vectors = [
        None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v)
        else np.array(np.array(v, np.float32), float)
        for _, v in rows
    ]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            if i != j and a is not None and b is not None and len(a) == len(b):
                linked[i, j] = a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(linked)):
            if label[j] is not None and (label[i] is None or label[j] < label[i]):
                label[i], changed = label[j], True
    return sorted(
        ((rows[i][0], int(linked[i].sum()), label[i]) for i in range(n)), key=lambda r: (r[0] is None, r[0] or 0, r[1])
    )


def found(frame):
    rows = near_vectors(frame).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(
        ((r.vec_id, r.n_links, r.component_id) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])
    )


def clustered(seed, n=400, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, size))
    return [
        (i, [float(np.float32(x)) for x in centres[rng.integers(25)] + rng.normal(size=size) * rng.choice((0.05, 0.3, 0.6))])
        for i in range(n)
    ]


@pytest.mark.parametrize("block, chunk", [(1024, 4096), (16, 24)])
def test_links_and_groups_are_those_of_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(math, "isqrt", lambda n: 84)  # seven pivots
    rows = clustered(block)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert found(frame) == brute_force(rows, 0.95)


@pytest.mark.parametrize("strip, tile_bytes", [(7, 12 << 20), (512, 2048), (5, 16384)])
def test_strips_and_small_tiles_lose_nothing(spark, monkeypatch, strip, tile_bytes):
    monkeypatch.setattr(embedding_dedup, "STRIP", strip)
    monkeypatch.setattr(embedding_dedup, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 60)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 100)
    monkeypatch.setattr(math, "isqrt", lambda n: 36)  # three pivots
    rows = clustered(strip, n=300)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert found(frame) == brute_force(rows, 0.95)


def test_odd_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]),
        (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0, 0.0]),
        (11, [-1.0, 0.0]), (12, [0.0, 1.0]),
    ]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    clashing = frame.withColumns({c: F.lit(1) for c in ("id", "node", "vector", "weight", "n_links", "kept")})
    assert found(clashing) == brute_force(rows, 0.95)


def test_rows_without_an_id(spark):
    rows = [(None, [1.0, 0.0], 0), (3, [1.0, 0.01], 0), (None, [0.0, 1.0], 0)]
    got = sorted(near_vectors(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {
        (None, 1, 3, False), (3, 1, 3, True), (None, 0, None, True)
    }


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
