import math
import random

import numpy as np
import pytest

import tallymark.llm.hard_negatives as hard_negatives
from tallymark.llm.hard_negatives import Residues, mine_hard_negatives, primes_for

SCHEMA = "vec_id bigint, label int, embedding array<float>, score string, anchor string, id string"


def plain(rows):
    seen = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        seen[(vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))] = None
    out = []
    for a, label, v in seen:
        if a % 100:
            continue
        scores = sorted(
            ((-sum(x * y for x, y in zip(v, w)), b, other == label) for b, other, w in seen if b != a and len(w) == len(v)),
        )
        for p, positive, _ in [s for s in scores if s[2]][:5]:
            near = [s for s in scores if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, positive, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(near)]
    return sorted(out)


def random_rows(n=700, size=8, seed=1):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.choice((-1, 1, 2)) * rng.randint(0, 30) / 16 for _ in range(size)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def mined(spark, rows):
    return sorted(tuple(r) for r in mine_hard_negatives(frame(spark, rows)).collect())


def test_negatives_by_brute_force(spark, monkeypatch):
    rows = random_rows()
    want = plain(rows)
    assert len(want) > 50 and mined(spark, rows) == want
    # several blocks of anchors and few scores at a time
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "_SCORES", 64)
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rows = random_rows(300, 4, 2)
    rows += [
        (None, 1, [1.0] * 4), (1000, None, [1.0] * 4), (1001, 1, None), (1002, 1, [1.0, None, 1.0, 1.0]),
        (1003, 1, [math.nan] * 4), (1100, 1, [math.inf] * 4), (1200, 1, []), (1300, 2, [0.5, 0.5]),
        (1301, 2, [0.5, 0.25]), (1304, 1, [0.5, 0.25]), (-100, 1, [1.0, -1.0, 1.0, 1.0]), (-3, 2, [0.0] * 4),
    ]
    rows += rows[:40]  # repeated rows
    rows += [(i, 1, [0.5] * 4) for i in range(2000, 2040)] + [(i, 2, [0.5] * 4) for i in range(2040, 2080)]  # ties
    rows += [(100, 1, [2.0] * 4)]  # an id twice
    want = plain(rows)
    assert any(r[0] == 1300 for r in want) and mined(spark, rows) == want
    assert mined(spark, []) == []


def test_scores_are_exact_up_to_the_bound():
    rng = np.random.default_rng(3)
    for size, largest in ((1, 10), (64, 256), (64, 2**25), (5000, 2**20), (9000, 3)):
        rows = rng.integers(-largest, largest + 1, (20, size))
        rows[0], rows[1] = largest, -largest
        made = Residues(size, largest)
        got = made.products(made.split(rows), made.split(rows))
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in rows] for a in rows]
        half = max(made.primes) // 2
        assert min(size, 4096) * half * half < 2**24
    assert math.prod(primes_for(64, 256)) > 2 * 64 * 256 * 256
    with pytest.raises(ArithmeticError):
        Residues(64, 2**31)
