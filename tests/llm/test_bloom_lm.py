import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import tallymark.llm.bloom_lm as bloom_lm
from tallymark.llm.bloom_lm import level_floors, plan_filter, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quantised(count):
    if not count:
        return 0.0
    floors = level_floors().tolist()
    k = max(i for i, f in enumerate(floors) if f <= count)
    return (floors[k] + floors[k + 1] - 1) / 2


def plain_scores(rows, order):
    """(held_out, n_tokens, n_known, N, base, score) of (doc_id, text) with exact tables."""
    texts = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows]
    fold = [None if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in rows]
    training = [t for t, f in zip(texts, fold) if f not in (1, None)]
    grams = Counter()
    for tokens in training:
        whole = ["<", *tokens]
        grams.update(tuple(whole[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(max(1, n - 1), len(whole)))
    total = sum(c for g, c in grams.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in grams)
    count = lambda g: len(training) if g == ("<",) else quantised(grams[g])
    out = []
    for tokens, f in zip(texts, fold):
        whole, base, score = ["<", *tokens], 0.0, 0.0
        for i in range(1, len(whole)):
            c = grams[(whole[i],)]
            base += math.log10((c + 0.5) / (total + 0.5 * (types + 1)))
            shorter = min(count((whole[i],)), max(total, len(training)))
            p = min(1.0, (shorter + 0.5) / (total + 0.5 * (types + 1)))
            for n in range(2, order + 1):
                if i - n + 1 < 0:
                    break
                history, c = held(count, whole, i - 1, n - 1), held(count, whole, i, n)
                m = 2.0 * history**0.9 + 1
                p = (c + m * p) / (history + m)
            score += math.log10(p)
        known = sum(grams[(t,)] > 0 for t in tokens)
        out.append((f == 1, len(tokens), known, total, base, score))
    return out


def held(count, whole, i, n):
    """The count of the n tokens that end at i, at most those of its history and of its shorter ending."""
    c = count(tuple(whole[i - n + 1 : i + 1]))
    return c if n == 1 else min(c, held(count, whole, i - 1, n - 1), held(count, whole, i, n - 1))


def compare(frame, want, tolerance):
    got = sorted((tuple(r)[1:] for r in frame.collect()), key=lambda r: (r[:4], r[4]))
    want = sorted(want, key=lambda r: (r[:4], r[4]))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], abs=1e-6)
        assert abs(g[5] - w[5]) <= tolerance * w[1] + 1e-6


def random_rows(seed=4):
    rng = random.Random(seed)
    words = ["the", "a", "of", "Cat", "dog", "sat", "on", "mat", *(f"w{i}" for i in range(200))]
    text = lambda: " ".join(rng.choices(words, weights=[40] * 8 + [1] * 200, k=rng.randint(0, 80)))
    return [(i, text()) for i in range(150)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_exact_tables(spark, docs_of, monkeypatch, order):
    monkeypatch.setattr(bloom_lm, "ENTRY_BITS", 60)  # hardly a false positive
    rows = random_rows()
    compare(score_documents(docs_of(rows), order=order), plain_scores(rows, order), 1e-3)


def test_rare_words_are_joined_and_texts_are_cut(spark, docs_of, monkeypatch):
    monkeypatch.setattr(bloom_lm, "ENTRY_BITS", 60)
    monkeypatch.setattr(bloom_lm, "FREQUENT", 50)
    monkeypatch.setattr(bloom_lm, "_SLICE", 16)
    monkeypatch.setattr(bloom_lm, "_TOGETHER", 64)
    monkeypatch.setattr(bloom_lm, "BUCKET_BYTES", 256)
    rows = random_rows(5)
    compare(score_documents(docs_of(rows), order=3), plain_scores(rows, 3), 1e-3)


def test_odd_documents(spark, odd_docs, docs_of, monkeypatch):
    monkeypatch.setattr(bloom_lm, "ENTRY_BITS", 60)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    compare(score_documents(odd_docs), plain_scores(rows, 2), 1e-3)
    assert score_documents(docs_of([])).count() == 0
    # nothing to learn from
    only = score_documents(docs_of([(None, "some words"), (None, None)])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in only] == [(0, 0, 0.0, 0.0)] * 2


def test_levels_are_never_too_low_and_seldom_too_high(monkeypatch):
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)
    counts = rng.zipf(1.7, len(keys)).clip(1, 10**6)
    level = bloom_lm.levels_of(counts)
    number = {(1, int(q)): int((level[:20_000] == q).sum()) for q in np.unique(level[:20_000])}
    bloom = plan_filter(number, 16)
    order = np.argsort(keys[:20_000])
    made = {}
    bloom_lm._set_bits(made, bloom, keys[:20_000][order], level[:20_000][order])
    bloom.bits = b"".join(made[s].tobytes() for s in range(16))
    assert (bloom.levels(keys[:20_000]) >= level[:20_000]).all()
    assert (bloom.levels(keys[:20_000]) > level[:20_000]).mean() < 0.01
    assert (bloom.levels(keys[20_000:]) > 0).mean() < 0.01


def test_a_full_filter_leaves_out_the_rarest():
    small = plan_filter({(1, 1): 1000, (1, 5): 10, (2, 3): 50}, 4, max_bits=64 * 4 * 8)
    assert small.least == 2 and small.segments * small.segment_bits <= 64 * 4 * 8
    assert plan_filter({}, 1).segment_bits == 64


def test_a_filter_in_segments_keeps_all_levels(spark, docs_of, monkeypatch):
    monkeypatch.setattr(bloom_lm, "ENTRY_BITS", 60)
    monkeypatch.setattr(bloom_lm, "SEGMENT_BITS", 1 << 12)
    monkeypatch.setattr(bloom_lm, "ASKING_BYTES", 256)
    monkeypatch.setattr(bloom_lm, "SCORED_BYTES", 1 << 12)
    monkeypatch.setattr(bloom_lm, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(bloom_lm, "_SLICE", 16)
    monkeypatch.setattr(bloom_lm, "_TOGETHER", 64)
    rows = [*random_rows(7), (500, None), (None, "the cat"), (None, "the cat"), (501, "")]
    # far less than the entries take
    compare(score_documents(docs_of(rows), order=3, max_bits=64), plain_scores(rows, 3), 1e-3)
    model, _, parts = bloom_lm.learn_bloom_lm(docs_of(rows).select("text"), 2, 64)
    assert model.bloom.least == 1 and model.bloom.bits is None and parts is not None
    assert model.bloom.segments > 4 and model.bloom.segment_bits <= 1 << 12


def test_held_out_texts_are_better_foreseen_than_by_single_words(spark, sf_dir):
    got = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    held_out = got[got.held_out]
    assert held_out.score.sum() > 0.95 * held_out.base_score.sum()  # both are negative
    assert (got.score <= 0).all() and (got.n_known <= got.n_tokens).all()
