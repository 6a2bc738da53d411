import random
import re

import numpy as np
import pytest

from tallymark.llm.components import connected_components
from tallymark.llm.near_dedup import near_duplicates, shingle_set, signature


def shingles(text, words):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return set()
    size = min(words, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def brute_force(rows, words, percent):
    """{id: (set size, component)}"""
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def mutated(rng, words, share):
    return [f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def corpus(seed):
    """Families of copies that change more and more, chains of copies of copies, and short texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((8, 40, 150)))]
        texts += [base] + [mutated(rng, base, rng.choice((0, 0.005, 0.02, 0.05, 0.1))) for _ in range(12)]
        chain = base
        for _ in range(8):
            chain = mutated(rng, chain, 0.015)
            texts.append(chain)
    texts += [[f"w{rng.randrange(5)}" for _ in range(n)] for n in range(8) for _ in range(4)]
    rng.shuffle(texts)
    return [(i, " ".join(t) if i % 3 else " ".join(t).upper()) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(docs_of, words, percent):
    rows = corpus(words)
    got = near_duplicates(docs_of(rows), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_documents(odd_docs):
    rows = near_duplicates(odd_docs, 3, 85).collect()
    assert len(rows) == odd_docs.count()
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 2, 5, True)} <= found
    assert (None, 2, 5, False) in found and (None, 0, None, True) in found


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    assert near_duplicates(docs_of([(1, None)])).count() == 1


def test_signatures_agree_as_the_sets_do():
    a = shingle_set(" ".join(f"x{i}" for i in range(900)), 3)
    b = shingle_set(" ".join(f"x{i}" for i in range(90, 900)), 3)
    assert abs(np.mean(signature(a) == signature(b)) - 0.9) < 0.08
    assert (signature(a[:1]) == a[0]).all()


def test_components_of_a_long_chain(spark):
    import hashlib

    name = lambda i: hashlib.md5(b"%d" % i).digest()
    edges = [(name(i), name(i + 1)) for i in range(300)] + [(name(1000), name(1001)), (name(5), name(5))]
    frame = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    labels = {bytes(r.node): bytes(r.label) for r in connected_components(frame).collect()}
    assert len(labels) == 303
    assert len({labels[name(i)] for i in range(301)}) == 1
    assert len(set(labels.values())) == 2


def test_near_copies_without_ids(spark, docs_of):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words, "x"])
    rows = [(None, near), (None, " ".join([*words, "y"])), (5, " ".join(words)), (None, "alone in the world"), (None, "alone in the world")]
    far = [f"v{i}" for i in range(60)]
    rows += [(None, " ".join([*far, "x"])), (None, " ".join([*far, "y"]))]
    found = near_duplicates(docs_of(rows), words=3, percent=85).collect()
    named = [r for r in found if r.component_id is not None]
    assert len(named) == 3 and [r.kept for r in named if r.doc_id == 5] == [True] and sum(r.kept for r in named) == 1
    nameless = [r for r in found if r.component_id is None]
    assert sorted(r.n_shingles for r in nameless if r.kept) == [2, 2, 59]
