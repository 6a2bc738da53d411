import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import tallymark.llm.spelling as spelling
from tallymark.llm.spelling import Words, group_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, deleted=31, min_length=7, min_count=2):
    found = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            word, run = run.translate(LOWER), ""
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if word and h % deleted == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_length:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near = defaultdict(list)
    words = list(n)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda w: (-n[w], w))
        if n[best] >= 10 * n[word]:
            form[word] = best
    out = set()
    for word in words:
        root = word
        while root in form:
            root = form[root]
        out.add((word, form.get(word), root, n[word], len(near[word]), n[form[word]] if word in form else None))
    return out


def as_set(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def random_rows(seed=1):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdé", k=rng.randint(7, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            word = rng.choice(stems[:6] if rng.random() < 0.7 else stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(word))
                word = rng.choice((word[:at] + word[at + 1 :], word[:at] + "ç" + word[at:], word[:at] + "b" + word[at + 1 :]))
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i, rng.choice((" ", ", ", "1")).join(words)))
    # a way of two steps
    return [*rows, (500, "chainword " * 900 + "chainwordo " * 80 + "chainwordos " * 3)]


@pytest.mark.parametrize("part", [8192, 40])
def test_variants_by_brute_force(spark, docs_of, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)
    rows = random_rows()
    want = plain_variants(plain_words(rows))
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    assert as_set(group_variants(docs_of(rows))) == want


def test_odd_documents(spark, odd_docs, docs_of):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_set(group_variants(odd_docs)) == plain_variants(plain_words(rows))
    assert group_variants(docs_of([])).count() == 0
    assert group_variants(docs_of([(1, None), (2, "")])).count() == 0


def test_very_long_words(spark, docs_of):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh", k=50_000))
    near = long[:20_000] + "z" + long[20_001:]
    shorter = long[:-1]
    rows = [(i, " ".join([long, near, shorter, long[::-1]])) for i in range(1, 4)]
    want = plain_variants(plain_words(rows))
    assert len(want) >= 4 and as_set(group_variants(docs_of(rows))) == want


def test_every_pair_within_the_distance_shares_two_groups():
    rng = random.Random(3)
    group = np.array([rng.randrange(spelling.GROUPS) for _ in range(256)])
    for _ in range(200):
        word = "".join(rng.choices("abcdefghijklmnop", k=9))
        at = rng.randrange(9)
        other = word[:at] + rng.choice("xyz") + word[at + 1 :] if rng.random() < 0.5 else word[:at] + word[at + 1 :]
        keys = Words([word, other], group).keys()
        assert (keys[0] == keys[1]).any()
    with pytest.raises(ValueError):
        group_variants(None, ratio=1)
