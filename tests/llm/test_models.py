import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm.language_id import gram_counts, identify_languages, train_prototypes
from tallymark.llm.line_crf import (
    BOILERPLATE,
    CONTENT,
    N_FEATURES,
    document_counts,
    fit_crf,
    judge_documents,
    learn_line_crf,
    viterbi,
)
from tallymark.llm.quality_model import inverse_of_positive, isotonic_curve, score_quality

SYLLABLES = {"aa": ["tor", "men", "tis", "lu"], "bb": ["ko", "ri", "ma", "ne", "sha"], "cc": ["grz", "ich", "pff", "tz"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_languages_of_held_out_texts(docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(5, 60)), lang) for i in range(240) for lang in [rng.choice("abc") * 2]]
    got = {r.doc_id: r for r in identify_languages(docs_of(rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_prototypes_do_not_depend_on_partitions(docs_of):
    rng = random.Random(2)
    docs = docs_of([(i, prose(rng, "aa", 30), "aa") for i in range(60)])
    one, many = train_prototypes(docs.coalesce(1)), train_prototypes(docs.repartition(7))
    assert (one["aa"] == many["aa"]).all()


def test_grams_of_slices_are_those_of_the_whole(monkeypatch):
    from tallymark.llm import language_id

    text = "Ab, cd  EF-gh \n ij1kl " * 40
    whole = [x.tolist() for x in gram_counts(text)]
    monkeypatch.setattr(language_id, "_SLICE", 7)
    assert [x.tolist() for x in gram_counts(text)] == whole


def test_odd_documents_have_a_language(odd_docs):
    rows = identify_languages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1, 2, 3, 7))
    assert not any(r.held_out for r in rows if r.doc_id is None)
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_languages(nothing).collect()} == {"und"}


def test_empty_tables(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert identify_languages(docs_of([])).count() == 0
    assert score_quality(docs_of([]), labels).count() == 0
    assert judge_documents(docs_of([]), learn_line_crf(docs_of([]), labels)).count() == 0


def corpus(seed, n=300):
    rng = random.Random(seed)
    good = lambda: "\n".join(prose(rng, "aa", 20).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(prose(rng, "aa", 20).upper().replace(" ", "!! ") for _ in range(4))
    marks = [rng.random() < 0.7 for _ in range(n)]
    return [(i, good() if m else bad()) for i, m in enumerate(marks)], [(i, int(m)) for i, m in enumerate(marks)]


def test_quality_of_held_out_documents(docs_of, spark):
    rows, marks = corpus(3)
    labels = spark.createDataFrame(marks + [(None, 1), (5, None), (9999, 0)], "doc_id bigint, quality int")
    got = score_quality(docs_of(rows), labels).collect()
    truth = dict(marks)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_quality_of_odd_documents(odd_docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in score_quality(odd_docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (6, 1), (7, 1)], "doc_id bigint, quality int")
    rows = score_quality(odd_docs, one).collect()
    assert len(rows) == odd_docs.count() and all(r.score == 1 for r in rows)


def test_isotonic_curve_is_the_best_rising_one():
    x, y = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8])
    at, value = isotonic_curve(x, y, np.ones(6))
    assert np.allclose(value, [0.1, 1.1 / 3, 0.85]) and np.allclose(at, [0, 2, 4.5])


def test_inverse():
    a = np.random.default_rng(0).normal(size=(30, 12))
    m = a.T @ a + np.eye(12)
    assert np.allclose(inverse_of_positive(m) @ m, np.eye(12))


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(4)
    for _ in range(50):
        e, m = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        score = lambda s: sum(e[i, x] for i, x in enumerate(s)) + sum(m[a, b] for a, b in zip(s, s[1:]))
        assert tuple(viterbi(e, m)) == max(product((0, 1), repeat=6), key=score)


def test_field_learns_features_and_neighbours():
    rng = np.random.default_rng(5)
    sequences = []
    for _ in range(60):
        labels = np.repeat(rng.integers(0, 2, 5), 4)
        features = rng.normal(size=(20, N_FEATURES))
        features[:, 0] += 1.5 * labels
        sequences.append((features, labels))
    crf = fit_crf(sequences)
    assert crf.moves[CONTENT, CONTENT] > crf.moves[CONTENT, BOILERPLATE]
    right = np.mean([np.mean(np.array(viterbi(crf.emissions(f), crf.moves)) == y) for f, y in sequences])
    assert right > 0.85


def brute_counts(text):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if word.search(x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_counts_of_texts():
    rng = random.Random(6)
    texts = ["", " ", "a", "a a a a", "x y z x y z", "é|é\né|é\n \n", "a\xa0b \x1c c\x0bd"]
    texts += ["".join(rng.choices("ab #\n\té<", k=rng.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert document_counts(text)[:5] == brute_counts(text), text


def test_field_judges_documents(docs_of, spark):
    rows, marks = corpus(7, 120)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    docs = docs_of(rows)
    got = {r.doc_id: r for r in judge_documents(docs, learn_line_crf(docs, labels)).collect()}
    assert all(got[i].kept == bool(mark) for i, mark in marks)


def test_field_judges_odd_documents(odd_docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = judge_documents(odd_docs, learn_line_crf(odd_docs, none)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert [r.n_words for r in rows if r.doc_id == 6] == [40_000]
