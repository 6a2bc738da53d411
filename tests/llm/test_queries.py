import random
from collections import Counter

import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import connect, difference
from tallymark.llm.mixing import mix_sources, targets_of
from tallymark.llm.queries import ORACLES, QUERIES


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(ORACLES[name]).df()
    assert difference(got, want) is None


def test_stages_on_odd_documents(spark, odd_docs, docs_of):
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    docs = odd_docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        sizes.append(docs.count())
        if len(sizes) < len(corpus_pipeline.STAGES):
            assert docs.columns == odd_docs.columns and set(columns) <= set(docs.columns)
    # without letters: ids 1, 2, 3, 7 and the null row; the three equal texts are one group
    assert sizes[0] == odd_docs.count() - 5
    assert sizes[1] == sizes[0] - 2 and sizes[2] == sizes[1]
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


@pytest.mark.parametrize("declared", ["en", None, "und"])
def test_texts_in_undeclared_languages_stay(spark, docs_of, declared):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    text = lambda letters: " ".join(word(letters) for _ in range(30))
    rows = [(i, text("abcdefghij"), declared) for i in range(40)]
    rows += [(100 + i, text("αβγδεζηθικλμνξοπ" if i % 2 else "абвгдежзиклмнопр"), None) for i in range(80)]
    got = corpus_pipeline.known_language(spark, docs_of([*rows, (900, "12 34 !!"), (901, None), (902, "")]), "")
    assert sorted(r.doc_id for r in got.collect()) == [r[0] for r in rows]


def test_wrong_and_missing_languages_are_set_right(spark, docs_of):
    rng = random.Random(4)
    letters = {"aa": "abcdefghij", "bb": "klmnopqrst"}
    text = lambda lang: " ".join("".join(rng.choices(letters[lang], k=6)) for _ in range(40))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100, text("aa"), "bb"), (101, text("bb"), None), (102, text("aa"), "und"), (103, text("aa"), "xx")]
    got = {r.doc_id: r.lang for r in corpus_pipeline.known_language(spark, docs_of(rows), "").collect()}
    assert all(got[i] == lang for i, _, lang in rows[:60])
    # a language of one text has a profile of its own
    assert [got[i] for i in (100, 101, 102, 103)] == ["aa", "bb", "aa", "xx"]


def test_one_row_of_each_group(spark, docs_of):
    words = [f"w{i}" for i in range(60)]
    copies = [(i, " ".join([*words[:i], *words[i + 1 :]]), "en", "s") for i in (59, 58, 0, None) if i is not None]
    rows = [*copies, copies[0], (None, " ".join(words)), (None, " ".join(words)), (7, "one of a kind"), (7, "another one with that id")]
    docs = docs_of(rows).selectExpr("*", "'x' AS __id", "'x' AS key", "'x' AS rows", "'x' AS `KEY_`")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert got == [(0, copies[2][1]), (7, "another one with that id"), (7, "one of a kind")]


def test_mix_of_null_and_repeated_ids(spark, docs_of):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = f"t{i} " + "w " * rng.choice((3, 4, 5, 30))
        rows.append((rng.choice((None, 1, 2)), text, rng.choice(("en", None)), rng.choice(("a", "b", "c", None))))
    rows += [(None, "same in both", "en", None), (None, "same in both", None, "en")]
    rows += rows[:60] + rows[:30]
    docs = docs_of(rows)
    decided = mix_sources(docs).agg({"copies": "sum"}).first()[0]
    got = corpus_pipeline.mixed_sources(spark, docs, "").collect()
    held, mixed = Counter(rows), Counter((r.doc_id, r.text, r.lang, r.source) for r in got)
    assert all(n <= 2 * held[row] for row, n in mixed.items())
    words = lambda counts: {
        s: sum(n * len(r[1].split()) for r, n in counts.items() if r[3] == s) for s in sorted({r[3] for r in rows if r[3]}) + [None]
    }
    sizes, taken = words(held), words(mixed)
    targets = dict(zip(sizes, targets_of(list(sizes.values()))))
    assert all(abs(taken[s] - targets[s]) <= 6 for s in targets)
    assert abs(len(got) - decided) <= 12
    same = corpus_pipeline.mixed_sources(spark, docs.repartition(7), "").collect()
    assert Counter(same) == Counter(got)


def test_pipeline_on_the_small_table(spark, sf_dir):
    import tiktoken
    import base64

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen[name] = docs.toPandas()
        docs = spark.createDataFrame(seen[name]) if name != "byte_bpe" else docs
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert len(seen["language_id"]) == len(whole)  # all have letters
    assert seen["minhash_dedup"].doc_id.is_unique
    assert (seen["pii"].text.str.len() == seen["pii"].n_chars).all()
    copies = seen["mixing"].groupby("doc_id").size()
    assert copies.max() <= 2 and set(copies.index) <= set(seen["minhash_dedup"].doc_id)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = seen["mixing"].drop_duplicates("doc_id").set_index("doc_id").text
    assert len(seen["byte_bpe"]) == len(seen["mixing"])
    for row in seen["byte_bpe"].itertuples():
        assert list(row.ids) == library.encode_ordinary(text[row.doc_id])
