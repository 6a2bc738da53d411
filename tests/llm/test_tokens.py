import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm.byte_bpe import ByteBpe, decode_documents, encode_documents, merged
from tallymark.llm.token_counts import WordBpe, count_tokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = st.text(alphabet="abehinorst é1 \n'!日", max_size=40)


def read(path):
    with open(path, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def byte_bpe():
    return ByteBpe(read(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def byte_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read(RANKS).splitlines())}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def word_bpe():
    return WordBpe(read(WORDS))


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_of(bpe, text):
    return np.frombuffer(b"".join(bpe.encode(text)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=PIECES)
def test_ids_are_those_of_the_library(byte_bpe, byte_library, text):
    ids = ids_of(byte_bpe, text)
    assert ids == byte_library.encode_ordinary(text)
    assert byte_bpe.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(piece=st.binary(min_size=1, max_size=24) | st.text("aest", min_size=1, max_size=60).map(str.encode))
def test_backtracking_gives_the_merges(byte_bpe, piece):
    want = [byte_bpe.ranks[p] for p in merged(piece, byte_bpe.ranks)]
    assert byte_bpe.encode_piece(piece) == want


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9000, " " * 9000, "日" * 5000])
def test_long_pieces_take_linear_time(byte_bpe, byte_library, text):
    assert ids_of(byte_bpe, text) == byte_library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(text=PIECES | st.sampled_from(["x<|endoftext|>Y", "ΑΣ Σ", "é DON'T", "<|endof<|endoftext|>"]))
def test_counts_are_those_of_the_library(word_bpe, word_library, text):
    assert word_bpe.count(text) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        WordBpe(read(public_tokenizers.path("byte_bpe_50k.json")))


def test_odd_documents_are_counted(odd_docs):
    rows = count_tokens(odd_docs, WORDS, limit=3).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].n_bytes, by_id[1].n_tokens, by_id[1].over_limit) == (0, 0, False)
    assert by_id[2].n_tokens == by_id[3].n_tokens == 0 and by_id[3].n_bytes == 4
    assert by_id[5].n_tokens == 4 and by_id[5].over_limit and not by_id[4].over_limit
    assert sum(r.doc_id is None for r in rows) == 2


def test_odd_documents_are_encoded_and_decoded(odd_docs):
    encoded = encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN)
    rows = encoded.collect()
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    digests = sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), key=key)
    assert sorted(((r.doc_id, r.decoded_sha256) for r in rows), key=key) == digests
    for row in rows:
        packed = np.array(row.ids, "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(row.ids), hashlib.sha256(packed).hexdigest())
    back = decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(texts, key=key)


def test_empty_table(docs_of):
    assert count_tokens(docs_of([]), WORDS).count() == 0
    assert encode_documents(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0
