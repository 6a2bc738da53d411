import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tallymark.llm import mixing, warc
from tallymark.llm.mixing import mix_sources, targets_of
from tallymark.llm.pii import Permutation, Pseudonyms, iban_check, luhn_digit, pseudonymise_documents
from tallymark.llm.warc import archive_and_read, parse_record, read_archives, record_bytes, write_archives
from tallymark.sources.scratch import scratch_folder


def sized(seed, n=600):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", None]
    return [
        (i, "w " * int(rng.lognormvariate(3, 1)), "en", rng.choices(names, (5, 1, 1, 1, 1))[0]) for i in range(n)
    ]


def test_targets_share_what_sources_cannot_take():
    assert targets_of([10, 10, 10]) == [20, 7.5, 15] or sum(targets_of([10, 10, 10])) == 45
    for sizes in ([100, 1, 1], [0, 5], [7], [3, 1000, 20, 20], [0, 0]):
        targets = targets_of(sizes)
        assert sum(targets) == Fraction(3, 2) * sum(sizes)
        assert all(t <= 2 * s for t, s in zip(targets, sizes))
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        free = {t / w for t, s, w in zip(targets, sizes, weights) if t < 2 * s}
        assert len(free) <= 1  # sources under their limit have equal shares by weight


@pytest.mark.parametrize("chunk", [4096, 16])
def test_mix_meets_its_targets(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rows = sized(1)
    docs = docs_of(rows)
    got = mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    source = {r[0]: r[3] for r in rows}
    taken, target, sizes = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)
    assert {s: r for s, r in sizes.items()} == {source[r.doc_id]: r.source_size for r in got}
    again = mix_sources(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mix_of_odd_documents(odd_docs, docs_of):
    rows = mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken <= 2 * r.size for r in rows)
    assert [(r.size, r.taken) for r in rows if r.doc_id in (1, 2, 3)] == [(0, 0)] * 3
    assert mix_sources(docs_of([])).count() == 0
    assert [r.taken for r in mix_sources(docs_of([(1, None)])).collect()] == [0]


@pytest.mark.parametrize("size", [2, 3, 10, 97, 4096])
def test_permutation_has_an_inverse_and_no_fixed_point(size):
    p = Permutation(b"k", "x", size)
    there = [p.apply(x) for x in range(size)]
    assert sorted(there) == list(range(size))
    assert all(x != y and p.undo(y) == x for x, y in enumerate(there))
    assert there != [Permutation(b"other", "x", size).apply(x) for x in range(size)] or size < 10


VALUES = [
    ("card", "4539 1488 0343 6467"), ("card", "4539148803436467"), ("ip", "192.168.7.12"), ("date", "2021-02-28"),
    ("date", "31.12.1999"), ("ssn", "123-45-6789"), ("phone", "+1 (626) 555-8013"), ("phone", "+491701234567"),
    ("email", "jo.doe@mail6.example.com"), ("secret", "password=b7db7aa4a5fcc78305"),
    ("iban", "DE89 3704 0044 0532 0130 00"), ("date", "12/25/2024"), ("phone", "+33 1 23 45 67 89"),
    ("phone", "212-555-0123"), ("phone", "(030) 123 4567"), ("phone", "020 7946 0958"),
    ("secret", "password=pässwörtlang"), ("secret", "token=пароль123"),
]


@pytest.mark.parametrize("kind, value", VALUES)
def test_pseudonyms_keep_the_format_and_can_be_undone(kind, value):
    maker = Pseudonyms(b"key")
    text, spans = maker.replace(f"say {value}, twice: {value} end")
    assert [s[2] for s in spans] == [kind, kind]
    first, second = (text[a : a + n] for a, n, _ in spans)
    assert first == second != value and len(first) == len(value)
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    if kind != "secret":
        assert shape(first) == shape(value)
    if kind == "card":
        digits = first.replace(" ", "")
        assert luhn_digit(digits[:-1]) == digits[-1]
    if kind == "iban":
        plain = first.replace(" ", "")
        assert iban_check(plain[:2], plain[4:]) == plain[2:4]
    assert maker.replace(text, undo=True)[0] == f"say {value}, twice: {value} end"


def test_what_fails_its_check_stays():
    text = "4539148803436468 and 300.1.2.3, 2021-02-30, 000-12-3456, plain 12345 and a@b, v1.2.3"
    text += ", 12 345 678 people, population 2024 1234 567, 200.100.300, id 1234-5678-9012, 13/25/2024"
    assert Pseudonyms(b"key").replace(text) == (text, [])


@pytest.mark.parametrize(
    "head, secret, tail",
    [
        ('token = "', "2321bac4e3e49cf46b2d7c90f3602a3d0b907ff1", '"###'),
        ('TOKEN = "', "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", '"!!'),
        ('{"api_key":   "', "Zx9_Lm-42.Qp/7", '", "n": 1}'), ("'password' => '", 'it is jo@a.de "1st"', "'"),
        ("pwd := `", "correct horse 9", "`"), ('{\\"secret\\": \\"', "b7db7aa4a5fcc78305", '\\"}'),
        ("password:\n    ", "Hunter2Hunter", " end"),
        ('secret: "', "nine words of it " * 40 + "end", '"'), ('token = "', "a1B2c3D4" * 50, '"'),
    ],
)
def test_secrets_in_quotes(head, secret, tail):
    maker = Pseudonyms(b"key")
    whole = f"say {head}{secret}{tail} end"
    text, spans = maker.replace(whole)
    start = 4 + len(head)
    made = text[start : start + len(secret)]
    assert [s[2] for s in spans] == ["secret"] and spans[0][0] + spans[0][1] == start + len(secret)
    assert text[:start] == whole[:start] and text[start + len(secret) :] == whole[start + len(secret) :]
    assert all(made[i : i + 12] != secret[i : i + 12] for i in range(0, len(secret) - 5, 12))
    if secret.isalnum() and secret.upper() == secret:
        assert set(made) <= set("0123456789ABCDEF")
    assert maker.replace(text, undo=True)[0] == whole


def test_no_secret_without_a_value():
    text = 'token = "", "user": "nobody", secret: "abc", a token "without a sign"'
    assert Pseudonyms(b"key").replace(text) == (text, [])


NEIGHBOURS = [
    ("card", "", "4539148803436467", " 12/25"), ("card", "order 12 ", "4539148803436467", ""),
    ("card", "12 34 ", "4539 1488 0343 6467", " 99 88"), ("card", "2024-", "4539-1488-0343-6467", "-123"),
    ("card", "7 ", "3782 822463 10005", " 09/27"), ("card", "ids 1234567 ", "4539148803436467", " 7654321, "),
    ("card", "DE89 3704 0044 0532 0130 00 ", "4539148803436467", " 12"),
    ("iban", "", "AT61 1904 3002 3457 3201", " USD"), ("iban", "to ", "AT611904300234573201", " EUR"),
    ("iban", "REF1 XX12 ", "AT61 1904 3002 3457 3201", " BANK 12"), ("iban", "AB12 ABCD EFGH IJKL ", "AT61 1904 3002 3457 3201", ""),
]


@pytest.mark.parametrize("kind, before, value, after", NEIGHBOURS)
def test_cards_and_ibans_beside_other_groups(kind, before, value, after):
    maker = Pseudonyms(b"key")
    text, spans = maker.replace(before + value + after)
    place = (len(before), len(value), kind)
    assert place in spans and text.endswith(after)
    assert text[place[0] :][: place[1]] == maker.replace(value)[0] != value
    assert before.startswith("DE89") or (text.startswith(before) and spans == [place])
    assert maker.replace(text, undo=True, spans=spans)[0] == before + value + after


def test_several_cards_of_one_run():
    maker = Pseudonyms(b"key")
    cards = ["4539148803436467", "4111 1111 1111 1111", "378282246310005"]
    text, spans = maker.replace("12 " + " 34 ".join(cards) + " 56")
    assert text == "12 " + " 34 ".join(maker.replace(c)[0] for c in cards) + " 56"
    assert [s[1] for s in spans] == [len(c) for c in cards]


def test_values_stay_linked_across_documents(docs_of, odd_docs):
    rows = [(i, f"doc {i} has {VALUES[i % 4][1]} in it") for i in range(12)]
    got = {r.doc_id: r for r in pseudonymise_documents(docs_of(rows), b"key").collect()}
    by_value = defaultdict(set)
    for i, text in rows:
        (span,) = got[i].spans
        assert VALUES[i % 4][1] not in got[i].text and got[i].n_found == 1
        by_value[VALUES[i % 4][1]].add(got[i].text[span.start : span.start + span.length])
    assert all(len(v) == 1 for v in by_value.values())
    odd = pseudonymise_documents(odd_docs, b"key").collect()
    assert Counter((r.doc_id, r.text) for r in odd) == Counter((r.doc_id, r.text) for r in odd_docs.collect())
    assert pseudonymise_documents(docs_of([]), b"key").count() == 0


PAGES = "page_id bigint, url string, html string"


def pages_of(spark):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [
        (1, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (3, "http://c/", "small"),
        (4, "http://c/", "small"), (5, None, None), (6, "http://é/", ""), (None, "http://n/", big),
        (9, "http://again/", big), (7, "http://t/", "x" * 1000), (8, "http://t/", "x" * 999),
    ]
    return rows, spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_BYTES, -1])
def test_records_of_all_pages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    rows, pages = pages_of(spark)
    got = archive_and_read(pages.withColumns({c: F.lit("x") for c in ("digest", "file", "block", "response_id")}))
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        revisit = len(payload) >= 1000 and page_id != max(same)
        want.append((
            page_id, len(payload), hashlib.sha1(payload).hexdigest(),
            "revisit" if revisit else "response", max(same) if revisit else None,
        ))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want)


def test_selected_records_and_their_payloads(spark):
    _, pages = pages_of(spark)
    folder = scratch_folder(spark, "warc-test")
    index = write_archives(pages, folder)
    some = read_archives(index.where("page_id IN (3, 9, 1)"), folder, payloads=True).collect()
    held = {(r.page_id, bytes(r.payload).decode() if r.payload is not None else None) for r in some}
    big = "<p>" + "é" * 600 + "</p>"
    assert held == {(3, "small"), (9, big), (1, None)}
    assert read_archives(index.where("false"), folder).count() == 0


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_BYTES, -1])
def test_revisits_name_the_record_with_the_payload(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    rows = [(i, f"http://x/{i}", "a" * 2000 if i % 3 else f"{i}" * 1500) for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES)
    folder = scratch_folder(spark, "warc-revisits")
    index = write_archives(pages, folder)
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    headers = []
    for row in index.collect():
        with system.open_input_file(f"{path}/{row.file}") as file:
            headers.append(parse_record(file.read_at(row.length, row.offset))[0])
    responses = {h["WARC-Record-ID"]: h for h in headers if h["WARC-Type"] == "response"}
    revisits = [h for h in headers if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 199 and len(responses) == 101
    for header in revisits:
        named = responses[header["WARC-Refers-To"]]
        assert named["X-Page-Id"] == header["X-Refers-To-Page-Id"] == "299"
        assert named["WARC-Target-URI"] == header["WARC-Refers-To-Target-URI"]


def test_reading_tasks_follow_the_bytes(spark, monkeypatch):
    """Adaptive execution merges no reading tasks, though the rows of the index are few."""
    monkeypatch.setattr(warc, "BLOCK_BYTES", 2000)
    pages = spark.createDataFrame([(i, "u", random.Random(i).randbytes(500).hex()) for i in range(200)], PAGES)
    folder = scratch_folder(spark, "warc-tasks")
    index = write_archives(pages, folder)
    wanted = index.agg(F.sum("length")).first()[0]
    read = read_archives(index, folder)
    assert read.rdd.getNumPartitions() == -(-wanted // 2000) > 20
    assert read.count() == 200


def test_record_survives_odd_headers():
    sha1 = hashlib.sha1(b"x\r\n\r\ny").digest()
    fields, payload = parse_record(record_bytes(None, "http://a b/\n", b"x\r\n\r\ny", sha1, None))
    assert payload == b"x\r\n\r\ny" and fields["WARC-Target-URI"] == "http://a%20b/%0A"
    assert "X-Page-Id" not in fields


def test_empty_pages(spark):
    assert archive_and_read(spark.createDataFrame([], PAGES)).count() == 0
