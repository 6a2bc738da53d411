"""Token counts of a word-end BPE vocabulary, without making any token.

A word of n symbols that takes m merges has n - m tokens. The symbols of a word are kept as a linked
list, its adjacent pairs in a heap by (rank, position); the lowest one is popped and merged until
none is left. Entries of pairs that an earlier merge has changed are recognised when popped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from tallymark.llm.common import map_columns, worker_state

#: Entries of the cache of words in a Python worker; a full cache starts anew.
MAX_WORDS = 500_000
LAZY_CHARS = 1 << 22


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: the printable
    ones of Latin-1 for themselves, the others in order from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Counter for a tokenizer file with NFC, lower case, a regular split and word ends."""

    def __init__(self, raw: bytes):
        import regex

        spec = json.loads(raw)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        kinds = [s["type"] for s in split]
        if (
            model["type"] != "BPE" or not model["end_of_word_suffix"]
            or steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"]
            or not split[0]["invert"] or split[0]["behavior"] != "Removed"
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError("this counter is for lower-cased byte-level BPE with word ends")
        # white space is dropped by the split, so replacing it first changes nothing
        self.pattern = regex.compile(split[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        ids = {symbol: i for i, symbol in enumerate(sorted(
            {x for pair in model["merges"] for x in (*pair, pair[0] + pair[1])} | set(model["vocab"])
        ))}
        chars, end = byte_symbols(), model["end_of_word_suffix"]
        self.inner = [ids[c] for c in chars]
        self.last = [ids[c + end] for c in chars]
        self.merges = {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])
        }
        self.words: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        data, merges = word.encode(), self.merges
        size = len(data)
        symbol = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        heap = [
            (found[0], i, symbol[i], symbol[i + 1])
            for i in range(size - 1)
            if (found := merges.get((symbol[i], symbol[i + 1])))
        ]
        heapify(heap)
        after, before = [*range(1, size + 1)], [*range(-1, size - 1)]
        done = 0
        while heap:
            _, at, left, right = heappop(heap)
            to = after[at]
            if symbol[at] != left or to >= size or symbol[to] != right:
                continue
            made = symbol[at] = merges[left, right][1]
            symbol[to] = -1
            done += 1
            follower = after[at] = after[to]
            if follower < size:
                before[follower] = at
                if found := merges.get((made, symbol[follower])):
                    heappush(heap, (found[0], at, made, symbol[follower]))
            prior = before[at]
            if prior >= 0 and (found := merges.get((symbol[prior], made))):
                heappush(heap, (found[0], prior, symbol[prior], made))
        return size - done

    def count_plain(self, text: str) -> int:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # each character for itself: no final form of sigma
        text = text.replace("Σ", "σ").lower()
        found = (
            self.pattern.findall(text)
            if len(text) <= LAZY_CHARS
            else (m.group() for m in self.pattern.finditer(text))
        )
        words, total = self.words, 0
        for word in found:
            count = words.get(word)
            if count is None:
                count = self.count_word(word)
                if len(word) <= 64:
                    if len(words) >= MAX_WORDS:
                        words.clear()
                    words[word] = count
            total += count
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        parts = self.special.split(text)
        return sum(map(self.count_plain, parts)) + len(parts) - 1


def counter(raw: bytes) -> WordBpe:
    return worker_state(raw, lambda: WordBpe(raw))


def count_tokens(
    docs: DataFrame,
    tokenizer_file: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every text: ``id_col``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``).

    One row per row of ``docs``: repeated rows and null ids give rows of their own, a null text counts
    as empty (0 bytes, 0 tokens), other columns are not looked at. Strings of special tokens inside a
    text are one token each, as is the library's default. ``tokenizer_file`` is read by the driver and
    sent along; its size is that of one vocabulary.
    """
    with open(tokenizer_file, "rb") as file:
        raw = file.read()

    def run(batches):
        bpe = counter(raw)
        for batch in batches:
            sizes, counts = [], []
            for text in batch["text"]:
                sizes.append(len((text or "").encode()))
                counts.append(bpe.count(text or ""))
            yield {
                "id": batch["id"],
                "n_bytes": sizes,
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return map_columns(
        rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    ).withColumnRenamed("id", id_col)
