"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is what the merges would produce exactly if every two neighbours are: undoing
the merges of both from the latest to the earliest, no pair that meets at the border may have a
merge that comes before the one which hides it. So the encoder goes through the text from left to
right, takes the longest token that starts there and fits its left neighbour, falls back to shorter
tokens, and steps back where none fits; positions found to be dead ends are never entered again,
which keeps the work linear. The matches come from one pass of an Aho-Corasick automaton over the
bytes, mapped to the 256 characters of Latin-1; whether two tokens fit is remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tallymark.llm.common import map_columns, worker_state

#: Entries of the caches of pieces and of token pairs in a Python worker; full caches start anew.
MAX_PIECES = 200_000
MAX_PAIRS = 200_000
#: Texts above this many characters are split lazily, not into one list.
LAZY_CHARS = 1 << 22
#: Ids that are gathered before rows go out.
_TOGETHER = 1 << 20


def merged(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """The merges by definition: join the leftmost pair of lowest rank, under ``below``, and repeat."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteBpe:
    """Encoder and decoder for the lines ``base64 rank`` of a rank file."""

    def __init__(self, raw: bytes, pattern: str):
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            # tokens that the merges never reach serve whole pieces only
            if len(token) > 1:
                parts = merged(token, self.ranks, rank)
                if len(parts) != 2:
                    continue
                self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def next_shorter(self, rank: int) -> int | None:
        """The longest reachable token that is a proper prefix."""
        if rank not in self.shorter:
            token, found = self.token[rank], None
            for size in range(len(token) - 1, 0, -1):
                other = self.ranks.get(token[:size])
                if other is not None and (size == 1 or other in self.halves):
                    found = other
                    break
            self.shorter[rank] = found
        return self.shorter[rank]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        ranks, token, halves = self.ranks, self.token, self.halves
        hidden_at = float("inf")
        while True:
            joint = ranks.get(token[left] + token[right])
            if joint is not None and joint < hidden_at:
                return False
            born_left = left if left in halves else -1
            born_right = right if right in halves else -1
            if born_left > born_right:
                hidden_at, left = born_left, halves[left][1]
            elif born_right >= 0:  # among equal ranks the left pair merges first
                hidden_at, right = born_right + 1, halves[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest: list = [None] * size
        for end, (rank, length) in self.matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - length] = rank
        token, compatible = self.token, self.compatible
        dead = bytearray(size + 1)
        out: list[int] = []
        at, rank = 0, longest[0]
        while at < size:
            while rank is not None:
                end = at + len(token[rank])
                if not dead[end] and (not out or compatible(out[-1], rank)):
                    break
                rank = self.next_shorter(rank)
            if rank is not None:
                out.append(rank)
                at = end
                rank = longest[at] if at < size else None
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(token[last])
                rank = self.next_shorter(last)
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids piece by piece, as packed little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        found = (
            self.pattern.findall(text)
            if len(text) <= LAZY_CHARS
            else (m.group() for m in self.pattern.finditer(text))
        )
        for piece in found:
            ids = pieces.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= 64:
                    if len(pieces) >= MAX_PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(raw: bytes, pattern: str) -> ByteBpe:
    return worker_state((raw, pattern), lambda: ByteBpe(raw, pattern))


def encode_documents(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Token ids of every text, and the text decoded from them again.

    Returns ``id_col``, n_tokens, ids (array, with ``keep_ids``), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded bytes). One row per
    row of ``docs``: repeated rows and null ids give rows of their own, a null text counts as empty
    (0 tokens), other columns are not looked at. ``ranks_file`` is read by the driver and sent along;
    its size is that of one vocabulary.
    """
    with open(ranks_file, "rb") as file:
        raw = file.read()

    def run(batches):
        bpe = codec(raw, pattern)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")}
            held = 0
            for id_, text in zip(batch["id"], batch["text"]):
                packed = b"".join(bpe.encode(text or ""))
                ids = np.frombuffer(packed, dtype="<u4")
                out["id"].append(id_)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                if keep_ids:
                    out["ids"].append(ids.astype(np.int64))
                    held += len(ids)
                if held >= _TOGETHER:
                    yield out
                    out, held = {n: [] for n in out}, 0
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, {'ids array<bigint>, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return map_columns(rows, run, schema).withColumnRenamed("id", id_col)


def decode_documents(
    encoded: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """The texts of token ids: ``id_col`` and text. Null ids give a null text, none an empty one;
    bytes that are not UTF-8, as of a cut sequence, become replacement characters."""
    with open(ranks_file, "rb") as file:
        raw = file.read()

    def run(batches):
        bpe = codec(raw, pattern)
        for batch in batches:
            yield {
                "id": batch["id"],
                "text": [
                    None if ids is None else bpe.decode(ids).decode("utf-8", "replace")
                    for ids in batch["ids"]
                ],
            }

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids")
    return map_columns(rows, run, f"id {kind}, text string").withColumnRenamed("id", id_col)
