"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. The vector of an n-gram binds those of its letters, each
permuted (rolled) by its place from the end, as their product; a document bundles its n-grams as
their sum, a language bundles its documents, each brought to about unit length first. A document has
the language whose prototype makes the smallest angle with it.

Letter vectors follow from the code point alone, so every executor makes the same ones. Prototypes
are sums of integers: they do not depend on partitions or order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import id_remainder, map_columns, worker_state

DIMENSIONS = 1024
ORDER = 3
#: Most languages that prototypes are gathered for; more raise an error.
MAX_LANGUAGES = 1000
UNKNOWN = "und"

#: Characters of a text that are cut into n-grams at a time.
_SLICE = 1 << 20
#: Documents and distinct n-grams that are bundled at a time, and n-gram vectors kept in a worker.
_TOGETHER, _GRAMS_TOGETHER, _MAX_GRAMS = 64, 6000, 8192
#: Fixed-point scale of a document's weights in a prototype.
_SCALE = float(1 << 16)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters, other characters as single spaces, and counts.

    An n-gram is a number of 21 bits per character.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    tail = np.array([32], dtype=np.int64)
    some = False
    for start in range(0, max(1, len(text)), _SLICE):
        low = text[start : start + _SLICE].lower()
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        letter = _is_letter()[codes]
        some = some or bool(letter.any())
        codes = np.where(letter, codes, 32)
        if start + _SLICE >= len(text):
            codes, letter = np.append(codes, 32), np.append(letter, False)
        before = np.concatenate((tail[-1:] != 32, letter[:-1]))
        codes = np.concatenate((tail, codes[letter | before]))
        if len(codes) >= ORDER:
            key = codes[: len(codes) - ORDER + 1]
            for i in range(1, ORDER):
                key = (key << 21) | codes[i : len(codes) - ORDER + 1 + i]
            found.append(np.unique(key, return_counts=True))
        tail = codes[max(0, len(codes) - ORDER + 1) :]
    if not some or not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)


class GramVectors:
    """The sign vectors of n-grams, made when first needed."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((_MAX_GRAMS, dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= _MAX_GRAMS:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def gram(self, key: int) -> np.ndarray:
        bound = np.ones(self.dimensions, dtype=np.int8)
        for place in range(ORDER):
            bound = bound * np.roll(self.letter((key >> (21 * place)) & 0x1FFFFF), place)
        return bound

    def of(self, keys: np.ndarray) -> np.ndarray:
        """One row of signs per n-gram; at most ``_GRAMS_TOGETHER`` at a time."""
        listed = keys.tolist()
        missing = [k for k in listed if k not in self.rows]
        if len(self.rows) + len(missing) > _MAX_GRAMS:
            self.rows.clear()
            missing = listed
        for key in missing:
            row = self.rows[key] = len(self.rows)
            self.table[row] = self.gram(key)
        return self.table[[self.rows[k] for k in listed]]

    def bundles(self, weights: list[tuple[np.ndarray, np.ndarray]], kind: type) -> np.ndarray:
        """Bundled vectors of documents given as (n-grams, weights)."""
        out = np.zeros((len(weights), self.dimensions), dtype=kind)
        every = np.unique(np.concatenate([k for k, _ in weights])) if weights else np.empty(0, np.int64)
        for start in range(0, len(every), _GRAMS_TOGETHER):
            some = every[start : start + _GRAMS_TOGETHER]
            dense = np.zeros((len(weights), len(some)), dtype=kind)
            for row, (keys, values) in enumerate(weights):
                low, high = np.searchsorted(keys, (some[0], some[-1] + 1))
                dense[row, np.searchsorted(some, keys[low:high])] = values[low:high]
            out += dense @ self.of(some).astype(kind)
        return out


def _vectors(dimensions: int) -> GramVectors:
    return worker_state(("gram vectors", dimensions), lambda: GramVectors(dimensions))


def _partial_prototypes(dimensions: int):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        vectors = _vectors(dimensions)
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list] = {}

        def bundle(lang: str) -> None:
            rows = waiting.pop(lang)
            keys, at = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([w for _, w in rows]))
            made = vectors.bundles([(keys, total)], np.float64)[0]
            sums[lang] = sums.get(lang, 0) + made.astype(np.int64)

        def emit() -> dict:
            for lang in list(waiting):
                bundle(lang)
            out = {"lang": list(sums), "vector": [v.tolist() for v in sums.values()]}
            sums.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                keys, counts = gram_counts(text)
                if not len(keys):
                    continue
                weights = np.rint(counts * (_SCALE / np.sqrt(np.square(counts, dtype=float).sum())))
                waiting.setdefault(lang, []).append((keys, weights))
                if len(waiting[lang]) >= _TOGETHER:
                    bundle(lang)
            if len(sums) + len(waiting) > MAX_LANGUAGES:
                yield emit()
        yield emit()

    return run


def train_prototypes(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS
) -> dict[str, np.ndarray]:
    """One unit vector per value of ``lang_col``, learnt from all rows with a text and a language.

    Rows with a null text or language, or without letters, teach nothing; repeated rows count each
    time. The result is ``dimensions`` numbers per language, for at most ``MAX_LANGUAGES``.
    """
    rows = docs.selectExpr(f"`{lang_col}` AS lang", f"`{text_col}` AS text").where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    partial = map_columns(rows, _partial_prototypes(dimensions), "lang string, vector array<bigint>")
    sums = (
        partial.select("lang", F.posexplode("vector").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .limit(MAX_LANGUAGES * dimensions + 1)
        .collect()
    )
    if len(sums) > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    prototypes: dict[str, np.ndarray] = {}
    for row in sums:
        prototypes.setdefault(row.lang, np.zeros(dimensions))[row.place] = row.value
    return {
        lang: vector / length
        for lang, vector in sorted(prototypes.items())
        if (length := np.sqrt(np.square(vector).sum())) > 0
    }


def language_of(text: Column, prototypes: dict[str, np.ndarray], declared: Column | None = None) -> Column:
    """struct(lang_pred, score, ahead): the nearest prototype by cosine, that cosine cut to 0..1, and by how
    much it is larger than the cosine with the language ``declared``, null where this has no prototype.

    Equal cosines give the first language by code point. A text that is null or has no letters, and
    any text where no prototype was learnt, is ``und`` with score 0.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names])

    place = {name: i for i, name in enumerate(names)}

    def label(texts: pa.Array, declared: pa.Array) -> pa.Array:
        langs, scores, aheads = [], [], []

        def flush(rows: list) -> None:
            known = [r[:2] for r in rows if len(r[0])] if names else []
            if known:
                made = _vectors(matrix.shape[1]).bundles(known, np.float32).astype(float)
                length = np.sqrt(np.square(made).sum(axis=1))
                cosine = made @ matrix.T / np.where(length > 0, length, 1)[:, None]
                best, top = cosine.argmax(axis=1), cosine.max(axis=1).clip(0, 1)
            at = 0
            for keys, _, said in rows:
                if len(keys) and names:
                    langs.append(names[best[at]])
                    scores.append(round(float(top[at]), 9))
                    aheads.append(float(cosine[at].max() - cosine[at, place[said]]) if said in place else None)
                    at += 1
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    aheads.append(None)

        rows: list = []
        for text, said in zip(texts, declared):
            rows.append((*gram_counts(text.as_py() or ""), said.as_py()))
            if len(rows) >= _TOGETHER:
                flush(rows)
                rows = []
        flush(rows)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(aheads, pa.float64())],
            ["lang_pred", "score", "ahead"],
        )

    said = F.lit(None).cast("string") if declared is None else declared.cast("string")
    # not to be worked out once more for a condition on the result
    once = F.arrow_udf(label, "lang_pred string, score double, ahead double").asNondeterministic()
    return once(text, said)


def identify_languages(
    docs: DataFrame,
    folds: int = 3,
    held_out_fold: int = 1,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """The predicted language of every whole text.

    Prototypes are learnt from the rows whose crc32 of the id modulo ``folds`` is not
    ``held_out_fold``. Returns ``id_col``, held_out, lang_pred and score, a row per row of ``docs``.
    A row without an id is not held out and teaches nothing; see ``language_of`` for empty texts.
    """
    fold = id_remainder(F.col(id_col), folds)
    prototypes = train_prototypes(
        docs.where(fold != held_out_fold), lang_col, text_col, dimensions
    )
    return docs.select(
        F.col(id_col),
        F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"),
        language_of(F.col(text_col), prototypes).alias("found"),
    ).select(id_col, "held_out", "found.lang_pred", "found.score")
