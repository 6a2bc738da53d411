"""Spelling variants: words one edit apart, found with Gram matrices of letter counts.

One replaced letter changes two letter counts by one, one inserted or deleted letter changes one; so words
one edit apart have count vectors at a squared distance of at most two, and lengths that are equal or
adjacent. A band holds the words of one length and of the next. The alphabet is split into ``GROUPS``
groups of letters: two changed counts leave at least ``GROUPS`` - 2 groups untouched, so every pair shares
the counts of some two groups, and the words of a band that share these are a block. Blocks hold all pairs
within the distance, and are compared independently: the product of a block's matrix of counts with its
own transpose gives all squared distances, and pairs at most two apart are verified letter by letter.

A large block is dealt in parts, each pair of parts being a tile; small blocks that follow each other
in a task share one product. A pair is counted where it first shares two groups, and what leaves a task
are the numbers and the best partners of words, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import map_columns, stored

#: Maximal runs of these characters are the words of a text.
RUN = "[A-Za-zÀ-ÿ]+"
#: One run in ``DELETED`` loses a letter.
DELETED = 31
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least this many times as frequent.
RATIO = 10

GROUPS = 4
_SHARED = list(combinations(range(GROUPS), GROUPS - 2))
#: Words of a part of a large block; words of small blocks that share a product, and characters that
#: a product may hold; words of a strip of a product.
PART, TOGETHER, STRIP = 8192, 256, 512
_CHARACTERS = 1 << 24
#: Tasks among which the words of a large block are dealt.
SALTS = 8


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deleted: int = DELETED,
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``min_length`` code points.

    Where ``deleted`` divides the crc32 of ``<id>:<run>``, the run loses the code point at that number
    modulo its length. A null text has no runs; a null id counts as an empty one.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"),
    )
    # a run that is too short stays so without a letter
    runs = runs.where(F.length("run") >= min_length).withColumn("run", F.translate("run", upper, lower))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    return (
        runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        .withColumn("at", at)
        .select(F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


def letter_groups(vocabulary: DataFrame) -> np.ndarray:
    """The group of each of the 256 characters: letters dealt back and forth, the most frequent first."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    # a row per letter of the alphabet
    found = sorted(((r["count"], r.letter) for r in letters.collect() if r.letter), key=lambda x: (-x[0], x[1]))
    group = np.zeros(256, dtype=np.int64)
    for place, (_, letter) in enumerate(found):
        turn, at = divmod(place, GROUPS)
        group[ord(letter)] = at if turn % 2 == 0 else GROUPS - 1 - at
    return group


class Words:
    """Words of two adjacent lengths at most, as matrices."""

    def __init__(self, words: list[str], group: np.ndarray):
        self.words = np.array(words, dtype=object)
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        widest = int(self.length.max(initial=0))
        inside = np.arange(widest)[None] < self.length[:, None]
        flat = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        self.codes = np.zeros((len(words), widest), dtype=np.uint8)
        self.codes[inside] = flat
        # the same letters, aligned to the right
        self.ends = np.zeros_like(self.codes)
        self.ends[inside[:, ::-1]] = flat
        row = np.repeat(np.arange(len(words)), self.length)
        counts = np.bincount(row * 256 + flat, minlength=256 * len(words)).reshape(-1, 256)
        used = np.flatnonzero(counts.any(axis=0))
        # sums of squares up to 2^24 are exact in single precision
        self.counts = counts[:, used].astype(np.float32 if widest < 2048 else np.float64)
        with np.errstate(over="ignore"):
            weight = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ** np.uint64(3)
            self.groups = np.stack(
                [(counts[:, group == g].astype(np.uint64) * weight[group == g]).sum(axis=1) for g in range(GROUPS)],
                axis=1,
            )

    def keys(self) -> np.ndarray:
        """A hash of the counts of every choice of groups, a column per choice."""
        with np.errstate(over="ignore"):
            columns = [
                sum(self.groups[:, g] * np.uint64(2 * k + 1) for k, g in enumerate(chosen)) for chosen in _SHARED
            ]
        return np.stack(columns, axis=1).view(np.int64)

    def first_shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The first choice of groups whose counts both words of a pair share."""
        same = self.groups[left] == self.groups[right]
        return np.stack([same[:, list(chosen)].all(axis=1) for chosen in _SHARED], axis=1).argmax(axis=1)

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (left < right) at a squared distance of at most two, by strips of the Gram matrix."""
        square = np.square(self.counts).sum(axis=1)
        left, right = [], []
        for start in range(0, len(self.words), STRIP):
            strip = self.counts[start : start + STRIP]
            apart = square[start : start + STRIP, None] + square[None, start:] - 2 * (strip @ self.counts[start:].T)
            i, j = np.nonzero(apart <= 2)
            above = i < j
            left.append(i[above] + start)
            right.append(j[above] + start)
        return np.concatenate(left), np.concatenate(right)

    def one_edit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of different words are one insertion, deletion or replacement apart."""
        differ = self.codes[left] != self.codes[right]
        replaced = (self.length[left] == self.length[right]) & (differ.sum(axis=1) == 1)
        # equal up to one place and from there on, once that place is left out of the longer word
        unlike = self.ends[left] != self.ends[right]
        before = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
        after = np.where(unlike.any(axis=1), unlike[:, ::-1].argmax(axis=1), differ.shape[1])
        shorter = np.minimum(self.length[left], self.length[right])
        inserted = (np.abs(self.length[left] - self.length[right]) == 1) & (before + after >= shorter)
        return replaced | inserted


def _placed(group: np.ndarray):
    """The blocks of every word: (band, choice, key), a row per block."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            by_length: dict[int, list] = {}
            for word, n in zip(batch["word"], batch["n"]):
                by_length.setdefault(len(word), []).append((word, n))
            for length, rows in by_length.items():
                size = max(1, min(4096, _CHARACTERS // length))
                for start in range(0, len(rows), size):
                    some = rows[start : start + size]
                    keys = Words([w for w, _ in some], group).keys()
                    times = 2 * len(_SHARED)
                    yield {
                        "word": [w for w, _ in some for _ in range(times)],
                        "n": [n for _, n in some for _ in range(times)],
                        "band": np.tile(np.repeat([length - 1, length], len(_SHARED)), len(some)),
                        "choice": np.tile(np.arange(len(_SHARED)), 2 * len(some)),
                        "key": np.concatenate([keys, keys], axis=1).ravel(),
                    }

    return run


def _compared(group: np.ndarray):
    """Rows come sorted by (band, choice, key, i, j); those of one tile are held at a time, or of some
    small ones."""

    def partners(band: int, choice: int, rows: list[tuple]) -> Iterator[dict]:
        if len(rows) < 2:
            return
        made = Words([r[0] for r in rows], group)
        left, right = made.near()
        # the longer words among themselves belong to the next band
        wanted = np.minimum(made.length[left], made.length[right]) == band
        left, right = left[wanted], right[wanted]
        part, i, j = (np.array([r[k] for r in rows], dtype=np.int64) for k in (2, 3, 4))
        once = ((i == j)[left] | (part[left] != part[right])) & (made.first_shared(left, right) == choice)
        key = np.array([r[5] for r in rows], dtype=np.int64)
        once &= (key[left] == key[right]) & (i[left] == i[right]) & (j[left] == j[right])
        left, right = left[once], right[once]
        edited = made.one_edit(left, right)
        left, right = left[edited], right[edited]
        if not len(left):
            return
        word, other = np.concatenate((left, right)), np.concatenate((right, left))
        n = np.array([r[1] for r in rows], dtype=np.int64)
        rank = np.empty(len(rows), dtype=np.int64)  # place by frequency, then by code point
        rank[sorted(range(len(rows)), key=lambda r: (-rows[r][1], rows[r][0]))] = np.arange(len(rows))
        order = np.lexsort((rank[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        yield {
            "word": made.words[word[first]],
            "n_near": np.diff(np.append(first, len(word))),
            "best_n": n[other[first]],
            "best": made.words[other[first]],
        }

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, tile, rows = None, None, []
        for batch in batches:
            names = ("band", "choice", "key", "i", "j", "word", "n", "part")
            for band, choice, key, i, j, word, n, part in zip(*(batch[x] for x in names)):
                if (band, choice) != at or (
                    (key, i, j) != tile and (len(rows) >= TOGETHER or len(rows) * band >= _CHARACTERS)
                ):
                    if rows:
                        yield from partners(*at, rows)
                    at, rows = (band, choice), []
                tile = (key, i, j)
                rows.append((word, n, part, i, j, key))
        if rows:
            yield from partners(*at, rows)

    return run


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``vocabulary`` (word, n) that have a near one: their
    number, and the most frequent of them, of equals the first by code point."""
    group = letter_groups(vocabulary)
    placed = map_columns(vocabulary.select("word", "n"), _placed(group), "word string, n bigint, band int, choice int, key bigint")
    block = ["band", "choice", "key"]
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    crowded = (
        placed.groupBy(*block).count().where(F.col("count") > PART)
        .select(*block, F.ceil(F.col("count") / PART).cast("int").alias("parts"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    parts = F.coalesce("parts", F.lit(1))
    dealt = (
        placed.join(crowded, [*block, "salt"], "left")
        .withColumn("part", F.pmod(F.xxhash64("word", F.lit(1)), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(
            "word", "n", *block, "part",
            F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        )
    )
    ordered = dealt.repartition(*block, "i", "j").sortWithinPartitions(*block, "i", "j")
    found = map_columns(ordered, _compared(group), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")
    )


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    deleted: int = DELETED,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """The words of all texts, with the form that each is a variant of; see ``word_counts`` for words.

    Words are near if one code point is inserted, deleted or replaced. Returns word, form (the near word
    of largest n, of equals the first by code point, if that n is at least ``ratio`` times the word's;
    else null), root (the last of the forms from the word on, the word itself without one), n, n_near and
    form_n, a row per different word. Null and empty texts add nothing, repeated rows count each time,
    words of any length are compared whole, and an empty table gives no rows. With a ratio above 1, forms
    get ever more frequent, so the way to the root ends after a logarithmic number of steps.
    """
    if ratio <= 1:
        raise ValueError("forms are more frequent than their variants: the ratio is above 1")
    vocabulary = stored(word_counts(docs, id_col, text_col, deleted, min_length, min_count), "words")
    near = near_words(vocabulary)
    frequent = F.col("best_n") >= ratio * F.col("n")
    found = stored(
        vocabulary.join(near, "word", "left").select(
            "word",
            F.when(frequent, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    # each round doubles the steps from a variant towards its root
    steps = stored(found.where("form IS NOT NULL").selectExpr("word", "form AS root"), "steps")
    while True:
        onward = steps.selectExpr("word AS root", "root AS next")
        doubled = stored(
            steps.join(onward, "root", "left").selectExpr("word", "coalesce(next, root) AS root", "next"), "steps"
        )
        steps = doubled.select("word", "root")
        if doubled.where("next IS NOT NULL").isEmpty():
            break
    return found.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
