"""Hard negatives for embeddings: exact integer scores from matrix products modulo small primes.

Components become integers. A score is an inner product of two rows of integers; in a residue number
system it is computed modulo several small primes, each by one product of float32 matrices whose sums stay
below 2^24 and so are exact, and rebuilt from its residues by Chinese remaindering. The primes are as many
as the largest component asks for.

Anchors meet all rows in blocks: a block of anchors of bounded size is sent to every task, which streams
its rows past it and keeps, per anchor, only the best few. Windows over what the tasks have kept select
first the positives, then, by the scores of these, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import map_columns, stored
from tallymark.sources.scratch import scratch_folder

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this share of the positive, in hundredths, and at most as much.
LEAST_PERCENT = 80
#: Anchors that are sent to the tasks at a time, at most, and the bytes of their components.
BLOCK, BLOCK_BYTES = 16_384, 1 << 23
#: Scores that are looked at at a time, and components in one product.
_SCORES, _SLAB = 1 << 20, 4096
_EXACT = 1 << 24


def primes_for(size: int, largest: int) -> list[int]:
    """Primes for inner products of ``size`` components up to ``largest`` in size: none so large that a sum
    of products of centred residues leaves float32, together more than twice the largest score."""
    most = math.isqrt(4 * (_EXACT - 1) // max(1, min(size, _SLAB)))
    found: list[int] = []
    product = 1
    candidate = most
    while product <= 2 * size * largest * largest + 1:
        if candidate < 2:
            raise ValueError("components too large for exact scores")
        if all(candidate % d for d in range(2, math.isqrt(candidate) + 1)):
            found.append(candidate)
            product *= candidate
        candidate -= 1
    return found


class Residues:
    """Exact inner products of integer rows by their residues."""

    def __init__(self, size: int, largest: int):
        if size * largest * largest >= 1 << 62:
            raise ArithmeticError(f"scores of components up to {largest} do not fit a long")
        self.primes = primes_for(size, largest)

    def centred(self, rows: np.ndarray, prime: int) -> np.ndarray:
        half = prime // 2
        return ((rows + half) % prime - half).astype(np.float32)

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        """One matrix of centred residues per prime."""
        return [self.centred(rows, p) for p in self.primes]

    def products(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """All scores of ``left`` rows with ``right`` rows, signed.

        The digits of a score in the mixed radix of the primes are found one after the other, each from
        the residue that is left once the digits before are taken out. Centred digits give the score
        with its sign, as it is less than half the product of all primes.
        """
        score = digits = None
        radix = 1
        seen: list[tuple[int, np.ndarray]] = []  # (radix, digit)
        for prime, a, b in zip(self.primes, left, right):
            rest = np.zeros((len(a), len(b)), dtype=np.int64)
            for start in range(0, a.shape[1], _SLAB):
                rest += (a[:, start : start + _SLAB] @ b[:, start : start + _SLAB].T).astype(np.int64)
            for weight, before in seen:
                rest -= (weight % prime) * before
            digits = rest % prime * pow(radix % prime, -1, prime) % prime if radix > 1 else rest % prime
            digits = np.where(digits > prime // 2, digits - prime, digits)
            score = digits if score is None else score + radix * digits
            seen.append((radix, digits))
            radix *= prime
        return score if score is not None else np.zeros((len(left[0]) if left else 0, 0), dtype=np.int64)


def usable_rows(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, moved_every: int, labels: int
) -> DataFrame:
    """(id, label, vector of integers): rows with an id, a label and only finite components, each once."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col) % moved_every == 0, (label + 1) % labels).otherwise(label)
    return (
        vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
        .select(F.col(id_col).cast("long").alias("id"), moved.alias("label"), whole.alias("vector"))
        .dropDuplicates(["id", "label", "vector"])
    )


class Anchors:
    """A block of anchors, as sent to the tasks, and the search for the best rows."""

    def __init__(self, rows: list, size: int, largest: int):
        self.numbers = np.array([r.anchor for r in rows], dtype=np.int64)
        self.ids = np.array([r.id for r in rows], dtype=np.int64)
        self.labels = np.array([r.label for r in rows], dtype=np.int64)
        self.vectors = np.array([r.vector for r in rows], dtype=np.int64).reshape(len(rows), size)
        self.size, self.largest = size, largest
        #: Of each anchor, the different scores of its positives, from the largest; rows padded with
        #: a score below all others.
        self.limits: np.ndarray | None = None

    def _best(self, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray, kept: list, most: int) -> list:
        """The first ``most`` wanted rows of each anchor by (score down, id up), with those already kept.
        ``kept`` is (scores, ids), a row per anchor, absent places with the least score."""
        lowest = np.iinfo(np.int64).min
        scores = np.where(wanted, scores, lowest)
        if scores.shape[1] > most:
            # nothing below the score in this place can be among the first
            edge = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
            edge = np.maximum(edge, kept[0].min(axis=1))
        else:
            edge = kept[0].min(axis=1)
        row, column = np.nonzero((scores >= edge[:, None]) & (scores > lowest))
        if not len(row):
            return kept
        old_row, old = np.nonzero(kept[0] > lowest)
        row = np.concatenate((row, old_row))
        score = np.concatenate((scores[row[: len(column)], column], kept[0][old_row, old]))
        found = np.concatenate((ids[column], kept[1][old_row, old]))
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        starts = np.searchsorted(row, np.arange(len(kept[0])))
        place = np.arange(len(row)) - starts[row]
        first = place < most
        new = [np.full_like(kept[0], lowest), np.zeros_like(kept[1])]
        new[0][row[first], place[first]] = score[first]
        new[1][row[first], place[first]] = found[first]
        return new

    def search(self, most: int, least_percent: int):
        """Best rows of each anchor within a task: positives, or negatives where limits are set."""

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            residues = Residues(self.size, self.largest)
            own = residues.split(self.vectors)
            n = len(self.ids)
            lowest = np.iinfo(np.int64).min
            windows = 1 if self.limits is None else self.limits.shape[1]
            empty = lambda: [np.full((n, most), lowest), np.zeros((n, most), dtype=np.int64)]
            kept = [empty() for _ in range(windows)]
            step = max(1, _SCORES // max(1, n))
            for batch in batches:
                for start in range(0, len(batch["id"]), step):
                    ids = np.array(batch["id"][start : start + step], dtype=np.int64)
                    labels = np.array(batch["label"][start : start + step], dtype=np.int64)
                    rows = np.array(batch["vector"][start : start + step], dtype=np.int64).reshape(len(ids), self.size)
                    scores = residues.products(own, residues.split(rows))
                    same = self.labels[:, None] == labels[None]
                    if self.limits is None:
                        wanted = same & (self.ids[:, None] != ids[None])
                        kept[0] = self._best(scores, ids, wanted, kept[0], most)
                        continue
                    for w in range(windows):
                        top = self.limits[:, w, None]
                        # in exact integers: hundredths of a score may leave a long, shares of it do not
                        floor = -((-top * least_percent) // 100) if self._narrow() else _share_up(top, least_percent)
                        wanted = ~same & (scores <= top) & (scores >= floor) & (top > lowest)
                        kept[w] = self._best(scores, ids, wanted, kept[w], most)
            for w in range(windows):
                anchor, place = np.nonzero(kept[w][0] > lowest)
                yield {
                    "anchor": self.numbers[anchor],
                    "window": np.full(len(anchor), w),
                    "id": kept[w][1][anchor, place],
                    "score": kept[w][0][anchor, place],
                }

        return run

    def _narrow(self) -> bool:
        return self.size * self.largest * self.largest < 1 << 55


def _share_up(top: np.ndarray, percent: int) -> np.ndarray:
    """The least integers at or above ``percent`` hundredths of ``top``, without overflow."""
    whole, rest = np.floor_divide(top, 100), np.mod(top, 100)
    return whole * percent + -((-rest * percent) // 100)


_FOUND = "anchor bigint, window int, id bigint, score bigint"


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def mine_hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchors_every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    scale: int = SCALE,
    moved_every: int = 7,
    labels: int = 10,
) -> DataFrame:
    """For every anchor and each of its positives, the first rows of other labels that score close below.

    Components become ``floor(scale * x)``; a score is an integer inner product with the anchor, higher
    ones come first, ties by the smaller id. Where ``moved_every`` divides the id, the label first becomes
    the next one modulo ``labels``. Anchors are the rows whose id ``anchors_every`` divides, positives
    their first rows of the same label and another id. A negative's score is from ``least_percent``
    hundredths of the positive's up to it, so a negative positive score has none. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows without an id or a label, without a vector or with null or non-finite components take no part.
    Repeated rows count once; rows that share an id but not their content count each, and are no partners
    of an anchor of the same id. Vectors of different lengths do not meet, empty ones score 0. An empty
    table gives no rows. Scores that do not fit a long raise an error.
    """
    spark = vectors.sparkSession
    rows = stored(
        usable_rows(vectors, id_col, vector_col, label_col, scale, moved_every, labels)
        .withColumn("size", F.size("vector")),
        "rows",
    )
    largest = F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda a, v: F.greatest(a, F.abs(v))))
    is_anchor = F.col("id") % anchors_every == 0
    anchors = stored(
        rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors"
    )
    # lengths of vectors are few; only those that have anchors matter
    sizes = anchors.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    written: list[str] = []
    for size, n in sorted((r.size, r.n) for r in sizes):
        same_size = rows.where(F.col("size") == size)
        top = same_size.agg(largest.alias("top")).first().top or 0
        most = max(1, min(BLOCK, BLOCK_BYTES // max(1, 8 * size)))
        blocks = -(-n // most)
        # dealt by hash, so about equal
        numbered = anchors.where(F.col("size") == size).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
        for block in range(blocks):
            found = _block_negatives(
                numbered.where(F.col("block") == block), same_size, size, top, positives, negatives, least_percent
            )
            written.append(scratch_folder(spark, "negatives"))
            found.write.parquet(written[-1])
    if not written:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(*written)


def _block_negatives(
    block: DataFrame, rows: DataFrame, size: int, largest: int, positives: int, negatives: int, least_percent: int
) -> DataFrame:
    # at most about BLOCK anchors
    held = Anchors(block.select("anchor", "id", "label", "vector").collect(), size, largest)
    candidates = rows.select("id", "label", "vector")
    near = map_columns(candidates, held.search(positives, least_percent), _FOUND)
    chosen = stored(_first(near, ["anchor"], positives).drop("window"), "positives")

    # the different scores of an anchor's positives are its windows, at most ``positives``
    level = F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.col("score").desc())) - 1
    chosen = chosen.withColumn("window", level)
    limits = chosen.select("anchor", "window", "score").distinct().collect()
    held.limits = np.full((len(held.ids), positives), np.iinfo(np.int64).min)
    place = {number: i for i, number in enumerate(held.numbers.tolist())}
    for row in limits:
        held.limits[place[row.anchor], row.window] = row.score
    found = map_columns(candidates, held.search(negatives, least_percent), _FOUND)
    first = _first(found, ["anchor", "window"], negatives)
    return (
        chosen.select("anchor", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(first.select("anchor", "window", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "window"])
        .join(block.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
