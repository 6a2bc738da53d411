"""Mixing sources to target weights by the cube method of balanced sampling.

A source's target over its size is the expected number of copies of each of its documents: the whole
part is taken for certain, the fraction is a probability. The flight moves the fractions of three
documents at a time along the null space of two constraints, the number of documents and their total
size, until one is 0 or 1; both totals stay as they were. A chunk of a source ends with a few fractions;
these fly again among those of other chunks, until one chunk per source is left. Its last fractions land
on the zeros and ones that come nearest to the two totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import WORD, map_columns, stored

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
CEILING = 2
#: Documents of a source that fly together, about; fractions that a chunk leaves, and that land together.
CHUNK = 4096
LEFT = 8
LANDING = 20
#: Sources are planned by the driver; more raise an error.
MAX_SOURCES = 10_000
_NEAR = 1e-9


def targets_of(
    sizes: list[int],
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    ceiling: int = CEILING,
) -> list[Fraction]:
    """Targets by weight of ``share`` of all sizes, none above ``ceiling`` times its size: what a source
    cannot take goes to the others by weight, again and again."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    limit = [Fraction(ceiling * s) for s in sizes]
    # the sources that reach their limits are those with the least limit per unit of weight
    order = sorted(range(len(sizes)), key=lambda i: limit[i] / weight[i])
    left, rest = share * sum(sizes), sum(weight)
    targets = [Fraction(0)] * len(sizes)
    for i in order:
        fair = left * weight[i] / rest
        targets[i] = min(fair, limit[i])
        left, rest = left - targets[i], rest - weight[i]
    return targets


def _step(units: list[list], rng: np.random.Generator) -> None:
    """Move the fractions of the first three units so that at least one becomes 0 or 1."""
    three = units[:3]
    s1, s2, s3 = (u[1] for u in three)
    way = (s2 - s3, s3 - s1, s1 - s2) if not s1 == s2 == s3 else (1, -1, 0)
    ahead = min((1 - u[2]) / w if w > 0 else u[2] / -w for u, w in zip(three, way) if w)
    back = min(u[2] / w if w > 0 else (1 - u[2]) / -w for u, w in zip(three, way) if w)
    by = ahead if rng.random() * (ahead + back) < back else -back
    for u, w in zip(three, way):
        moved = u[2] + by * w
        u[2] = 0.0 if moved < _NEAR else 1.0 if moved > 1 - _NEAR else moved


def _land(units: list[list]) -> None:
    """The zeros and ones whose size, and then number, come nearest to those of the fractions: all
    combinations of one half of the units against all of the other."""

    def choices(part: list[list]) -> tuple[np.ndarray, np.ndarray]:
        sizes, docs = np.zeros(1), np.zeros(1)
        for u in part:
            sizes, docs = np.append(sizes, sizes + u[1]), np.append(docs, docs + 1)
        return sizes, docs

    half = len(units) // 2
    (size_a, docs_a), (size_b, docs_b) = choices(units[:half]), choices(units[half:])
    gap = np.abs(size_a[:, None] + size_b - sum(u[1] * u[2] for u in units)).ravel()
    odd = np.abs(docs_a[:, None] + docs_b - sum(u[2] for u in units)).ravel()
    best = np.flatnonzero(gap <= gap.min() + _NEAR)
    first, second = divmod(int(best[odd[best].argmin()]), len(size_b))
    for i, u in enumerate(units):
        u[2] = float(first >> i & 1 if i < half else second >> (i - half) & 1)


def _flight(level: int, seed: int):
    """Rows come sorted by (source_no, chunk, rank); of a chunk, a few units are held at a time."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, units, rng, final, done = None, [], None, False, []

        def end() -> None:
            if final:
                _land(units)
            done.extend((at, u) for u in units)
            units.clear()

        def emitted() -> dict:
            out = {
                "id": [u[0] for _, u in done],
                "source_no": [key[0] for key, _ in done],
                "chunk": [key[1] for key, _ in done],
                "size": [u[1] for _, u in done],
                "fraction": [u[2] for _, u in done],
                "chunks": [u[3] for _, u in done],
            }
            done.clear()
            return out

        for batch in batches:
            names = ("id", "source_no", "chunk", "size", "fraction", "chunks")
            for id_, source_no, chunk, size, fraction, chunks in zip(*(batch[n] for n in names)):
                if (source_no, chunk) != at:
                    end()
                    at, final = (source_no, chunk), chunks == 1
                    rng = np.random.Generator(np.random.Philox(key=[seed + level, (source_no << 40) + chunk]))
                units.append([id_, size, fraction, chunks])
                while len(units) > (LANDING if final else LEFT):
                    _step(units, rng)
                    done.extend((at, u) for u in units[:3] if u[2] in (0.0, 1.0))
                    units[:3] = [u for u in units[:3] if u[2] not in (0.0, 1.0)]
            yield emitted()
        end()
        yield emitted()

    return run


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    ceiling: int = CEILING,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How much of every document a mix takes.

    Sources in the order of their code points, null last, have ``weights`` in turn and share ``share``
    of all words; see ``targets_of``. Returns ``id_col``, size (words; null text: 0), source_size,
    target (the source's), copies (times that the mix takes the document) and taken (copies times
    size), a row per row of ``docs``. Documents without words are not taken. Null ids and repeated
    rows are units like others. Chunks and random numbers follow from ids and sizes, so a rerun gives
    the same mix on any partitioning. The last fractions of a source land within a fraction of a
    document of its target.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    totals = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda row: (row.source is None, row.source or ""))
    targets = targets_of([row.size for row in totals], weights, share, ceiling)
    plan = []
    for i, (row, target) in enumerate(zip(totals, targets)):
        copies = target / row.size if row.size else Fraction(0)
        whole = int(copies)
        plan.append((i, row.source, row.size, float(target), whole, float(copies - whole), -(-row.n // CHUNK) or 1))
    # a row per source, at most MAX_SOURCES
    planned = F.broadcast(
        spark.createDataFrame(
            plan,
            "source_no int, source string, source_size bigint, target double, whole int, "
            "fraction double, chunks bigint",
        )
    )
    rows = sized.join(planned, sized["source"].eqNullSafe(planned["source"]))
    flying = (F.col("size") > 0) & (F.col("fraction") > 0)
    waiting = rows.where(flying).select(
        "id", "source_no", F.pmod(F.xxhash64("id", "size"), F.col("chunks")).alias("chunk"),
        "size", "fraction", "chunks",
    )
    schema = f"id {kind}, source_no int, chunk bigint, size bigint, fraction double, chunks bigint"
    results: list[DataFrame] = []
    most, level = max([p[-1] for p in plan], default=1), 0
    while True:
        ordered = waiting.repartition("source_no", "chunk").sortWithinPartitions(
            "source_no", "chunk", F.xxhash64("id", "size", F.lit(level)), "id", "size", "fraction"
        )
        moved = stored(map_columns(ordered, _flight(level, seed), schema), "flight")
        results.append(moved.where("fraction IN (0, 1)"))
        if most <= 1:
            break
        # what this many chunks leave is about a chunk again
        merged = max(2, CHUNK // LEFT)
        fewer = f"bigint(ceil(chunks / {merged}))"
        waiting = moved.where("fraction NOT IN (0, 1)").selectExpr(
            "id", "source_no", f"pmod(chunk, {fewer}) AS chunk", "size", "fraction", f"{fewer} AS chunks"
        )
        most, level = -(-most // merged), level + 1
    taken = results[0]
    for more in results[1:]:
        taken = taken.unionByName(more)
    still = rows.where(~flying).select(
        "id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies")
    )
    flown = taken.join(planned.drop("fraction", "chunks"), "source_no").select(
        "id", "size", "source_size", "target", (F.col("whole") + F.col("fraction").cast("int")).alias("copies")
    )
    return still.unionByName(flown).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.col("copies").cast("int").alias("copies"),
        (F.col("copies") * F.col("size")).alias("taken"),
    )
