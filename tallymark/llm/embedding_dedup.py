"""Near-duplicate embeddings: an exact range join in the angle between vectors.

Pivots cut the sphere into cells, each vector lives in that of its nearest pivot. The angle is a
metric, so the triangle inequality says which other cells can hold a partner: a vector is also sent to
a cell if neither its angles to the two pivots nor the plane half-way between them keep it further off
than the limit. A pair of cells is joined in the later one only. Cells join independently, in tiles of
bounded size: a cell's own vectors in blocks, each block against every chunk of what it may meet.

A tile never emits its pairs: it counts the partners of each vector and reduces its links to a forest
with the same components. Equal vectors are one point with a weight.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import map_columns, stored
from tallymark.llm.components import connected_components

COSINE = 0.95
MAX_PIVOTS = 64
#: Vectors of a cell's block and of a chunk that it meets, fewer where both take more than so many
#: bytes, and those of a block that are compared at once.
BLOCK, CHUNK, TILE_BYTES, STRIP = 8192, 16384, 12 << 20, 512
#: Members of a component are dealt into so many parts to learn its smallest id.
LABEL_PARTS = 16
#: A cosine this near the limit is computed again, with sums that do not depend on order.
_DOUBT = 1e-9


def _usable(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    found = np.array(vector, dtype=float)
    top = np.abs(found).max()
    return found if top > 0 else None


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def points_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, vector): the node is a digest of the vector, null where it cannot be compared; the
    vector is its components as packed doubles."""

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [_usable(v) for v in batch["vector"]]
            packed = [None if v is None else (v + 0.0).astype("<f8").tobytes() for v in found]
            yield {
                "id": batch["id"],
                "node": [None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in packed],
                "vector": packed,
            }

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return map_columns(rows, read, "id bigint, node binary, vector binary")


def _unpacked(batch: dict, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["vector"]), dtype="<f8").reshape(-1, size)


class Cells:
    """Pivots of one dimension and the rules that send vectors to cells."""

    def __init__(self, pivots: np.ndarray, cosine: float):
        self.pivots = _unit(pivots)
        self.limit = math.acos(cosine) + 1e-9
        self.chord = 2 * math.sin(self.limit / 2)
        apart = self.pivots @ self.pivots.T
        self.gap = np.sqrt(np.maximum(2 - 2 * apart, 0))
        self.radius: np.ndarray | None = None

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell, angle to its pivot, and which later cells each vector must visit as well."""
        cosine = (_unit(rows) @ self.pivots.T).clip(-1, 1)
        home = cosine.argmax(axis=1)
        own = cosine.max(axis=1)
        angle = np.arccos(cosine)
        nearest = angle[np.arange(len(rows)), home]
        near = angle <= nearest[:, None] + 2 * self.limit
        # distance of the vector to the plane half-way between its pivot and the other one
        near &= own[:, None] - cosine <= (self.chord + 1e-9) * self.gap[home]
        if self.radius is not None:
            near &= angle <= self.radius + self.limit
        near &= np.arange(len(self.pivots))[None] > home[:, None]
        return home, nearest, near


def _strip_links(home: np.ndarray, others: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows are linked; doubtful ones are decided by the exact cosine."""
    found = _unit(home) @ _unit(others).T
    linked = found >= cosine
    for i, j in zip(*np.nonzero(np.abs(found - cosine) <= _DOUBT)):
        linked[i, j] = exact_cosine(home[i], others[j]) >= cosine
    return linked


def _least_connected(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index connected with each of ``n`` points by the given links."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    return label


def _join_tile(size: int, cosine: float, strip: int):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["visits", "node"], kind="stable")
        own = int((~tile["visits"]).sum())
        if not own:
            return pd.DataFrame({"node": [], "other": [], "links": []})
        rows = np.frombuffer(b"".join(tile["vector"]), dtype="<f8").reshape(-1, size)
        weight = tile["weight"].to_numpy()
        first = 0 if tile["chunk"].iloc[0] == 0 else own  # a block meets itself once
        n = len(rows)
        count, label = np.zeros(n), np.arange(n)
        for start in range(0, own, strip):
            # every pair in one strip: a block's own rows only meet those behind them
            behind = max(first, start)
            left, right = np.nonzero(_strip_links(rows[start : min(start + strip, own)], rows[behind:], cosine))
            left, right = left + start, right + behind
            once = (right >= own) | (left < right)
            left, right = left[once], right[once]
            count += np.bincount(left, weights=weight[right], minlength=n)
            count += np.bincount(right, weights=weight[left], minlength=n)
            # the forest so far is part of the links of the next strip
            tree = np.flatnonzero(label != np.arange(n))
            label = _least_connected(n, np.concatenate((left, tree)), np.concatenate((right, label[tree])))
        nodes = tile["node"].to_numpy()
        touched, edges = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
        return pd.DataFrame({
            "node": np.concatenate((nodes[touched], nodes[edges])),
            "other": np.concatenate((np.full(len(touched), None), nodes[label[edges]])),
            "links": np.concatenate((count[touched].astype(np.int64), np.zeros(len(edges), np.int64))),
        })

    return run


def _cells_of(points: DataFrame, size: int, cosine: float, pivots: int) -> tuple[Cells, list, list]:
    """Cells, with the number of own vectors and an upper bound of visitors for each."""
    chosen = points.orderBy(F.xxhash64("node"), "node").limit(pivots).collect()
    cells = Cells(_unpacked({"vector": [r.vector for r in chosen]}, size), cosine)

    def measure(batches: Iterator[dict]) -> Iterator[dict]:
        n = len(cells.pivots)
        own, visits, widest = np.zeros(n, int), np.zeros(n, int), np.zeros(n)
        for batch in batches:
            if batch["vector"]:
                home, nearest, near = cells.place(_unpacked(batch, size))
                own += np.bincount(home, minlength=n)
                visits += near.sum(axis=0)
                np.maximum.at(widest, home, nearest)
        yield {"cell": list(range(n)), "own": own, "visits": visits, "radius": widest}

    found = (
        map_columns(points.select("vector"), measure, "cell int, own bigint, visits bigint, radius double")
        .groupBy("cell")
        .agg(F.sum("own").alias("own"), F.sum("visits").alias("visits"), F.max("radius").alias("radius"))
        .orderBy("cell")
        .collect()
    )
    cells.radius = np.array([r.radius for r in found]) + 1e-9
    return cells, [r.own for r in found], [r.visits for r in found]


def _tiles(points: DataFrame, size: int, cosine: float, max_pivots: int) -> DataFrame:
    """(node, other, links) of all tiles: counts of partners, and edges of forests."""
    n = points.count()
    pivots = max(1, min(max_pivots, math.isqrt(n) // 12))
    cells, own, visits = _cells_of(points, size, cosine, pivots)
    fit = min(1.0, TILE_BYTES / (8 * size * (BLOCK + CHUNK)))
    block_rows, chunk_rows = max(1, int(BLOCK * fit)), max(1, int(CHUNK * fit))
    blocks = [max(1, -(-count // block_rows)) for count in own]
    chunks = [max(1, -(-(count + more) // chunk_rows)) for count, more in zip(own, visits)]

    def deal(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            if not batch["vector"]:
                continue
            home, _, near = cells.place(_unpacked(batch, size))
            # out of one batch, at most a few thousand rows at a time
            out: dict[str, list] = {k: [] for k in ("cell", "block", "chunk", "visits", "node", "vector", "weight")}
            for i, (node, vector, weight) in enumerate(zip(batch["node"], batch["vector"], batch["weight"])):
                draw = int.from_bytes(node[:8], "little")
                at = int(home[i])
                block = draw % blocks[at]
                places = [(at, block, chunk, False) for chunk in range(chunks[at])]
                for cell in (at, *np.nonzero(near[i])[0].tolist()):
                    chunk = (draw >> 32) % chunks[cell]
                    met = range(block) if cell == at else range(blocks[cell])
                    places += [(cell, other, chunk, True) for other in met]
                for place in places:
                    for key, value in zip(out, (*place, node, vector, weight)):
                        out[key].append(value)
                if len(out["node"]) >= 4096:
                    yield out
                    out = {k: [] for k in out}
            yield out

    dealt = map_columns(
        points.select("node", "vector", "weight"),
        deal,
        "cell int, block int, chunk int, visits boolean, node binary, vector binary, weight bigint",
    )
    return dealt.groupBy("cell", "block", "chunk").applyInPandas(
        _join_tile(size, cosine, STRIP), "node binary, other binary, links bigint"
    )


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """Links between all vectors whose cosine, in double precision, is at least ``cosine``.

    Returns ``id_col``, n_links (other rows linked directly), component_id (the smallest id reachable,
    its own included) and kept (the id is the component's), a row per row of ``vectors``. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths. Rows with equal vectors link with each other, whatever their ids. A null id is
    no component's: its row has the least id it reaches, else null, and is kept in the latter case.

    ``max_pivots`` bounds the driver's share. With few pivots more cells are visited less often; in
    many dimensions a vector without near neighbours is about as far from everything, so it has to
    visit a good part of the cells, and the work then grows with the square of the rows.
    """
    rows = stored(points_of(vectors, id_col, vector_col), "points")
    points = stored(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("id")),
        "distinct-points",
    )
    sizes = [r.size for r in points.select(F.octet_length("vector").alias("size")).distinct().orderBy("size").limit(101).collect()]
    if len(sizes) > 100:
        raise ValueError("more than 100 lengths of vectors")
    found = None
    for size in sizes:
        part = _tiles(points.where(F.octet_length("vector") == size), size // 8, cosine, max_pivots)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"), F.lit(True).alias("kept"),
        )
    found = stored(found, "tiles")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("other IS NOT NULL").selectExpr("node AS a", "other AS b"))
    whole = points.select("node", "id", "weight").join(counts, "node", "left").join(groups, "node", "left")
    whole = whole.select(
        "node", "id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        "label",
    )
    # A point without links is a component; the members of the others meet its least id in parts.
    part = F.pmod(F.xxhash64("node"), F.lit(LABEL_PARTS)).cast("int")
    alone = whole.where("label IS NULL").select("node", "n_links", F.col("id").alias("component_id"))
    linked = whole.where("label IS NOT NULL").withColumn("part", part)
    every_part = F.explode(F.sequence(F.lit(0), F.lit(LABEL_PARTS - 1)))
    least = linked.groupBy("label").agg(F.min("id").alias("component_id")).withColumn("part", every_part)
    known = linked.join(least, ["label", "part"]).select("node", "n_links", "component_id").unionByName(alone)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        rows.select("id", "node")
        .join(known, "node", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
        )
    )
