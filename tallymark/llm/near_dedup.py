"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidates.

Texts with the same set of word shingles are one node. A single hash of every shingle gives a node's
signature: the top bits choose a bin, each bin keeps its least hash, and an empty bin borrows from
another one in an order of its own (optimal densification). Bands of the signature are buckets.

Candidates in a bucket form a star: its centre is the member that shares the most bucket places
overall, which in a group of copies is the text that the others come from. The pairs of a star are
confirmed on the full sets. What a star leaves open, pairs of a bucket that are not yet connected, is
compared too, except where sizes or the exact distances to the centre rule a link out (the Jaccard
distance is a metric), or where one-bit sketches of the signatures differ in more places than six
standard deviations above those of a pair at the limit. So hardly any pair that shares a bucket is
lost, and groups that hang together by their centre never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import map_columns, mixed, stored, worker_state
from tallymark.llm.components import connected_components

WORDS = 5
PERCENT = 80
BANDS = 42
ROWS = 6
#: Members of a star that meet as many others at a time.
TILE = 512
#: Tasks among which the members of a star are dealt.
SALTS = 16

_BITS = 9
_BINS = 1 << _BITS
#: Words whose hashes a worker keeps; a full cache starts anew.
_MAX_WORDS = 100_000
#: Shingles that are gathered before sets go out.
_TOGETHER = 1 << 19
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased; a text with fewer
    words has its whole sequence as its only shingle, one without words has none."""
    found = text.encode().translate(_LOWER).split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    size = min(n, words)
    hash_of = worker_state("word hashes", _WordHashes)
    code = np.fromiter(map(hash_of.__getitem__, found), dtype=np.uint64, count=n)
    key = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        key = mixed(key ^ code[i : n - size + 1 + i])
    return np.unique(key)


@lru_cache(maxsize=1)
def _borrowing_order() -> np.ndarray:
    """For each bin, all bins in a random order of its own."""
    return np.random.default_rng(11).permuted(np.tile(np.arange(_BINS), (_BINS, 1)), axis=1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash per bin; an empty bin has that of the first filled one in its borrowing order."""
    starts = np.searchsorted(shingles, np.arange(_BINS, dtype=np.uint64) << np.uint64(64 - _BITS))
    ends = np.append(starts[1:], len(shingles))
    filled = starts < ends
    least = shingles[np.minimum(starts, len(shingles) - 1)]
    if filled.all():
        return least
    empty = np.flatnonzero(~filled)
    order = _borrowing_order()[empty]
    least[empty] = least[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One bucket key per band of a signature, which holds the band's number."""
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key ^ rows[:, i])
    return key


def sketch_bits(least: np.ndarray) -> np.ndarray:
    """One bit per bin of a signature, drawn anew for every bin and value, in 64-bit words."""
    bits = mixed(least ^ (np.arange(_BINS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))) & np.uint64(1)
    return np.packbits(bits.astype(bool)).view(np.uint64)


def most_differing(percent: int) -> int:
    """Sketch bits in which a pair at the limit differs at most, but for six standard deviations."""
    share = (1 - percent / 100) / 2
    return int(_BINS * share + 6 * (_BINS * share * (1 - share)) ** 0.5) + 1


def node_of(shingles: np.ndarray) -> bytes:
    """A 128-bit digest of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


_SKETCH = "n bigint, node binary, bands array<bigint>"
_SET = "node binary, shingles array<bigint>"


def _sketch_of(text: Column, words: int) -> Column:
    def make(texts: pa.Array) -> pa.Array:
        sizes, nodes, bands = [], [], []
        for value in texts:
            found = shingle_set(value.as_py() or "", words)
            sizes.append(len(found))
            nodes.append(node_of(found) if len(found) else None)
            bands.append(band_keys(signature(found)).view(np.int64) if len(found) else [])
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["n", "node", "bands"],
        )

    return F.arrow_udf(make, _SKETCH)(text)


def _sets_of(rows: DataFrame, words: int) -> DataFrame:
    """(wanted, node, shingles) of rows (wanted, text), handed on in batches of bounded size."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"wanted": [], "node": [], "shingles": []}
            held = 0
            for wanted, text in zip(batch["wanted"], batch["text"]):
                found = shingle_set(text or "", words)
                out["wanted"].append(wanted)
                out["node"].append(node_of(found))
                out["shingles"].append(found.view(np.int64))
                held += len(found)
                if held >= _TOGETHER:
                    yield out
                    out, held = {n: [] for n in out}, 0
            yield out

    return map_columns(rows.select("wanted", "text"), run, f"wanted binary, {_SET}")


def node_column(text: Column, words: int) -> Column:
    """The digest of a text's shingle set, null without words: equal sets have equal nodes."""
    return _sketch_of(text, words)["node"]


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with their Jaccard distance and whether they are linked, on the full sets."""
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    either = F.size("set_a") + F.size("set_b") - common
    return (
        pairs.join(sets.toDF("b", "set_b"), "b")
        .join(sets.toDF("a", "set_a"), "a")
        .select("a", "b", (1 - common / either).alias("distance"), (100 * common >= percent * either).alias("linked"))
    )


def _open_links(near: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of a star that its centre does not connect.

    Loose members, those without a link to the centre, meet each other and the linked ones in tiles
    of bounded size; a tile emits the links it finds and none of the pairs it looks at.
    """
    looseness = (~F.col("linked")).cast("long")
    crowd = near.groupBy("a").agg(F.sum(looseness).alias("loose"), F.sum(1 - looseness).alias("bound"))
    crowd = crowd.where("loose > 0 AND loose + bound > 1").select(
        F.col("a").alias("centre"),
        F.ceil(F.col("loose") / TILE).cast("int").alias("loose_blocks"),
        F.ceil(F.col("bound") / TILE).cast("int").alias("bound_blocks"),
    )
    block = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("bound_blocks")).otherwise(F.col("loose_blocks")))
    placed = (
        near.select(F.col("a").alias("centre"), F.col("b").alias("node"), "distance", "linked")
        .withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        .join(crowd.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["centre", "salt"])
        .withColumn("block", block.cast("int"))
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    # tile (i, j, false) has the loose blocks i <= j, tile (i, j, true) loose block i and bound block j
    loose, bound = (F.sequence(F.lit(0), F.col(f"{kind}_blocks") - 1) for kind in ("loose", "bound"))
    whole = lambda i, j, b: F.struct(i.alias("i"), j.alias("j"), F.lit(b).alias("b"))
    own = F.col("block")
    to_loose = F.transform(loose, lambda k: whole(F.least(own, k), F.greatest(own, k), False))
    to_bound = F.when(F.col("bound_blocks") > 0, F.transform(bound, lambda k: whole(own, k, True))).otherwise(
        F.array().cast("array<struct<i:int,j:int,b:boolean>>")
    )
    of_bound = F.transform(loose, lambda k: whole(k, own, True))
    tiles = F.when(F.col("linked"), of_bound).otherwise(F.concat(to_loose, to_bound))
    dealt = placed.select("centre", "node", "label", "distance", "linked", "block", F.inline(tiles)).join(sets, "node")
    return dealt.groupBy("centre", "i", "j", "b").applyInPandas(_tile_links(percent), "a binary, b binary")


def _tile_links(percent: int):
    most, reach = most_differing(percent), 1 - percent / 100 + 1e-9

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        first = tile[(tile["block"] == tile["i"]) & ~tile["linked"]].drop_duplicates("node")
        other = tile[(tile["block"] == tile["j"]) & (tile["linked"] == tile["b"])].drop_duplicates("node")
        sets = [[np.asarray(x).view(np.uint64) for x in side["shingles"]] for side in (first, other)]
        bits = [
            np.array([sketch_bits(signature(np.sort(x))) for x in side]).reshape(-1, _BINS // 64) for side in sets
        ]
        n = [np.array([len(x) for x in side], dtype=np.int64) for side in sets]
        distance = [side["distance"].to_numpy() for side in (first, other)]
        nodes, labels = ([side[c].to_numpy() for side in (first, other)] for c in ("node", "label"))
        found: list[tuple[bytes, bytes]] = []
        for k, shingles in enumerate(sets[0]):
            near = (
                (labels[1] != labels[0][k])
                & (np.abs(distance[1] - distance[0][k]) <= reach)
                & (100 * np.minimum(n[1], n[0][k]) >= percent * np.maximum(n[1], n[0][k]))
                & (np.bitwise_count(bits[1] ^ bits[0][k]).sum(axis=1) <= most)
            )
            for m in np.flatnonzero(near):
                common = len(np.intersect1d(shingles, sets[1][m], assume_unique=True))
                if 100 * common >= percent * (n[0][k] + n[1][m] - common):
                    found.append((nodes[0][k], nodes[1][m]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents whose shingle sets overlap by at least ``percent`` of their union.

    Returns ``id_col``, n_shingles, component_id (the smallest id reachable by links, its own included),
    kept (the id is the component's) and node (digest of the set, null without words), a row per row
    of ``docs``. Null and empty texts have no shingles and no links. Rows without an id are linked like
    others and name no component: theirs is null where no row with an id is reached, and then those with
    the least digest of a set are kept. Repeated rows are equal, so all or none of them are kept. The
    chance that a pair at the limit shares no bucket is below 1e-5.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = stored(
        rows.select("id", _sketch_of(F.col("text"), words).alias("made")).select("id", "made.*"), "sketches"
    )
    nodes = stored(
        sketched.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    places = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    crowds = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    shared = stored(places.join(crowds, "bucket"), "buckets")
    weight = shared.groupBy("node").agg(F.sum("crowd").alias("weight"))
    centres = (
        shared.join(weight, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", "node")).alias("top"))
        .select("bucket", F.col("top.node").alias("centre"))
    )
    starred = stored(shared.join(centres, "bucket").select("node", "centre").distinct(), "stars")

    wanted = starred.select("node").distinct().join(nodes.select("node", "id"), "node")
    named = rows.join(wanted.withColumnRenamed("node", "wanted"), "id")
    # the sets that no row with an id has are looked for among the rows without one
    nameless = (
        rows.where("id IS NULL")
        .select("text", _sketch_of(F.col("text"), words)["node"].alias("wanted"))
        .join(wanted.where("id IS NULL").select(F.col("node").alias("wanted")), "wanted", "left_semi")
    )
    sets = stored(
        _sets_of(named.select("wanted", "text").unionByName(nameless), words)
        .where("node = wanted")
        .groupBy("node")
        .agg(F.first("shingles").alias("shingles")),
        "shingles",
    )
    star = starred.where("node <> centre").selectExpr("centre AS a", "node AS b")
    near = stored(_compared(star, sets, percent), "compared")
    links = near.where("linked").select("a", "b")
    labels = stored(connected_components(links), "labels")

    later = _open_links(near, labels, sets, percent)
    groups = connected_components(links.union(later))

    whole = nodes.select("node", "id").join(groups, "node", "left")
    whole = whole.withColumn("label", F.coalesce("label", "node"))
    smallest = whole.groupBy("label").agg(F.min("id").alias("component_id"), F.min("node").alias("least"))
    found = whole.select("node", "label").join(smallest, "label").select("node", "component_id", "least")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    nameless = F.col("id").isNull() & component.isNull() & (F.col("node") != F.col("least"))
    return (
        sketched.drop("bands")
        .join(found, "node", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            (F.col("id").eqNullSafe(component) & ~F.coalesce(nameless, F.lit(False))).alias("kept"),
            "node",
        )
    )
