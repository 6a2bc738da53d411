"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): equal labels mean connected.

    Each round maps every node to the smallest of itself and its neighbours, and the edges along with
    it, until no edge is left; the maps are then applied one after the other. Nodes are to be digests
    or other values in no meaningful order, so that a round removes a share of them and chains take a
    logarithmic number of rounds; a star takes one. Null ends and loops are ignored. Every round is
    written to the shared folder.
    """
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(least, most).distinct(), "edges"
    )
    maps: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select("a", "b").union(left.select("b", "a")).toDF("node", "other")
        nearest = ends.groupBy("node").agg(F.min("other").alias("other"))
        step = stored(nearest.select("node", F.least("node", "other").alias("label")), "labels")
        maps.append(step)
        left = stored(
            left.join(step.toDF("a", "to_a"), "a")
            .join(step.toDF("b", "to_b"), "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct(),
            "edges",
        )
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = maps[0]
    for step in maps[1:]:
        found = found.join(step.toDF("label", "next"), "label", "left").select(
            "node", F.coalesce("next", "label").alias("label")
        )
    return found
