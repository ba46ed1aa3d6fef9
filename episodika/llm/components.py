"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from episodika.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge (a, b) the smallest node that it is connected with; nodes are not null.

    Each round every node hangs its larger neighbours, then its smaller ones, on the smallest: minima combined inside the
    tasks and joined back, so a node with very many edges is no single group. Rounds grow with the logarithm of the
    longest chain; edges are written to the shared folder between them.
    """
    star = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct())
    state = _state(star)
    while state[0]:
        both = star.unionByName(star.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        lowest = both.groupBy("child").agg(F.least("child", F.min("parent")).alias("low"))
        # large star: a node's larger neighbours move to its smallest one
        large = both.where("parent > child").join(lowest, "child").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        large = large.where("child <> parent").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("child").agg(F.min("parent").alias("low"))
        small = large.join(low, "child").select(F.explode(F.array("child", "parent")).alias("child"), F.col("low").alias("parent"))
        star = cut_lineage(small.where("child <> parent").distinct())
        before, state = state, _state(star)
        if state == before:
            break
    roots = star.select("parent").distinct().select(F.col("parent").alias("node"), F.col("parent").alias("root"))
    return star.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(roots)


def _state(star: DataFrame) -> tuple:
    row = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("child", "parent"))).first()
    return tuple(row)
