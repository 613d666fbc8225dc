"""Connected components of an edge table by alternating stars, as DataFrame joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.exchange import checkpointed, release


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect the same nodes as the edges (a, b) of one task: fewer edges than nodes, each from the least node."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        for end in (root[x], root[y]):
            np.minimum.at(root, end, low)
        while (root[root] != root).any():
            root = root[root]
    child = root != np.arange(len(nodes))
    return nodes[root[child]], nodes[child]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for every node of edges (a, b); loops are allowed.

    Each round links every neighbour of a node that is larger than it to the node's least neighbour (large star), then
    every smaller neighbour likewise (small star); it ends when all edges point at roots. Rounds are checkpointed.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for k in range(max_rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = large.union(e.where("a = b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = checkpointed(new.distinct())
        if not k:
            release(e)  # what made the edges is large, rounds are not
        # done when no node has two parents and no parent has another parent
        parents = e.where("a != b")
        many = parents.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        if parents.select(F.col("b").alias("a")).join(parents.select("a"), "a", "left_semi").isEmpty() and many.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.where("a != b")
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
