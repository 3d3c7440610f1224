"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.locators import join_counted
from isoreach.llm.storage import written


def _large_star(edges: DataFrame, many: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = least.select("a", F.least("a", "m").alias("m"), "n")
    moved = join_counted(both.filter(F.col("b") > F.col("a")), least, "a", "n", 2 * many)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, many: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges run from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, "a", "n", many).filter(F.col("b") != F.col("m"))
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; ``edges`` has two columns of one integer type.

    ``component`` is the smallest node that can be reached. Loops and edges with a null end count for
    nothing, repeated edges once. A round costs two joins and is stored in the shared folder; the
    number of rounds grows with the logarithm of the longest path. The edges of a node with more than a task's
    share of them are dealt to several tasks. Nodes without an edge are not returned.
    """
    first, second = edges.columns
    pairs = edges.select(F.col(first).alias("x"), F.col(second).alias("y")).filter(F.col("x") != F.col("y"))
    now = written(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Both sums wrap around alike whatever the order of the rows.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        # Of the first step's edges there are no more than of the given ones.
        now = written(_small_star(_large_star(now, state[0]), state[0]), "edges")


def local_forest(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) for links between positions ``a`` and ``b``.

    Keeps a task from sending every link of a dense group: at most one edge per node leaves it.
    """
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    x, y, label = rank[a], rank[b], np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[order[own]], nodes[order[label[own]]]
