"""Connected components of a graph given by its edges, without gathering a component anywhere.

Alternating large-star and small-star rounds: every node is linked to the smallest node it sees. A round is
a map-side combined minimum by node and a join of that with the edges, which adaptive execution splits
where one node has very many. Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Workspace


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.selectExpr("b AS a", "a AS b"))


def _large_star(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Every node's larger neighbours go to the smallest node it sees.

    The minima are written before the join: with an aggregate below it, a join can't be split at a hub.
    """
    least = _both(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = space.save(least, f"{name}-least")
    return _both(edges).where("b > a").join(least, "a").selectExpr("m AS a", "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Edges are (smaller a, larger b): b's smaller neighbours and b itself go to the smallest of them."""
    least = space.save(edges.groupBy("b").agg(F.min("a").alias("m")), f"{name}-least")
    moved = edges.join(least, "b").selectExpr("m AS a", "a AS b").where("a <> b")
    return moved.unionByName(least.selectExpr("m AS a", "b")).distinct()


def connected_components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge."""
    now = space.save(edges.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").where("a <> b").distinct(), f"{name}-0")
    sign = lambda df: df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    seen, k = sign(now), 0
    while seen[0]:
        k += 1
        large = space.save(_large_star(now, space, f"{name}-large-{k}"), f"{name}-large-{k}")
        after = space.save(_small_star(large, space, f"{name}-small-{k}"), f"{name}-{k}")
        for old in (f"{name}-{k - 1}", f"{name}-large-{k}", f"{name}-large-{k}-least", f"{name}-small-{k}-least"):
            space.drop(old)
        now, before = after, seen
        seen = sign(now)
        if seen == before:
            break
    return now.selectExpr("b AS node", "a AS root").unionByName(now.selectExpr("a AS node", "a AS root").distinct())


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as join the same nodes: each to the smallest of its component here."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        was = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, was):
            break
    kept = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[kept]], nodes[kept]
