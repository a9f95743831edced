"""Connected components of a large edge list, as alternating star contractions.

Edges never meet in one task or on the driver: each round is a minimum per node
(pre-aggregated before its shuffle) and an equi-join that adaptive execution can
split for a hot node.  Every round is written to the shared folder, so its
lineage is short and the next join starts from plain files.  First, each task
runs a union-find over its own edges and keeps only a spanning star.  Once at most
``ONE_TASK`` edges (a counted bound, some 8 MB) are left, a single union-find ends
the work; more go through further rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.llm.common import staged


ONE_TASK = 500_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: (nodes, smallest node of each one's set)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _spanning(batches):
    parts = [(p["u"].to_numpy(), p["v"].to_numpy()) for p in batches]
    if parts:
        nodes, root = roots_of(*(np.concatenate(x) for x in zip(*parts)))
        keep = nodes != root
        yield pd.DataFrame({"u": nodes[keep], "v": root[keep]})


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node reachable."""
    edges = staged(links.filter("u <> v").mapInPandas(_spanning, "u long, v long").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000000007)).first()
        if now[0] <= ONE_TASK and now != before:
            edges = staged(edges.coalesce(1).mapInPandas(_spanning, "u long, v long"), "edges")
        elif now != before:
            edges, before = staged(_contract(edges), "edges"), now
            continue
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
            edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _contract(edges: DataFrame) -> DataFrame:
    # large star: a node's larger neighbours move to its smallest neighbour
    both = edges.union(edges.select("v", "u"))
    low = staged(_lowest(both).select("n", F.least("n", "m").alias("m")), "low")
    wide = both.filter("v > u").join(low, F.col("u") == F.col("n")).select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    wide = staged(wide, "edges")
    # small star: a node and its smaller neighbours move to the smallest of them
    low = staged(_lowest(wide), "low")
    moved = wide.join(low, F.col("u") == F.col("n")).filter("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("n", "m")).distinct()
