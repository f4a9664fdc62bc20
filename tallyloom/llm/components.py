"""Connected components of an edge table by alternating star steps; no step gathers a node's neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of each a[i] and b[i] in place; ``root`` maps every index to the smallest index of its set."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least, "a")
    down = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Self loops and repeated edges do not matter; a node with self loops only is its own root.  Each round is written to the
    shared folder; minima are aggregated before they are joined, so a node with very many neighbours is one row per task.
    """
    real = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = common.stored(real, "edges"), None
    while True:
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            break
        seen = sign
        now = common.stored(_small_star(_large_star(now)), "edges")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("root").alias("root"))
