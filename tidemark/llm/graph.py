"""Connected components of a table of links, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours;
the links converge to a star around the smallest node of each component, in about log(n) rounds. Rounds are
joins and partial aggregates over links; each is written to the shared folder, and the driver
sees two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import durable, release


def _stars(pairs: DataFrame) -> DataFrame:
    """For directed pairs (u, v): v and u hang on the smallest of u and its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each node that has an edge.

    Nulls and loops are left out; an empty table gives an empty result.
    """
    e = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(_stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        release(e)
        small = _stars(large)
        e = durable(small.select("v", "m").toDF("u", "v").unionByName(small.select("u", "m").toDF("u", "v")).where("u != v").distinct())
        release(large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(a, b)`` with the components of the links ``(i, j)`` of nodes 0 to n - 1: each node to the smallest of its own.

    Labels sink along all links at once and jump to their labels' labels: no Python loop over links.
    """
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    a = np.flatnonzero(label != np.arange(n))
    return a, label[a]


class Forest:
    """Union-find over integers inside one task; says which links join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y
