"""Connected components of a link table, by alternating large and small stars.

Links, labels and members stay in Spark; each round is cut off with a
checkpoint in the shared folder.  Rounds grow with the logarithm of the longest
chain, not with a component's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesieve.llm.common import checkpointed


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _least(links: DataFrame) -> DataFrame:
    """(a, m): the smallest b of each a.  Grouped by more than a, so that a join by a deals its other side anew and may split a hot hub."""
    return links.groupBy("a", F.xxhash64("a").alias("_fs_h")).agg(F.min("b").alias("m")).select("a", "m")


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (a, b) with b the smallest member of a's component, for each a that isn't itself smallest.

    An empty table gives an empty one; links of a node with itself, repeated
    links and null ends are ignored.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = _signature(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours of a node move to its smallest one.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself move to the smallest.
        first = _least(large)
        moved = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(moved.union(first.select("a", F.col("m").alias("b"))).distinct())
        new = _signature(now)
        if new == seen:
            return now
        seen = new


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes, from links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
