"""Connected components of an edge list, as rounds of joins, and of the edges inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node reachable) of every node of ``a``-``b`` edges.

    Each round a node takes the least label among its neighbours and itself, and then the label of that label,
    so chains halve. Labels are written to the shared folder each round; the driver sees only whether any changed.
    """
    with Scratch(edges.sparkSession, "components") as scratch:
        both = scratch.stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
        labels = scratch.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
        while True:
            heard = both.join(labels.withColumnsRenamed({"node": "b", "label": "heard"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
            near = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("next"))
            roots = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
            moved = near.join(roots, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("old"))
            moved = scratch.stored(moved, "labels")
            labels = moved.select("node", "label")
            if moved.where("label <> old").isEmpty():
                return stored(labels, "labels")


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ``n`` nodes and edges between them, the least node that each can reach."""
    root = np.arange(n)
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return root
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (far := root[root]).tobytes() != root.tobytes():
            root = far
