"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a few joins and aggregates over the edges (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014); no component is ever gathered in one task.
The minima are cut to the checkpoint folder before the join that uses them, so that both
sides of this join are plain exchanges and adaptive execution can split the partition
that holds a hot node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each item's smallest known companion, a root maps to itself) after uniting ``a[i]`` with ``b[i]``."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _forest(batches):
    """The edges of a partition with those left out that join what the batch joins already."""
    for pdf in batches:
        if not len(pdf):
            continue
        nodes, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        n = len(pdf)
        label = join_labels(np.arange(len(nodes)), ends[:n], ends[n:])
        own = np.flatnonzero(label != np.arange(len(nodes)))
        pdf = pdf.iloc[: len(own)].copy()
        pdf["a"], pdf["b"] = nodes[own], nodes[label[own]]
        yield pdf


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)`` (longs); root is the smallest node reachable.

    Rows with a null end are ignored, as are loops and repeated edges; nodes without an
    edge to another node aren't listed. An empty edge list gives an empty result.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = cut(edges.mapInPandas(_forest, "a long, b long"))
    state = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m").distinct())
        down = large.select("u", F.col("m").alias("v"))
        least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        edges = cut(down.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
