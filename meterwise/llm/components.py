"""Connected components of an edge table: local contraction, then large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

MAX_ROUNDS = 60


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in memory -> (node, smallest node of its part) for all nodes but the smallest."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # Roots move too, so that parts joined by one edge meet in one step.
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by stars with the same components.

    A task holds 16 bytes for each edge of its partition, and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            u, v = spanning_stars(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def _star(edges: DataFrame) -> DataFrame:
    """Attach to each edge the smallest of ``u`` and its neighbours.

    Edges and minima are read from files, so the join is a plain shuffle join whose large
    partitions (the centre of a big group) adaptive execution splits.
    """
    closest = edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    return edges.join(hand_over(closest, "centres"), "u")


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges, and how many nodes have one."""
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")
        ).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` bigint edges -> ``(node, root)`` with the smallest node that edges reach.

    Only nodes that occur in an edge between two nodes are returned. Loops and repeated edges
    are harmless, an empty table gives an empty table. Every step is written to the shared
    folder; the driver sees three numbers a step. Star steps keep the number of edges, so a
    chain of n nodes needs about log n rounds and a group of n never grows to n squared pairs.

    The steps end when a large-star step changes nothing and every larger end has one edge:
    then no root has a smaller neighbour, and all edges are stars.
    """
    edges = hand_over(contract(edges.where("u <> v")).distinct(), "edges")
    seen = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = hand_over(large.distinct(), "down")  # u is the larger end
        now = _state(down)
        if now == seen and now[0] == now[2]:
            break
        near = _star(down)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            near.select("u", F.col("m").alias("v"))
        )
        edges = hand_over(small.where("u <> v").distinct(), "edges")
        seen = _state(edges)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(members.select(F.col("root").alias("node"), "root").distinct())
