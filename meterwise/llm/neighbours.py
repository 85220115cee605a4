"""Nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

SEED = 11
#: Projections, and half the width of a window in units of the radius.
PROJECTIONS = 48
HALF_WIDTH = 1.5
#: Chance that a vector at the radius itself stays below the collision threshold.
MISS = 0.02
#: Vectors of an index block, queries of a query block.
BLOCK = 2048
QUERIES = 512
#: Every stage of the search reads so many times the blocks of the stage before it.
GROWTH = 8
#: Query blocks meet an index block in so many groups, should Spark shuffle them.
_SALTS = 32
#: First window of a block as a part of the radius, where one is known.
_FIRST = 0.25


def threshold(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """Largest number of collisions that a vector at the radius misses with chance ``miss`` at most.

    A projection on a normal vector turns a distance d into a normal difference of deviation d,
    so a vector at the radius collides with chance P(|z| <= half_width), a nearer one more often.
    """
    p = math.erf(half_width / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


def projection(dim: int) -> np.ndarray:
    """The seeded normal vectors of a dimension, one in each column."""
    return np.random.default_rng(SEED).normal(size=(dim, PROJECTIONS))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; equal vectors get equal ones."""
    return np.sqrt(np.square(np.ascontiguousarray(vectors) - query).sum(axis=1))


class Block:
    """Vectors with a sorted array of (projected value, place) for every projection."""

    def __init__(self, ids: np.ndarray, nodes: np.ndarray, vectors: np.ndarray,
                 values: np.ndarray, places: np.ndarray):
        self.ids, self.nodes, self.vectors = ids, nodes, vectors
        self.values, self.places = values, places

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of every query's window in every sorted array."""
        low = [np.searchsorted(v, centres[:, i] - half, "left") for i, v in enumerate(self.values)]
        high = [np.searchsorted(v, centres[:, i] + half, "right") for i, v in enumerate(self.values)]
        return np.stack(low, axis=1), np.stack(high, axis=1)

    def search(self, nodes: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int,
               least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ``k`` nearest vectors found within each query's bound: (query, places, distances).

        The radius grows from a small one; each step adds to a query's collisions only the two
        ends by which its windows grew, and verifies the vectors that reach ``least``. A query
        is done when ``k`` verified vectors lie within the radius, or the radius is its bound.
        """
        size, count = len(self.nodes), len(nodes)
        centres = vectors @ projection(self.vectors.shape[1])
        ends = np.stack([self.values[:, 0], self.values[:, -1]])
        # Beyond this radius every window holds the whole block.
        whole = np.abs(centres[None] - ends[:, None]).max(axis=(0, 2)) / HALF_WIDTH * (1 + 1e-9) + 1e-300
        last = np.minimum(bounds, whole)
        spread = (ends[1] - ends[0]).max() / HALF_WIDTH / 64
        radius = np.where(np.isfinite(bounds), last * _FIRST, np.minimum(last, max(spread, 1e-300)))
        seen = np.zeros((count, size), np.uint16)
        low = np.zeros((count, len(self.values)), np.int64)
        high = low.copy()
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0)] for _ in range(count)]
        live = np.arange(count)
        while len(live):
            at_low, at_high = self.windows(centres[live], HALF_WIDTH * radius[live])
            done = np.zeros(len(live), bool)
            for r, q in enumerate(live):
                fresh = []
                for i, places in enumerate(self.places):
                    if low[q, i] == high[q, i]:
                        fresh.append(places[at_low[r, i] : at_high[r, i]])
                    else:
                        fresh.append(places[at_low[r, i] : low[q, i]])
                        fresh.append(places[high[q, i] : at_high[r, i]])
                before = seen[q] >= least
                seen[q] += np.bincount(np.concatenate(fresh), minlength=size).astype(np.uint16)
                new = np.flatnonzero((seen[q] >= least) & ~before)
                new = new[self.nodes[new] != nodes[q]]
                if len(new):
                    gap = distances(self.vectors[new], vectors[q])
                    best = np.concatenate([found[q][0], new]), np.concatenate([found[q][1], gap])
                    first = np.lexsort((self.ids[best[0]], best[1]))[:k]
                    found[q] = [best[0][first], best[1][first]]
                enough = len(found[q][1]) == k and found[q][1][-1] <= radius[q]
                done[r] = enough or radius[q] >= last[q]
            low[live], high[live] = at_low, at_high
            live = live[~done]
            radius[live] = np.minimum(radius[live] * 2, last[live])
        for q, (places, gaps) in enumerate(found):
            inside = gaps <= bounds[q]
            if inside.any():
                yield q, places[inside], gaps[inside]


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """The index row of a block."""
    group = group.sort_values("node", ignore_index=True)
    vectors = np.stack(group["vector"].to_numpy())
    projected = vectors @ projection(vectors.shape[1])
    places = np.argsort(projected, axis=0, kind="stable")
    values = np.take_along_axis(projected, places, axis=0)
    return pd.DataFrame(
        {
            "dim": [vectors.shape[1]], "block": [group["block"].iat[0]],
            "ids": [group["id"].to_numpy(np.int64).tobytes()],
            "nodes": [group["node"].to_numpy(np.int64).tobytes()],
            "vectors": [vectors.tobytes()],
            "values": [np.ascontiguousarray(values.T).tobytes()],
            "places": [np.ascontiguousarray(places.T).astype(np.int32).tobytes()],
        }
    )


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """One row for a block of queries."""
    group = group.sort_values("node", ignore_index=True)
    vectors = np.stack(group["vector"].to_numpy())
    return pd.DataFrame(
        {
            "dim": [vectors.shape[1]], "part": [group["part"].iat[0]],
            "q_nodes": [group["node"].to_numpy(np.int64).tobytes()],
            "q_vectors": [vectors.tobytes()],
            "q_bounds": [group["bound"].to_numpy(float).tobytes()],
        }
    )


def _searcher(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                numbers = lambda c, t=np.int64: np.frombuffer(row[c], t)
                nodes = numbers("nodes")
                block = Block(
                    numbers("ids"), nodes, numbers("vectors", float).reshape(-1, dim),
                    numbers("values", float).reshape(-1, len(nodes)),
                    numbers("places", np.int32).reshape(-1, len(nodes)),
                )
                queries = numbers("q_nodes")
                hits = list(
                    block.search(queries, numbers("q_vectors", float).reshape(-1, dim),
                                 numbers("q_bounds", float), k, least)
                )
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([np.full(len(p), queries[q]) for q, p, _ in hits])),
                            pa.array(np.concatenate([block.ids[p] for _, p, _ in hits])),
                            pa.array(np.concatenate([block.nodes[p] for _, p, _ in hits])),
                            pa.array(np.concatenate([g for _, _, g in hits])),
                        ],
                        ["query", "id", "other", "distance"],
                    )

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` nearest rows found for each query row.

    ``score`` is the Euclidean distance in double precision; equal scores are ranked by id. A
    query's candidates are all rows but itself, so rows equal to it are found at 0. Rows whose
    vector is null, empty, zero or has a null or non-finite component, and rows without an id,
    take no part; vectors of different dimensions do not meet. With fewer than ``k`` candidates
    all are returned. Repeated rows are rows of their own. Other columns are not read, an empty
    table gives an empty one. Components above 1e150 overflow a squared distance.

    Every row is indexed: rows are dealt to blocks by hash, and each block keeps one sorted array
    per projection. A query's windows in them grow with its radius; vectors in enough windows
    are verified. A vector at the radius stays unverified with chance ``miss`` at most, a nearer
    one less often, and the search of a block ends only when ``k`` verified vectors lie within
    the radius or the radius reaches the k-th distance known so far. Blocks are searched in
    stages of growing size: each stage starts from the k-th distances of those before, so all
    but the first verify few vectors, and a block returns at most ``k`` rows a query. Nothing
    but the numbers of blocks reaches the driver.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    # Written once, so that the node numbers stay.
    rows = hand_over(
        rows.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}), "rows"
    )
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int")
    count = hand_over(rows.groupBy("dim").agg(blocks(block).alias("blocks")), "blocks")
    asked = rows.where("asks")
    parts = hand_over(asked.groupBy("dim").agg(blocks(QUERIES).alias("parts")), "parts")
    dealt = rows.select("id", "node", "dim", "vector").join(count, "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    index = hand_over(
        dealt.groupBy("dim", "block").applyInPandas(
            _build,
            "dim int, block int, ids binary, nodes binary, vectors binary, values binary, places binary",
        ),
        "index",
    )
    asked = hand_over(
        asked.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .select("id", "node", "dim", "vector", "part"),
        "queries",
    )
    least = threshold(miss=miss)
    total = count.agg(F.max("blocks")).first()[0] or 0
    best = None
    start, width = 0, 1
    order = Window.partitionBy("query").orderBy("distance", "id", "other")
    while start < total or best is None:
        bound = F.lit(None).cast("double")
        known = asked.withColumn("bound", bound)
        if best is not None:
            full = best.where(F.col("rank") == k).select(F.col("query").alias("node"), F.col("distance").alias("bound"))
            known = asked.join(full, "node", "left")
        known = known.fillna(float("inf"), ["bound"])
        packed = hand_over(
            known.groupBy("dim", "part").applyInPandas(
                _pack, "dim int, part int, q_nodes binary, q_vectors binary, q_bounds binary"
            ),
            "packed",
        )
        salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        share = index.where((F.col("block") >= start) & (F.col("block") < start + width))
        share = share.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        share = share.drop("parts").withColumn("salt", F.pmod("block", F.lit(_SALTS)))
        found = share.join(salted, ["dim", "part", "salt"]).mapInArrow(
            _searcher(k, least), "query bigint, id bigint, other bigint, distance double"
        )
        if best is not None:
            found = found.union(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = hand_over(ranked, "best")
        start, width = start + width, width * GROWTH
    name = asked.select(F.col("node").alias("query"), F.col("id").alias("query_id"))
    return best.join(name, "query").select(
        "query_id", "rank", F.col("id").alias(id_col), F.col("distance").alias("score")
    )
