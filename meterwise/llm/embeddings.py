"""Embedding near-duplicates: int8 tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm.components import connected_components
from meterwise.llm.storage import hand_over

THRESHOLD = 0.93
TILE = 2048
_GROUP = ["label", "dim", "low", "high"]
_RESULT = ["u", "v", "links", *_GROUP, "second"]
_STRIP = 256
#: Allowance for rounding in the double-precision bound itself.
_SLACK = 1e-9


class Codes:
    """Unit vectors as int8 codes, each with a scale, an error norm and a length.

    ``unit = scale * code + error`` holds exactly, so for two vectors the true cosine differs
    from ``scale_a * scale_b * (code_a . code_b)`` by at most
    ``|error_a| + |scale_a * code_a| * |error_b|``. Both norms are rounded up.
    """

    def __init__(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, length: np.ndarray):
        self.codes = codes
        self.scale, self.error, self.length = (x.astype(np.float64) for x in (scale, error, length))
        # Products of codes are whole numbers; floats of this width hold their sums exactly.
        wide = np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.factors = codes.astype(wide)

    def __len__(self) -> int:
        return len(self.codes)

    def packed(self) -> list[bytes]:
        """One byte a component and three 4-byte numbers for each vector."""
        numbers = np.stack([self.scale, self.error, self.length], axis=1).astype("<f4")
        return [c.tobytes() + x.tobytes() for c, x in zip(self.codes, numbers)]

    @classmethod
    def unpacked(cls, rows: list[bytes]) -> Codes:
        data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        numbers = np.ascontiguousarray(data[:, -12:]).view("<f4")
        return cls(np.ascontiguousarray(data[:, :-12]).view(np.int8), *numbers.T)


class Quantised(Codes):
    """Codes of vectors together with the vectors and their norms."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.norms = vectors, norms(vectors)
        unit = vectors / self.norms[:, None]
        scale = (np.abs(unit).max(axis=1) / 127.0).astype(np.float32)
        codes = np.clip(np.rint(unit / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
        coded = codes * scale[:, None].astype(np.float64)
        error, length = np.sqrt(((unit - coded) ** 2).sum(axis=1)), np.sqrt((coded**2).sum(axis=1))
        super().__init__(codes, scale, _upper(error), _upper(length))


def norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms; dividing by the largest component first keeps squares in range."""
    largest = np.abs(vectors).max(axis=1)
    return largest * np.sqrt(((vectors / largest[:, None]) ** 2).sum(axis=1))


def _upper(values: np.ndarray) -> np.ndarray:
    """A 4-byte number that is not smaller."""
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))


def settle_by_codes(a: Codes, b: Codes, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For ``a``'s ``rows`` and all of ``b``: which pairs surely link, and which are undecided."""
    near = (a.factors[rows] @ b.factors.T).astype(np.float64)
    near *= a.scale[rows, None] * b.scale[None, :]
    bound = a.error[rows, None] + a.length[rows, None] * b.error[None, :] + _SLACK
    sure = near - bound >= threshold
    return sure, ~sure & (near + bound >= threshold)


def settle_by_vectors(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: slice,
                      undecided: np.ndarray, threshold: float) -> np.ndarray:
    """Which undecided pairs link, from the original (vectors, norms) of both sides."""
    hits = np.zeros_like(undecided)
    i, j = np.nonzero(undecided)
    for at in range(0, len(i), 1 << 14):
        p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        k = p + (rows.start or 0)
        exact = np.einsum("nd,nd->n", a[0][k], b[0][q]) / (a[1][k] * b[1][q])
        hits[p, q] = exact >= threshold
    return hits


def linked(a: Quantised, b: Quantised, rows: slice, threshold: float) -> np.ndarray:
    """Which of ``a``'s ``rows`` and all of ``b`` have a cosine of at least ``threshold``.

    Pairs whose bound lies above or below the threshold are settled by the int8 product; the
    others are computed again from the original components.
    """
    sure, undecided = settle_by_codes(a, b, rows, threshold)
    sides = (a.vectors, a.norms), (b.vectors, b.norms)
    return sure | settle_by_vectors(*sides, rows, undecided, threshold)


class Forest:
    """Keeps the links of a tile that join parts not joined before: fewer than its vectors."""

    def __init__(self, size: int):
        self.part = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def add(self, node: int, others: np.ndarray) -> None:
        parts, first = np.unique(self.part[others], return_index=True)
        fresh = parts != self.part[node]
        if fresh.any():
            self.links += [(node, int(others[k])) for k in first[fresh]]
            self.part[np.isin(self.part, parts)] = self.part[node]


def compare(codes: Codes, weight: np.ndarray, cut: int, threshold: float,
            vectors: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Weighted numbers of links, links that span their graph, and who has undecided pairs.

    The first ``cut`` members are compared with the others, or all with each other if ``cut``
    takes in all. Without ``vectors`` the pairs that the codes settle are counted, with them
    the undecided ones.
    """
    same = cut == len(codes)
    first = slice(0, cut)
    a = Codes(*(x[first] for x in (codes.codes, codes.scale, codes.error, codes.length)))
    b = a if same else Codes(*(x[cut:] for x in (codes.codes, codes.scale, codes.error, codes.length)))
    shift = 0 if same else cut
    if vectors is not None:
        lengths = norms(vectors)
        sides = (vectors[:cut], lengths[:cut]), (vectors[shift:], lengths[shift:])
    counts = np.zeros(len(codes), np.int64)
    unsettled = np.zeros(len(codes), bool)
    forest = Forest(len(codes))
    for at in range(0, cut, _STRIP):
        rows = slice(at, min(at + _STRIP, cut))
        hits, undecided = settle_by_codes(a, b, rows, threshold)
        if same:
            own = np.arange(len(hits)), at + np.arange(len(hits))
            hits[own] = undecided[own] = False
        if vectors is not None:
            hits = settle_by_vectors(*sides, rows, undecided, threshold)
        unsettled[rows] |= undecided.any(axis=1)
        unsettled[shift:] |= undecided.any(axis=0)
        for i in np.flatnonzero(hits.any(axis=1)):
            others = np.flatnonzero(hits[i])
            counts[at + i] += weight[shift:][others].sum()
            forest.add(at + i, others + shift)
        if not same:
            counts[shift:] += weight[rows] @ hits
    return counts, forest.links, unsettled


def _usable(vector: Column) -> Column:
    """Not null, every component finite, and not the zero vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@F.pandas_udf(T.BinaryType())
def _quantise(vectors: pd.Series) -> pd.Series:
    """Packed codes of usable vectors of any dimensions."""
    out = pd.Series([None] * len(vectors), dtype=object)
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        data = np.stack(vectors.iloc[at].to_numpy()).astype(np.float64)
        for k, code in zip(at, Quantised(data).packed()):
            out.iat[k] = code
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD,
                    tile: int = TILE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per input row.

    Vectors are compared when their labels are equal and not null and their dimensions agree.
    Two link if their cosine in double precision is at least ``threshold``; a component's id is
    the smallest id that links reach, and the row that has it is kept.

    A vector that is null, empty, zero or has a null or non-finite component, a vector without a
    label, and a row without an id link with nothing: no links, their own id as component
    (null, and not kept, without an id). Repeated rows are vectors of their own: they link with
    each other and are counted each. Other columns are not read. Empty tables give empty ones.

    Equal vectors of a label are merged first and weigh as many as they are. The rest is
    quantised once and dealt to tiles by hash; every pair of tiles of a label is one group of at
    most about twice ``tile`` rows, whatever the size of the label. Groups hold the int8 codes
    with their bounds; original components are fetched by key only for the vectors that a group
    cannot settle against another one. A group returns counts per vector and the links of a
    spanning forest, never its pairs.
    """
    rows = vectors.select(
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).alias("vector"),
    ).withColumn("ok", _usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    keyed = rows.select(
        "id", "label", "vector", "ok",
        F.xxhash64("label", "vector").alias("h"), F.hash("label", "vector").alias("g"),
    )
    live = keyed.where("ok")
    merged = live.groupBy("label", "vector", "h", "g").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    # Written once, so that the node numbers stay.
    merged = hand_over(
        merged.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}), "vectors"
    )
    tiles = hand_over(
        merged.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "tiles"
    )
    coded = hand_over(merged.select("label", "dim", "g", "node", "n", _quantise("vector").alias("code")), "codes")
    placed = coded.join(tiles, ["label", "dim"]).withColumn("own", F.pmod("g", "tiles"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        *_GROUP[:2], F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).alias("second"), "node", "n", "code",
    )

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["second", "node"], ignore_index=True)
        cut = int((~group["second"]).sum())
        if not cut or (cut == len(group) and group["low"].iat[0] != group["high"].iat[0]):
            return group.iloc[:0].reindex(columns=_RESULT)  # one of the two tiles is empty
        vectors = None
        if "vector" in group:
            vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
        counts, links, unsettled = compare(
            Codes.unpacked(group["code"].tolist()), group["n"].to_numpy(np.int64), cut, threshold, vectors
        )
        if vectors is not None:
            unsettled[:] = False
        node, at, again = group["node"].to_numpy(), np.flatnonzero(counts), np.flatnonzero(unsettled)
        left = np.concatenate([at, [a for a, _ in links], again]).astype(np.int64)
        right = np.concatenate([at, [b for _, b in links], again]).astype(np.int64)
        kinds = [counts[at], np.zeros(len(links), np.int64), np.full(len(again), -1)]
        out = pd.DataFrame({"u": node[left], "v": node[right], "links": np.concatenate(kinds)})
        for name in _GROUP:
            out[name] = group[name].iat[0]
        return out.assign(second=group["second"].to_numpy()[left])[_RESULT]

    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("u", "v", "links")]
        + [T.StructField(c, dealt.schema[c].dataType) for c in [*_GROUP, "second"]]
    )
    by_codes = hand_over(dealt.groupBy(*_GROUP).applyInPandas(work, schema), "by-codes")
    again = by_codes.where("links = -1").select(*_GROUP, "second", F.col("u").alias("node"))
    full = hand_over(
        again.join(coded.select("node", "n", "code"), "node").join(merged.select("node", "vector"), "node"),
        "unsettled",
    )
    by_vectors = full.groupBy(*_GROUP).applyInPandas(work, schema)
    found = hand_over(by_codes.where("links >= 0").union(by_vectors).select("u", "v", "links"), "links")
    counts = found.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0"))
    known = merged.select("h", "g", "first_id", "n", "node").join(counts, "node", "left").join(roots, "node", "left")
    known = hand_over(known.withColumn("root", F.coalesce("root", "node")), "known")
    first = hand_over(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "first")
    known = hand_over(
        known.join(first, "root").select(
            "h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
        ),
        "named",
    )
    joined = live.select("id", "h", "g").join(known, ["h", "g"]).select("id", "n_links", "component_id")
    alone = keyed.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
