"""Sharding by histogram sort: refine splitters by exact counts, then exchange once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

SHARDS = 24
TOLERANCE = 0.002
PROBES = 64
OVERHEAD = 8
#: Equal texts are split only where they hold more than this part of a shard.
GROUP_SHARE = 0.05
_LOW, _HIGH = -(1 << 63), 1 << 63
_CELL_ROWS = 1024
_CELL_BITS = 12
_SUB_BITS = 4


@dataclass
class _Search:
    """One splitter: the boundary wanted lies in [low, high]; the bytes and rows below both."""

    target: float
    low: int
    high: int
    low_bytes: int
    high_bytes: int
    low_rows: int
    high_rows: int

    def best(self) -> tuple[int, float]:
        """The nearer end, the lower one if both are as near, and how far it is off."""
        below, above = self.target - self.low_bytes, self.high_bytes - self.target
        return (self.low, below) if below <= above else (self.high, above)

    def done(self, slack: float) -> bool:
        return (
            self.best()[1] <= slack
            or self.high - self.low <= 1
            or self.high_rows - self.low_rows <= 1
        )


def _below(keys: DataFrame, column: str, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe; one pass, one small row set per task."""
    shared = keys.sparkSession.sparkContext.broadcast(np.array(probes, np.int64))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        size = np.zeros(len(bounds) + 1, np.int64)
        rows = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            key, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.searchsorted(bounds, key, "right")
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(starts):
                slots = at[order][starts]
                size[slots] += np.add.reduceat(own[order], starts)
                rows[slots] += np.diff(np.append(starts, len(order)))
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(size[at]), pa.array(rows[at])], ["at", "size", "n"]
        )

    got = (
        keys.select(column, "size")
        .mapInArrow(tally, "at bigint, size bigint, n bigint")
        .groupBy("at")
        .agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        .collect()
    )  # at most one row per probe, plus one
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in got:
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _refine(keys: DataFrame, column: str, searches: list[_Search], slack: float) -> None:
    """Probe all open intervals at once until each splitter is within ``slack`` or exact."""
    while open_ := [s for s in searches if not s.done(slack)]:
        probes: set[int] = set()
        for s in open_:
            step = (s.high - s.low) / (PROBES + 1)
            inner = {s.low + int(step * (k + 1)) for k in range(PROBES)} if step > 1 else set(range(s.low + 1, s.high))
            probes |= {p for p in inner if s.low < p < s.high} or {(s.low + s.high) // 2}
        ordered = sorted(probes)
        size, rows = (x.tolist() for x in _below(keys, column, ordered))
        for s in open_:
            for p, b, n in zip(ordered, size, rows):
                if s.low < p < s.high:
                    if b <= s.target:
                        s.low, s.low_bytes, s.low_rows = p, b, n
                    else:
                        s.high, s.high_bytes, s.high_rows = p, b, n
                        break


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries (hi, lo); shard k begins at boundary k.

    ``keys`` has hi, lo and size. Boundaries are first sought between different values of hi;
    where the rows of one value straddle a target by more than the tolerance, the nearer end of
    the value is taken, unless they hold more than ``GROUP_SHARE`` of a shard: then lo decides.
    """
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slack = tolerance * total / shards
    searches = [
        _Search(total * k / shards, _LOW, _HIGH, 0, total, 0, rows) for k in range(1, shards)
    ]
    _refine(keys, "hi", searches, slack)
    bounds: list[tuple[int, int]] = []
    inside: dict[int, list[tuple[int, _Search]]] = {}
    for k, s in enumerate(searches):
        at, off = s.best()
        bounds.append((at, _LOW))
        large = s.high_bytes - s.low_bytes > GROUP_SHARE * total / shards
        if off > slack and large and s.high - s.low <= 1 and s.high_rows - s.low_rows > 1:
            inside.setdefault(s.low, []).append((k, s))
    for value, straddled in inside.items():  # fewer than the shards
        group = keys.where(F.col("hi") == F.lit(value))
        inner = [
            _Search(s.target - s.low_bytes, _LOW, _HIGH, 0, s.high_bytes - s.low_bytes, 0, s.high_rows - s.low_rows)
            for _, s in straddled
        ]
        _refine(group, "lo", inner, slack)
        for (k, _), s in zip(straddled, inner):
            at = s.best()[0]
            bounds[k] = (value, at) if at < _HIGH else (value + 1, _LOW)
    return bounds


def shard_of(bounds: list[tuple[int, int]], hi: Column, lo: Column) -> Column:
    """How many boundaries a key has reached."""
    out = F.lit(0)
    for h, low in bounds:
        if h >= _HIGH:
            continue
        reached = hi >= F.lit(h) if low == _LOW else (hi > F.lit(h)) | ((hi == F.lit(h)) & (lo >= F.lit(low)))
        out = out + reached.cast("int")
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with hi (hash of the text), lo (hash of the id) and size in bytes plus eight."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(
        {
            "__hi": F.xxhash64(text),
            "__lo": F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))),
            "__size": (F.octet_length(text) + OVERHEAD).cast("long"),
        }
    )


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
           tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``__size``, ``__shard`` (0 to ``shards`` - 1) and ``__slot`` (gapless from 0).

    Rows are ordered by the hash of their text, then of their id, and cut where shards hold
    near equal bytes: within ``tolerance`` of a shard, or as near as one row or one group of
    equal texts allows. Equal texts stand together and share a shard; only a group that holds
    more than ``GROUP_SHARE`` of a shard is cut, and only where it meets a boundary.

    Null texts count as empty, null ids as an empty string; both are placed like others. Rows
    equal in id and text share a key and so a shard. Other columns ride along; names that begin
    with two underscores are the operator's own. An empty table gives an empty one.

    The search reads 24 bytes a row; rows are exchanged once, into cells inside shards that are
    numbered from the cells' counts, so that no task holds a shard.
    """
    rows = keyed(docs, id_col, text_col)
    keys = hand_over(rows.select(F.col("__hi").alias("hi"), F.col("__lo").alias("lo"), F.col("__size").alias("size")), "keys")
    bounds = splitters(keys, shards, tolerance)
    bits = max(0, min(_CELL_BITS, math.ceil(math.log2(max(1, keys.count()) / _CELL_ROWS))))

    def celled(df: DataFrame, hi: str, lo: str) -> DataFrame:
        return df.withColumns(
            {
                "__shard": shard_of(bounds, F.col(hi), F.col(lo)),
                "__cell": F.shiftright(hi, 64 - bits).cast("int") if bits else F.lit(0),
                "__part": F.shiftright(lo, 64 - _SUB_BITS).cast("int"),
            }
        )

    cell = ["__shard", "__cell", "__part"]
    counts = celled(keys, "hi", "lo").groupBy(*cell).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = hand_over(
        counts.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "cells"
    )
    # At most 2^12 cells of 2^4 parts, and a few more where shards cut them: under 3 MB.
    placed = celled(rows, "__hi", "__lo").join(F.broadcast(starts), cell)
    order = Window.partitionBy(*cell).orderBy("__hi", "__lo", "__size")
    numbered = placed.withColumn("__slot", F.col("__start") + F.row_number().over(order) - 1)
    return numbered.select(*[F.col(f"`{c}`") for c in docs.columns], "__size", "__shard", "__slot")
