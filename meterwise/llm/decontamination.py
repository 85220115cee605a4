"""Benchmark decontamination by greedy string tiling over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores: case and punctuation do not count."""
    return _WORD.findall((text or "").lower())


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` ids, modulo 2^64."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = out * _BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


@dataclass(frozen=True)
class Block:
    """Benchmark items of bounded size, with an index of their seeds."""

    names: list
    vocabulary: dict[str, int]
    words: np.ndarray  # ids of all items, one after another
    starts: np.ndarray  # where each item starts, and the end
    seeds: np.ndarray  # sorted distinct seed hashes
    first: np.ndarray  # their first entry in ``at``, and the end
    at: np.ndarray  # word positions of the seeds

    @classmethod
    def build(cls, items: list[tuple[object, list[str]]], min_tile: int) -> Block:
        vocabulary: dict[str, int] = {}
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for _, ws in items for w in ws]
        words = np.array(ids, np.int64)
        starts = np.cumsum([0] + [len(ws) for _, ws in items])
        if len(words) >= min_tile:
            hashes = _rolling(words, min_tile)
            place = np.arange(len(hashes))
            item = np.searchsorted(starts, place, "right") - 1
            inside = place + min_tile <= starts[item + 1]
            hashes, place = hashes[inside], place[inside]
        else:
            hashes, place = np.empty(0, np.uint64), np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        seeds, first = np.unique(hashes[order], return_index=True)
        first = np.append(first, len(order))
        return cls([n for n, _ in items], vocabulary, words, starts, seeds, first, place[order])


def _power(base: np.uint64, count: int) -> np.ndarray:
    """base^0 to base^(count - 1), modulo 2^64."""
    factors = np.full(count, base, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


class _Windows:
    """Karp-Rabin hashes of the windows of any width, from one running sum.

    Word k of a window weighs base^-k, wherever the window starts: the sum of x_i base^-i up to
    a place, times base^place, gives the hash of a window as a difference.
    """

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.free = ids != 0
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * _power(back, len(ids)), dtype=np.uint64)))
        self.scale = _power(_BASE, len(ids))

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows without a marked word."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[width:] == taken[:-width])
        return at, (self.sums[at + width] - self.sums[at]) * self.scale[at]


def _longest(text: _Windows, item: _Windows, low: int, high: int) -> int:
    """The largest width up to ``high`` at which unmarked windows agree, 0 below ``low``."""
    best = 0
    while low <= high:
        width = (low + high) // 2
        if np.isin(text.of(width)[1], item.of(width)[1]).any():
            best, low = width, width + 1
        else:
            high = width - 1
    return best


def _mark(text: _Windows, item: _Windows, width: int) -> int:
    """Mark the matches of one width in order of text, then item position; returns their number."""
    left, left_hash = text.of(width)
    right, right_hash = item.of(width)
    shared = np.isin(left_hash, right_hash)
    order = np.argsort(right_hash, kind="stable")
    right, right_hash = right[order], right_hash[order]
    begin = np.searchsorted(right_hash, left_hash[shared])
    end = np.searchsorted(right_hash, left_hash[shared], "right")
    gone: dict[int, int] = {}  # places of a hash before this one are marked
    tiles = 0
    for p, first, last in zip(left[shared].tolist(), begin.tolist(), end.tolist()):
        at = gone.get(first, first)
        if at == last or not text.free[p : p + width].all():
            continue
        while at < last and not item.free[right[at] : right[at] + width].all():
            at += 1
        gone[first] = at
        for k in range(at, last):
            q = right[k]
            if item.free[q : q + width].all() and np.array_equal(text.ids[p : p + width], item.ids[q : q + width]):
                text.free[p : p + width] = False
                item.free[q : q + width] = False
                tiles += 1
                break
    return tiles


def greedy_tiles(text: np.ndarray, item: np.ndarray, min_tile: int) -> tuple[int, int]:
    """Greedy string tiling of word ids (0: no word of the item): (matched words, tiles).

    Rounds run from the longest width at which unmarked windows agree to the shortest. Each
    round marks all matches of its width, ties by position, which leaves none of that width.
    Memory is linear in text and item.
    """
    a, b = _Windows(text), _Windows(item)
    matched = tiles = 0
    high = min(len(text), len(item))
    while width := _longest(a, b, min_tile, high):
        found = _mark(a, b, width)
        matched, tiles, high = matched + found * width, tiles + found, width - 1
    return matched, tiles


def _kept(ids: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The words inside windows at ``places``, with a 0 between parts that are not adjacent."""
    inside = np.zeros(len(ids) + 1, np.int64)
    np.add.at(inside, places, 1)
    np.add.at(inside, places + width, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    return np.insert(ids[at], np.flatnonzero(np.diff(at) > 1) + 1, 0)


def tile_text(block: Block, text: str | None, min_tile: int = MIN_TILE,
              coverage: float = 0.0) -> list[tuple[int, int, int, int]]:
    """For each item that shares a seed with the text: (item, matched words, tiles, words).

    Items of which seeds cover less than ``coverage`` can not reach it and are left out.
    """
    get = block.vocabulary.get
    words = words_of(text)
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    if len(ids) < min_tile or not len(block.seeds):
        return []
    unknown = np.concatenate(([0], np.cumsum(ids == 0)))
    place = np.flatnonzero(unknown[min_tile:] == unknown[:-min_tile])
    if not len(place):
        return []
    hashes = _rolling(ids, min_tile)[place]
    seeds = np.unique(hashes)
    near = np.minimum(np.searchsorted(block.seeds, seeds), len(block.seeds) - 1)
    near = near[block.seeds[near] == seeds]
    if not len(near):
        return []
    at = np.sort(np.concatenate([block.at[block.first[k] : block.first[k + 1]] for k in near]))
    owner = np.searchsorted(block.starts, at, "right") - 1
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    found = []
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
        which, mine = int(owner[low]), at[low:high]
        start, size = block.starts[which], int(block.starts[which + 1] - block.starts[which])
        if np.minimum(np.diff(mine, append=mine[-1] + min_tile), min_tile).sum() < coverage * size:
            continue
        part = block.words[start : start + size]
        own = np.isin(hashes, _rolling(part, min_tile)[mine - start])
        matched, tiles = greedy_tiles(_kept(ids, place[own], min_tile), _kept(part, mine - start, min_tile), min_tile)
        if tiles:
            found.append((which, matched, tiles, size))
    return found


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           min_tile: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Cut the benchmark into blocks of about ``block_words`` words, one at a time.

    Items arrive on the driver as a stream; a block, the only thing that is broadcast, stays
    within that bound plus one item. Null items, and items shorter than a tile, are too little
    to be recognised by: they match nothing.
    """
    items: list[tuple[object, list[str]]] = []
    held = 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        words = words_of(row[1])
        if len(words) < min_tile:
            continue
        items.append((row[0], words))
        held += len(words)
        if held >= block_words:
            yield Block.build(items, min_tile)
            items, held = [], 0
    if items:
        yield Block.build(items, min_tile)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", min_tile: int = MIN_TILE, coverage: float = COVERAGE,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every (document, item) with at least ``coverage`` of the item's words inside tiles.

    Columns: ``id_col``, ``item_col``, ``coverage``, ``matched_words``, ``item_words``,
    ``n_tiles``. Tiles may stand in any order, so a reordered passage counts in full. Whole
    texts are tiled against whole items. Documents with null or short texts match nothing;
    a repeated row or item gives repeated results; null ids are carried through. Other columns
    are not read. An empty table on either side gives an empty result.

    Documents are never shuffled: the seed join is a broadcast join against one bounded block.
    """
    docs_ = docs.select(F.col(id_col), F.col(text_col))
    id_type = docs_.schema[0].dataType
    item_type = benchmark.schema[item_col].dataType
    schema = (f"`{id_col}` {id_type.simpleString()}, `{item_col}` {item_type.simpleString()}, "
              "coverage double, matched_words int, item_words int, n_tiles int")
    result = None
    for block in blocks(benchmark, item_col, text_col, min_tile, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            one = shared.value
            item_arrow = None
            for batch in batches:
                texts = batch.column(1)
                rows, found = [], []
                for i in range(len(texts)):
                    for hit in tile_text(one, texts[i].as_py(), min_tile, coverage):
                        if hit[1] >= coverage * hit[3]:
                            rows.append(i)
                            found.append(hit)
                if not rows:
                    continue
                if item_arrow is None:
                    item_arrow = pa.array(one.names)
                which, matched, tiles, size = (np.array(x, np.int32) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        item_arrow.take(pa.array(which)),
                        pa.array(matched / size),
                        pa.array(matched),
                        pa.array(size),
                        pa.array(tiles),
                    ],
                    [id_col, item_col, "coverage", "matched_words", "item_words", "n_tiles"],
                )

        part = docs_.mapInArrow(run, schema)
        result = part if result is None else result.union(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", min_tile: int = MIN_TILE,
                      coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item to ``coverage``, columns unchanged.

    Null, empty and short texts cover nothing and stay; repeated rows stay or go alike. Other
    columns ride along whatever their names. An empty table on either side drops nothing.
    """
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, text_col, min_tile, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at)
                clean = [
                    not any(
                        hit[1] >= coverage * hit[3]
                        for hit in tile_text(shared.value, texts[i].as_py(), min_tile, coverage)
                    )
                    for i in range(len(texts))
                ]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
