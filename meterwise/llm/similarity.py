"""Links between texts whose sets of word shingles are alike, found through rare shared shingles.

SimHash at a few bits finds near copies with few edits only. This module adds the pairs down to a
stated similarity: an inverted index over sampled shingles gives candidates, a count of the
shared shingles verifies each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.simhash import fingerprint, shingle_hashes
from meterwise.llm.storage import hand_over, row_key

WIDTH = 5
SIMILARITY = 0.8
SAMPLE = 16  # smallest hashes of a text's shingles: the same choice in every text
PREFIX = 8  # the rarest of them are looked up
SMALL = 12  # up to here a text and its partners are sampled whole
BLOCK = 2048  # members of a posting that are compared in one task with as many others


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, key, fp, digest, n, low, body)`` for every row of ``docs``.

    ``n`` counts the text's distinct five-word shingles (fewer words: the whole sequence; none:
    0), ``low`` holds the smallest of their hashes, ``body`` the upper 32 bits of all, ascending.
    ``fp`` is the SimHash of the text. A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, sizes, lows, bodies = [], [], [], [], []
            for value in batch.column(2):
                text = value.as_py() or b""
                hashes = np.unique(shingle_hashes(text, WIDTH))
                fps.append(fingerprint(text))
                digests.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                lows.append(hashes[:SAMPLE].view(np.int64))
                bodies.append((hashes >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(np.array(digests, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(lows, pa.list_(pa.int64())),
                    pa.array(bodies, pa.binary()),
                ],
                [id_col, "key", "fp", "digest", "n", "low", "body"],
            )

    rows = docs.select(
        F.col(id_col),
        row_key(id_col, text_col).alias("key"),
        F.col(text_col).cast("binary").alias("text"),
    )
    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"`{id_col}` {id_type}, key string, fp bigint, digest bigint, n bigint, "
        "low array<bigint>, body binary",
    )


def _prefix() -> Column:
    """How many sampled shingles of a text are looked up."""
    whole = F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") - F.lit(1e-9)) + 1
    return F.when(F.col("n") <= SMALL, whole).otherwise(PREFIX)


def _postings(owners: DataFrame) -> DataFrame:
    """``(h, i, j, key)``: texts that share a looked-up shingle, in pairs of blocks.

    Shingles that few texts sample come first, so a passage that many texts share is looked up
    only by texts that hold little else. A posting above ``BLOCK`` texts is dealt to all pairs
    of its blocks, so that no task holds more than about two blocks.
    """
    sampled = owners.select("key", "n", F.explode("low").alias("h"))
    common = sampled.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1")
    met = sampled.join(hand_over(common, "common"), "h")
    mine = Window.partitionBy("key")
    place = F.row_number().over(mine.orderBy("texts", "h"))
    alone = F.least("n", F.lit(SAMPLE)) - F.count("*").over(mine)  # looked up first, meet nobody
    looked_up = hand_over(
        met.select("*", place.alias("place"), alone.alias("alone"))
        .where(F.col("place") + F.col("alone") <= _prefix())
        .select("h", "key"),
        "looked-up",
    )
    sizes = looked_up.groupBy("h").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    cut = looked_up.join(hand_over(sizes, "postings"), "h").select(
        "h", "key", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("own"), blocks.alias("blocks")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return cut.select("h", "key", "own", other).select(
        "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key"
    )


def alike(bodies: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links ``(a, b)`` of members that join them as all pairs at ``similarity`` would.

    A breadth-first walk: each reached member is compared with all that are not reached yet, so
    n members leave n - 1 links at most.
    """
    sizes = np.array([len(b) for b in bodies])
    vocabulary, ids = np.unique(np.concatenate(bodies), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mask = np.zeros(len(vocabulary), bool)
    left, tokens = np.arange(1, len(bodies)), ids[starts[1] :]
    links, queue = [], [0]
    while len(left):
        if not queue:
            queue, tokens, left = [int(left[0])], tokens[sizes[left[0]] :], left[1:]
            continue
        near = queue.pop()
        mask[ids[starts[near] : starts[near + 1]]] = True
        offsets = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
        shared = np.add.reduceat(mask[tokens], offsets, dtype=np.int64)
        mask[ids[starts[near] : starts[near + 1]]] = False
        hit = shared >= similarity * (sizes[left] + sizes[near] - shared) - 1e-9
        if hit.any():
            found = left[hit].tolist()
            links.extend((near, f) for f in found)
            queue.extend(found)
            tokens = tokens[np.repeat(~hit, sizes[left])]
            left = left[~hit]
    return links


def similar_links(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(u, v)`` links between fingerprints of texts that are alike.

    ``sets`` is a hand-over table of ``shingle_sets``. Two texts are alike if their sets of
    shingles have a Jaccard similarity of at least ``similarity`` (0.8 or more). Of the 16
    smallest hashes of the union of two such sets both texts sample nine or more, except with a
    chance of 0.7 % at a similarity of 0.8, less above; then their eight rarest sampled
    shingles meet. Up to 12 shingles the choice is exact. No pair is added that is not alike.

    Texts with equal sets count once. Texts without words link with none here. Links join the
    members of each posting; not every pair is listed.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError("similarity must lie in 0.8..1")
    merged = sets.where("n > 0").groupBy("fp", "digest").agg(
        F.min(F.struct("key", "n", "low")).alias("o")
    )
    owners = hand_over(merged.select("fp", "o.*"), "set-owners")
    postings = hand_over(_postings(owners), "blocks")
    wanted = hand_over(postings.select("key").distinct(), "wanted")
    bodies = sets.select("key", "fp", "body").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    rows = postings.join(hand_over(bodies, "bodies"), "key").select("h", "i", "j", "fp", "body")

    def group_links(part: list[np.ndarray], fps: np.ndarray) -> Iterator[tuple[int, int]]:
        for a, b in alike(part, similarity):
            if fps[a] != fps[b]:
                yield int(fps[a]), int(fps[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, fps, bodies = None, [], []
        found: set[tuple[int, int]] = set()
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for now, fp, body in zip(names, batch.column(3).to_pylist(), batch.column(4)):
                if now != name:
                    if len(fps) > 1:
                        found.update(group_links(bodies, fps))
                    name, fps, bodies = now, [], []
                fps.append(fp)
                bodies.append(np.frombuffer(body.as_py(), "<u4"))
            yield _edges(found)
            found = set()
        if len(fps) > 1:
            found.update(group_links(bodies, fps))
        yield _edges(found)

    dealt = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _edges(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["u", "v"])
