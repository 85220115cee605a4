"""SimHash near-duplicates over a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.components import connected_components
from meterwise.llm.storage import free_name, hand_over, row_key

SEED = 42
WIDTH = 4
RADIUS = 4
BYTES = 8
_KEY = "__row_key"
_STEP = 1 << 15  # hashes whose bits are unpacked at a time
HOT = 1 << 16  # fingerprints of a posting that one task links by itself


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text, A-Z lower-cased, repeats included.

    ``bytes.split()`` cuts at space and 0x09-0x0D. Words are joined by single spaces, so each
    shingle is one slice of the joined text.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64
    )


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash: a bit is 1 if it is set in over half the shingle hashes, else 0."""
    hashes = shingle_hashes(text or b"", width)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int(bits.view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, key, fp)`` for every row, ``fp`` as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = np.fromiter(
                (fingerprint(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                [id_col, "key", "fp"],
            )

    rows = docs.select(
        F.col(id_col),
        row_key(id_col, text_col).alias("key"),
        F.col(text_col).cast("binary").alias("body"),
    )
    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, key string, fp bigint")


def _quartets(radius: int) -> list[np.uint64]:
    """Byte masks of all combinations of 8 - radius byte positions.

    Fingerprints within ``radius`` bits differ in at most ``radius`` bytes, so they share at
    least 8 - radius positional bytes: the guaranteed minimum of the count filter.
    """
    keep = BYTES - radius
    return [
        np.uint64(sum(0xFF << (8 * b) for b in chosen))
        for chosen in combinations(range(BYTES), keep)
    ]


def _index(fps: DataFrame, radius: int) -> DataFrame:
    """Postings ``(slot, bytes, fp)``: the byte-position lists, intersected ``8 - radius`` at a time.

    Single byte lists hold 1/256 of all rows each. Their intersections are what the count
    filter asks for, and have 32-bit keys at radius 4.
    """
    masks = _quartets(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 14):
                part = values[at : at + (1 << 14)].view(np.uint64)
                keys = np.concatenate([part & m for m in masks])
                slots = np.repeat(np.arange(len(masks), dtype=np.int32), len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots),
                        pa.array(keys.view(np.int64)),
                        pa.array(np.tile(part, len(masks)).view(np.int64)),
                    ],
                    ["slot", "bytes", "fp"],
                )

    return fps.select("fp").mapInArrow(run, "slot int, bytes bigint, fp bigint")


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many byte positions agree: the tally of the count filter."""
    differing = (a ^ b)[..., None].view(np.uint8)
    return BYTES - np.count_nonzero(differing, axis=-1)


def _links(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all members of one posting as its verified pairs would.

    A breadth-first walk: each reached member is compared with the members not reached yet,
    tallied, filtered and verified. Every true link of the posting lies inside one connected
    part, and n - 1 links at most leave the posting instead of n squared pairs.
    """
    heads, tails = [], []
    left = members
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        near = queue.pop()
        # One distance pass suffices here: a distance within the radius implies the tally.
        hit = np.bitwise_count(left ^ near) <= radius
        if hit.any():
            found = left[hit]
            heads.append(np.full(len(found), near))
            tails.append(found)
            queue.extend(found)
            left = left[~hit]
    if not heads:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(heads), np.concatenate(tails)


def _posting_links(
    slots: np.ndarray, keys: np.ndarray, fps: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of postings that lie one after another."""
    fps = fps.view(np.uint64)
    cut = np.flatnonzero((slots[1:] != slots[:-1]) | (keys[1:] != keys[:-1])) + 1
    starts = np.concatenate(([0], cut))
    sizes = np.diff(np.concatenate((starts, [len(fps)])))
    out_a, out_b = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):  # small postings all at once
        rows = fps[starts[sizes == size][:, None] + np.arange(size)]
        left, right = np.triu_indices(size, 1)
        a, b = rows[:, left].ravel(), rows[:, right].ravel()
        tallied = _shared_bytes(a, b) >= BYTES - radius
        a, b = a[tallied], b[tallied]
        close = np.bitwise_count(a ^ b) <= radius
        out_a.append(a[close])
        out_b.append(b[close])
    for at in np.flatnonzero(sizes > 8):
        a, b = _links(fps[starts[at] : starts[at] + sizes[at]], radius)
        out_a.append(a)
        out_b.append(b)
    if not out_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _linked_in_stream(postings: DataFrame, radius: int, hot: int | None) -> DataFrame:
    """``(u, v, slot)`` of postings that are dealt by key, sorted and read as a stream.

    A null slot marks a link ``(u, v)``. A posting that outgrows ``hot`` is passed on instead, as
    members ``u`` of the posting ``(slot, v)``, so a task holds one batch and ``hot`` fingerprints
    (8 bytes each) at most.
    """

    def linked(part: list[np.ndarray]) -> pa.RecordBatch:
        edges = _edges(*_posting_links(*part, radius))
        none = pa.nulls(edges.num_rows, pa.int32())
        return pa.RecordBatch.from_arrays([*edges.columns, none], ["u", "v", "slot"])

    def passed_on(part: list[np.ndarray]) -> pa.RecordBatch:
        slots, keys, fps = map(pa.array, part)
        return pa.RecordBatch.from_arrays([fps, keys, slots], ["u", "v", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        outgrown = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if outgrown is not None:
                more = np.count_nonzero((now[0] == outgrown[0]) & (now[1] == outgrown[1]))
                yield passed_on([x[:more] for x in now])
                now = [x[more:] for x in now]
            if not len(now[0]):
                continue
            outgrown = None
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield linked([x[:cut] for x in now])
            if hot is not None and len(rest[0]) > hot:
                yield passed_on(rest)
                outgrown, rest = (rest[0][0], rest[1][0]), None
        if rest is not None:
            yield linked(rest)

    dealt = postings.repartition("slot", "bytes").sortWithinPartitions("slot", "bytes")
    return dealt.mapInArrow(run, "u bigint, v bigint, slot int")


def _tiles(members: DataFrame, block: int) -> DataFrame:
    """Postings ``(slot, bytes, fp)`` dealt to all pairs of their blocks, each pair a posting.

    Every two members of a posting meet in a pair. Pairs are named by a hash; should two agree,
    their members are compared as well, and only verified links leave.
    """
    sizes = members.groupBy("slot", "bytes").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("own")
    cut = members.join(hand_over(sizes, "hot-sizes"), ["slot", "bytes"]).select("*", own)
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("bytes", F.least("own", "other"), F.greatest("own", "other"))
    # A block meets itself in each of its pairs.
    return dealt.where("own <> other OR blocks = 1").select("slot", pair.alias("bytes"), "fp")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``(u, v)`` links between distinct fingerprints that span the graph of all close pairs.

    ``fps`` has a column ``fp`` of distinct signed longs. A posting of up to ``hot`` fingerprints
    is linked by one task; the members of larger ones are dealt to pairs of blocks of half that
    size, a task each, so that no posting is a single task's work.
    """
    if not 0 <= radius < BYTES:
        raise ValueError("radius must lie in 0..7")
    found = hand_over(_linked_in_stream(_index(fps, radius), radius, hot), "posting-links")
    members = found.where("slot IS NOT NULL").select("slot", F.col("v").alias("bytes"), F.col("u").alias("fp"))
    dealt = _linked_in_stream(_tiles(members, max(1, hot // 2)), radius, None)
    return found.where("slot IS NULL").select("u", "v").union(dealt.select("u", "v"))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b], axis=1).view(np.int64), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _classes(
    keyed: DataFrame, id_col: str, radius: int, more_links: DataFrame | None = None
) -> DataFrame:
    """Every row's id, key and fingerprint with the root and smallest id of its component.

    Equal fingerprints are merged before the index is built, so exact copies cost one posting.
    ``more_links`` are further ``(u, v)`` links between fingerprints.
    """
    owners = hand_over(keyed.groupBy("fp").agg(F.min(id_col).alias("first_id")), "owners")
    links = fingerprint_links(owners, radius)
    nodes = connected_components(links if more_links is None else links.union(more_links))
    grouped = hand_over(
        owners.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp")
        ),
        "grouped",
    )
    first = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.select("fp", "root").join(hand_over(first, "first"), "root")
    return keyed.join(hand_over(named, "named"), "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``(id_col, fp, fingerprint, component_id)``, one row per input row.

    Texts are lower-cased (A-Z), cut into 4-word shingles and reduced to a 64-bit SimHash;
    fingerprints within ``radius`` bits are linked and ``component_id`` is the smallest id that
    links reach, the row's own included.

    Null and empty texts have no words: fingerprint zero, linked like any other. Rows with a
    null id take part; the id of their component is the smallest non-null one, or null if
    there is none. Repeated rows are returned as often as they occur. Other columns of ``docs``
    are not read, so their names cannot clash. An empty table gives an empty table.
    """
    keyed = hand_over(fingerprints(docs, id_col, text_col), "fingerprints")
    return _classes(keyed, id_col, radius).select(
        id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    similarity: float | None = None,
) -> DataFrame:
    """Keep one row of every near-duplicate group: the one with the smallest id.

    With a ``similarity`` texts are linked as well if their sets of five-word shingles are as
    similar as that (``similarity.similar_links``); fingerprints within ``radius`` bits are
    linked in any case.

    Columns and their names stay as they are, whatever they are. Rows that share the winning id
    are told apart by their text, and rows that repeat both are reduced to one; a group without
    any id keeps one. Null and empty texts form one group. An empty table gives an empty table.
    """
    if similarity is None:
        keyed, more_links = hand_over(fingerprints(docs, id_col, text_col), "fingerprints"), None
    else:
        from meterwise.llm.similarity import shingle_sets, similar_links

        sets = hand_over(shingle_sets(docs, id_col, text_col), "shingle-sets")
        keyed, more_links = sets.select(id_col, "key", "fp"), similar_links(sets, similarity)
    found = _classes(keyed, id_col, radius, more_links)
    winners = found.groupBy("root").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col), "key")).alias("w")
    )
    mark = free_name(docs, _KEY)
    winners = hand_over(winners.select(F.col("w.key").alias(mark)), "winners")
    kept = docs.withColumn(mark, row_key(id_col, text_col)).join(winners, mark, "left_semi")
    return kept.dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
