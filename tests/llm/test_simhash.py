import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from meterwise.llm import simhash
from meterwise.llm.components import connected_components

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("u", T.IntegerType()),
    ]
)


def plain_fingerprint(text):
    words = [w for w in "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or ""
    ).split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """All pairs, then the smallest id of each connected part."""
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "ÀB", "x y"]
    out = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 60, 200]))
        out.append("\t".join(words[:3]) + " \n".join([""] + words[3:]))
        if i % 3 == 0:
            for _ in range(3):
                edited = list(words)
                if edited:
                    edited[rng.randrange(len(edited))] = "CHANGED"
                out.append(" ".join(edited))
    return out


def test_components_match_all_pairs(spark):
    bodies = texts(60)
    rows = [(i, t) for i, t in enumerate(bodies)]
    rows += [(500, None), (501, ""), (None, "  \n"), (None, "only this one stands alone here"), (3, bodies[3]),
             (700, "long " * 60_000), (701, "long " * 60_001)]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fp", "fingerprint", "component_id"]
    key = lambda r: repr(tuple(r))
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()], key=key) == sorted(
        plain_components(rows), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_first(df).columns == df.columns
    assert simhash.keep_first(df).count() == 0


def test_large_posting_keeps_every_link():
    rng = np.random.default_rng(1)
    base = np.uint64(0x0123456789ABCDEF)
    ball = {int(base)}
    for _ in range(600):
        x = int(base)
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        ball.add(x)
    members = np.array(sorted(ball), np.uint64)
    a, b = simhash._links(members, 4)
    assert len(a) < len(members) and np.all(np.bitwise_count(a ^ b) <= 4)
    parts = lambda pairs: plain_parts(members.tolist(), pairs)
    every = [(int(x), int(y)) for i, x in enumerate(members) for y in members[:i] if bin(int(x) ^ int(y)).count("1") <= 4]
    assert parts(list(zip(a.tolist(), b.tolist()))) == parts(every)


def test_hot_postings_are_dealt_to_pairs_of_blocks(spark):
    rng = np.random.default_rng(4)
    base, nodes = 0x0123456789ABCDEF, set()
    for _ in range(900):  # many share the upper four bytes and more, so their postings are large
        x = base
        for b in rng.choice(32, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b)
        nodes.add(x)
    nodes |= {int(x) for x in rng.integers(0, 2**63, 200)}
    nodes = sorted(nodes)
    every = [(x, y) for i, x in enumerate(nodes) for y in nodes[:i] if (x ^ y).bit_count() <= 4]
    fps = spark.createDataFrame([(n,) for n in nodes], "fp long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        members = simhash._linked_in_stream(simhash._index(fps, 4), 4, 100).where("slot IS NOT NULL")
        assert members.groupBy("slot", "v").count().where("count > 100").count() > 1
        for hot in (100, simhash.HOT):
            pairs = [(r.u, r.v) for r in simhash.fingerprint_links(fps, 4, hot).collect()]
            assert all((u ^ v).bit_count() <= 4 for u, v in pairs)
            assert plain_parts(nodes, pairs) == plain_parts(nodes, every)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def plain_parts(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_connected_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = sorted({x for p in pairs for x in p})
    assert got == plain_parts(nodes, pairs)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_first_leaves_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(300))
    other = "quite another text of its own with several more words in it"
    rows = [(9, text), (4, text + " tail"), (4, text + " tail"), (6, other), (None, text), (None, "nobody knows this id"), (None, "nobody knows this id")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(
        [(4, text + " tail"), (6, other), (None, "nobody knows this id")], key=repr)
