import random

import pytest
from pyspark.sql import types as T

from meterwise.llm import similarity, simhash
from meterwise.llm.storage import hand_over
from test_simhash import plain_fingerprint

TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def shingles(text):
    words = [w for w in "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or ""
    ).split(" ") if w]
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b, least=0.8):
    return bool(a and b) and len(a & b) >= least * len(a | b) - 1e-9


def parts(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        if label[a] != label[b]:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
    return label


def near_copies(count, seed, sizes=(0, 1, 4, 5, 6, 9, 14, 40, 200)):
    """Texts with a shared passage, and copies of them with one to four words replaced."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(50)]
    out = []
    for k in range(count):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(sizes))] + (passage if k % 3 == 0 else [])
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            edited = list(words)
            for _ in range(rng.randrange(1, 5)):
                if edited:
                    edited[rng.randrange(len(edited))] = f"W{rng.randrange(9)}"
            out.append(" ".join(edited))
    return out


def links(spark, texts, least=0.8):
    docs = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    sets = hand_over(similarity.shingle_sets(docs), "sets")
    return {frozenset((r.u, r.v)) for r in similarity.similar_links(sets, least).collect()}


@pytest.mark.parametrize("block, least", [(2048, 0.8), (7, 0.8), (2048, 0.9)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block, least):
    monkeypatch.setattr(similarity, "BLOCK", block)
    texts = near_copies(120, seed=block)
    sets = [shingles(t) for t in texts]
    fps = [plain_fingerprint(t) - ((plain_fingerprint(t) >> 63) << 64) for t in texts]
    at = {}
    for k, fp in enumerate(fps):
        at.setdefault(fp, k)
    same = [(at[fp], k) for k, fp in enumerate(fps)]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j], least)]
    got = links(spark, texts, least)
    assert all(
        any(alike(sets[i], sets[j], least) for i, a in enumerate(fps) if a == u
            for j, b in enumerate(fps) if b == v)
        for u, v in map(tuple, got)
    )
    have = parts(len(texts), same + [(at[u], at[v]) for u, v in map(tuple, got)])
    assert len(want) > 50
    assert sum(have[i] == have[j] for i, j in want) >= 0.99 * len(want)


def test_one_large_group_and_a_passage_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    group = []
    for k in range(300):
        words = list(base)
        words[rng.randrange(80)] = f"x{k}"
        group.append(" ".join(words))
    others = [" ".join([f"o{k}_{i}" for i in range(30)] + base[:30]) for k in range(300)]
    got = links(spark, group + others)
    assert len(got) < 300 * 40  # far from all pairs
    seen, reach = set(), {}
    for u, v in map(tuple, got):
        reach.setdefault(u, set()).add(v)
        reach.setdefault(v, set()).add(u)
    todo = [next(iter(reach))]
    while todo:
        node = todo.pop()
        if node not in seen:
            seen.add(node)
            todo.extend(reach[node])
    fps = {plain_fingerprint(t) - ((plain_fingerprint(t) >> 63) << 64) for t in group}
    assert seen == fps


def test_keep_first_with_nulls_ties_long_texts_and_clashing_names(spark):
    schema = T.StructType(TEXTS.fields + [T.StructField(c, T.StringType()) for c in ("__row_key", "KEY", "n", "fp")])
    long_text = " ".join(f"t{i % 977}" for i in range(60000))
    near = " ".join(f"a{i}" for i in range(60))
    rows = [(1, near), (2, near + " tail"), (2, near + " tail"), (None, near), (3, None), (4, ""), (5, " \t"),
            (6, "one word"), (7, "ONE word"), (8, long_text), (9, long_text + " end"), (None, "alone"), (10, "alone too")]
    docs = spark.createDataFrame([(*r, "k", "K", "n", "f") for r in rows], schema)
    kept = simhash.keep_first(docs, similarity=0.8)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert {tuple(r)[2:] for r in got} == {("k", "K", "n", "f")}
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in got) == sorted(
        [(1, near[:9]), (3, ""), (6, "one word"), (8, long_text[:9]), (0, "alone"), (10, "alone too")])
    assert simhash.keep_first(docs.limit(0), similarity=0.8).collect() == []


def test_similarity_below_the_index_is_refused(spark):
    sets = similarity.shingle_sets(spark.createDataFrame([(1, "a")], TEXTS))
    with pytest.raises(ValueError):
        similarity.similar_links(sets, 0.5)


def test_recall_on_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = sorted({r.text or "" for r in rows})
    sets = [shingles(t) for t in texts]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(i, j) for who in holders.values() if len(who) < 200 for i in who for j in who
             if i < j and alike(sets[i], sets[j])}
    fps = [plain_fingerprint(t) - ((plain_fingerprint(t) >> 63) << 64) for t in texts]
    got = links(spark, texts)
    index = {fp: k for k, fp in reversed(list(enumerate(fps)))}
    label = parts(len(texts), [(index[u], index[v]) for u, v in map(tuple, got)] +
                  [(index[fp], k) for k, fp in enumerate(fps)])
    assert len(pairs) >= 5
    assert sum(label[i] == label[j] for i, j in pairs) >= 0.9 * len(pairs)
