import re
from collections import defaultdict

import pytest

from meterwise.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, size int"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[n] for n in full)
        share = sum(weigh[n] for n in names if n not in full)
        got = {n: most * sizes[n] if n in full else left * weigh[n] / share for n in names}
        over = {n for n in names if n not in full and got[n] > most * sizes[n]}
        if not over:
            return got
        full |= over


def rows_of(spec):
    out, n = [], 0
    for source, count, words in spec:
        for i in range(count):
            out.append((n, "x " * (words + i % 3) + " y", source, "clash", 1))
            n += 1
    return out


SPECS = [
    [("a", 40, 9), ("b", 3, 2), ("c", 25, 6), (None, 10, 4), ("ä", 2, 30)],
    [("s1", 1, 5)],
    [("a", 2, 1), ("b", 2, 1), ("c", 90, 50), ("d", 1, 0), ("e", 4, 700)],
]


@pytest.mark.parametrize("spec", SPECS)
def test_targets_and_cuts(spark, spec):
    rows = rows_of(spec) + [(9000, None, "a", "clash", 1), (9001, "", None, "clash", 1), (9002, " \t ", "only blank", "clash", 1)]
    rows += [(None, "no id here", "a", "clash", 1), (7, "same row twice", "a", "clash", 1), (7, "same row twice", "a", "clash", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r["__size"] == n and 0 <= r["__taken"] <= 3 * n
        sizes[r.source] += n
        taken[r.source] += r["__taken"]
        targets[r.source] = r["__target"]
    want = plain_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) < 1
        assert {r["__source_size"] for r in got if r.source == s} == {sizes[s]}


def test_reruns_agree_whatever_the_partitions(spark):
    rows = rows_of(SPECS[0])
    pick = lambda df: sorted((r.doc_id, r["__taken"]) for r in mixing.mix(df).collect())
    assert pick(spark.createDataFrame(rows, SCHEMA)) == pick(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))


def test_materialised_documents_are_whole_and_near_the_targets(spark):
    rows = rows_of(SPECS[0]) + [(9001, "", None, "clash", 1), (9002, None, "a", "clash", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.materialise(df)
    assert out.columns == df.columns
    got = out.collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in got)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, t, s, *_ in rows:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    for r in got:
        taken[r.source] += words(r.text)
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1
    assert sum(r.doc_id >= 9001 for r in got) == 2


def test_running_sums_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = mixing.running(df, [F.col("k")], {"before": F.col("k"), "place": F.lit(1)}).collect()
    assert all(r.place == r.k and r.before == r.k * (r.k - 1) // 2 for r in got) and len(got) == 1000
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.materialise(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "clash", 1), (2, "", "a", "clash", 1)], SCHEMA)
    assert [r["__taken"] for r in mixing.mix(blank).collect()] == [0, 0]
