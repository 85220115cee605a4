from collections import defaultdict

import pytest

from meterwise.llm import sharding

SCHEMA = "doc_id long, text string, shard string, hi int"


def check(rows, got, shards, slack):
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    size, slots, largest = defaultdict(int), defaultdict(list), 0
    for r in got:
        n = len((r.text or "").encode()) + 8
        assert r["__size"] == n and 0 <= r["__shard"] < shards
        size[r["__shard"]] += n
        slots[r["__shard"]].append(r["__slot"])
        largest = max(largest, n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal = sum(size.values()) / shards
    assert all(abs(size[k] - ideal) <= largest + slack * ideal for k in range(shards))


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_near_equal_and_slots_gapless(spark, shards):
    rows = [(i, f"text {i} " * (1 + i % 40)) for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sharding.assign(df, shards=shards).collect()
    check(rows, got, shards, 2 * sharding.TOLERANCE)


def test_equal_texts_share_a_shard_unless_they_are_many(spark):
    rows = [(i, f"own text number {i}") for i in range(1500)] + [(5000 + i, "the same text") for i in range(1000)]
    rows += [(9000 + i, f"twins {i // 2}") for i in range(400)] + [(None, None), (1, ""), (None, ""), (2, "é" * 5000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sharding.assign(df, shards=8, tolerance=0.01).collect()
    check(rows, got, 8, 0.02)
    homes = defaultdict(set)
    for r in got:
        homes[r.text].add(r["__shard"])
    assert len(homes["the same text"]) >= 3
    assert sum(len(h) > 1 for t, h in homes.items() if t and t.startswith("twins")) == 0
    again = sharding.assign(df.repartition(3), shards=8, tolerance=0.01).collect()
    assert sorted((str(r.doc_id), r["__shard"]) for r in again) == sorted((str(r.doc_id), r["__shard"]) for r in got)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_groups_of_the_tables_stay_whole(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    homes = sharding.assign(docs).selectExpr("md5(coalesce(text, '')) AS h", "`__shard` AS s", "`__size` AS n").toPandas()
    groups = homes.groupby("h").agg(homes=("s", "nunique"), size=("n", "sum"))
    shard = homes["n"].sum() / sharding.SHARDS
    assert groups.loc[groups["size"] <= sharding.GROUP_SHARE * shard, "homes"].max() == 1
    sizes = homes.groupby("s")["n"].sum()
    assert len(sizes) == 24 and (sizes - shard).abs().max() < 0.03 * shard + homes["n"].max()


def test_one_text_for_all_rows_repeated_rows_and_empty_table(spark):
    rows = [(i, "one") for i in range(480)]
    got = sharding.assign(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)).collect()
    check(rows, got, 24, 0.0)
    rows = [(1, "twice"), (1, "twice"), (2, "x" * 100_000)]
    got = sharding.assign(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA), shards=3).collect()
    check(rows, got, 3, 0.0)
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splitters_count_exactly(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) hi", "xxhash64(id, 1) lo", "id % 17 + 1 size")
    rows = sorted((r.hi, r.lo, r.size) for r in keys.collect())
    total = sum(r[2] for r in rows)
    bounds = sharding.splitters(keys, 7, 0.0)
    assert bounds == sorted(bounds)
    for k, (hi, lo) in enumerate(bounds, 1):
        below = sum(s for h, l, s in rows if (h, l) < (hi, lo))
        assert abs(below - total * k / 7) <= 17 / 2
