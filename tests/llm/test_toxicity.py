import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import toxicity

DOCS = "doc_id long, text string, score string, predicted string, toxic int"


def plain_features(text, bits=toxicity.BITS):
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split(" ")
    h = [crc32(w.encode()) for w in words if w]
    out = {x * 0x9E3779B97F4A7C15 % 2**64 >> 64 - bits for x in h}
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        out |= {(a * 0x100000001B3 + b + gap) % 2**64 * salt % 2**64 >> 64 - bits for a, b in zip(h, h[gap:])}
    return out


def test_features_match_a_plain_count_and_cuts_change_nothing(monkeypatch):
    text = "You are, well... a BIG Loser é über_all " * 5
    assert set(toxicity.distinct_features(text).tolist()) == plain_features(text)
    monkeypatch.setattr(toxicity, "_STEP", 4)
    assert set(toxicity.distinct_features(text).tolist()) == plain_features(text)
    assert len(toxicity.distinct_features(None)) == len(toxicity.distinct_features(" .")) == 0


def test_ftrl_follows_its_recurrence():
    learner = toxicity.Ftrl(8)
    z, n = np.zeros(9), np.zeros(9)
    for at, y in [([1, 3], 1.0), ([3], 0.0), ([1, 2, 3], 1.0)] * 9:
        learner.update(np.array(at), y)
        at = [*at, 8]
        w = {}
        for i in at:
            l1 = 0.0 if i == 8 else toxicity.L1
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        body = rng.choices(words, k=rng.randrange(3, 40))
        toxic = i % 5 == 0
        if toxic:
            body.insert(rng.randrange(len(body)), rng.choice(["scum", "idiot"]))
        rows.append((i, " ".join(body), "clash", "clash", int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.where("doc_id % 3 <> 0").select("doc_id", "toxic").union(
        spark.createDataFrame([(5, 1), (None, 1), (7, None), (10_000, 1)], "doc_id long, toxic int"))
    return docs, labels


def test_unseen_toxic_documents_are_found_and_clean_ones_left(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.index) < 400  # L1 keeps the weights few
    got = toxicity.predict(docs.where("doc_id % 3 = 0"), model, {"doc_id": F.col("doc_id"), "truth": F.col("toxic")}).collect()
    assert sum(r.predicted == r.truth for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = spark.createDataFrame(
        [(1, None, "", "", 0), (2, "", "", "", 0), (3, "w1 " * 100_000 + "scum idiot", "", "", 0), (3, "w1 " * 100_000 + "scum idiot", "", "", 0), (None, "w1 w2", "", "", 0)], DOCS)
    scores = toxicity.predict(odd, model, {"doc_id": F.col("doc_id")}).collect()
    assert [r.predicted for r in scores] == [0, 0, 1, 1, 0]
    assert scores[0].score == scores[1].score == pytest.approx(1 / (1 + np.exp(-model.bias)))
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [1, 2, None]


def test_fits_agree_and_empty_tables_work(spark, corpus):
    docs, labels = corpus
    one = toxicity.fit(docs, labels, fit_rows=100)
    two = toxicity.fit(docs.repartition(7), labels.repartition(3), fit_rows=100)
    assert one.bias == two.bias and np.array_equal(one.weight, two.weight)
    empty = spark.createDataFrame([], DOCS)
    model = toxicity.fit(empty, labels)
    assert model.bias == 0.0 and not len(model.index)
    assert toxicity.predict(empty, model, {"doc_id": F.col("doc_id")}).count() == 0
    assert toxicity.drop_toxic(empty, one).count() == 0


def test_the_sample_is_bounded_by_examples(spark, corpus, monkeypatch):
    docs, labels = corpus
    seen = []
    keep = toxicity.hand_over
    monkeypatch.setattr(toxicity, "hand_over", lambda df, label: seen.append((label, keep(df, label))) or seen[-1][1])
    hot = docs.where("doc_id = 1").crossJoin(spark.range(500)).drop("id")  # one labelled id on many rows
    many = spark.range(300).selectExpr(
        "2L AS doc_id", "concat('w', id, ' text of its own') AS text", "'' AS score", "'' AS predicted", "0 AS toxic")
    lost = spark.range(20_000, 21_000).selectExpr("id AS doc_id", "1 AS toxic")  # labels without a document
    rows = docs.union(hot).union(many)
    toxicity.fit(rows, labels.union(lost), fit_rows=250)
    tables = dict(seen)
    assert tables["chosen"].count() == tables["examples"].count() == 250
    seen.clear()
    one = toxicity.fit(rows, labels.union(lost))
    tables = dict(seen)
    assert tables["examples"].count() == tables["chosen"].count() == 700
    assert tables["examples"].where("times = 501").count() == 1 and tables["examples"].where("times = 1").count() == 699
    two = toxicity.fit(rows.repartition(5), lost.union(labels))
    assert one.bias == two.bias and np.array_equal(one.weight, two.weight)


def test_an_example_of_two_weighs_as_its_recurrence_says():
    learner = toxicity.Ftrl(4)
    learner.update(np.array([2]), 1.0, 2.0)
    assert learner.z[2] == learner.z[4] == -1.0 and learner.n[2] == 1.0 and learner.z[0] == 0.0
