import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"
WORDS = {"en": "the and of with that", "de": "der und nicht mit schön", "fr": "le et être avec où"}


def plain_buckets(text, bits=langid.BITS):
    """Counts of n-gram buckets, one character at a time."""
    out = {}
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = " " + " ".join(kept.split()) + " " if kept.split() else " "
    for order in langid.ORDERS:
        for i in range(len(kept) - order + 1):
            key = order
            for c in kept[i : i + order]:
                key = (key * 0x100000001B3 + ord(c)) % 2**64
            bucket = key * 0x9E3779B97F4A7C15 % 2**64 >> 64 - bits
            out[bucket] = out.get(bucket, 0) + 1
    return out


def buckets(text):
    out = {}
    for piece in langid._chunks([text]):
        for bucket, _ in langid._buckets(piece, langid.BITS):
            for b in bucket.tolist():
                out[b] = out.get(b, 0) + 1
    return out


def test_buckets_match_a_plain_count_and_cuts_change_nothing(monkeypatch):
    text = "Der Hund, 12 öffnet\n\n die Tür! 😀 Ünï " * 7
    assert buckets(text) == plain_buckets(text)
    monkeypatch.setattr(langid, "_STEP", 10)
    assert buckets(text) == plain_buckets(text)
    assert buckets("a") == plain_buckets("a")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(WORDS[l].split()[k % 5] for k in range(i, i + 6)), l, "clash", 1) for i, l in enumerate(["en", "de", "fr"] * 10)]
    rows += [(900, None, "en", "clash", 1), (901, "", "en", "clash", 1), (902, "123 456!", "en", "clash", 1), (None, "und nicht mit", None, "clash", 1),
             (903, "mit der und nicht " * 40_000, None, "clash", 1), (903, "the", "en", "clash", 1), (903, "the", "en", "clash", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_scores_match_a_plain_model(docs):
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    rows = [r for r in docs.collect()]
    counts = {l: {} for l in model.langs}
    seen = {l: 0 for l in model.langs}
    for r in rows:
        if r.text is not None and r.lang is not None:
            seen[r.lang] += 1
            for b, n in plain_buckets(r.text).items():
                counts[r.lang][b] = counts[r.lang].get(b, 0) + n
    size = 1 << model.bits
    got = langid.predict(docs, model, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(got) == len(rows)
    for r in got:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = []
        for l in model.langs:
            total = sum(counts[l].values()) + langid.SMOOTHING * size
            logs.append(math.log(seen[l] / sum(seen.values())) + sum(
                n * math.log((counts[l].get(b, 0) + langid.SMOOTHING) / total) for b, n in plain_buckets(r.text).items()))
        best = int(np.argmax(logs))
        assert r.lang_pred == model.langs[best]
        assert r.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs), rel=1e-6)


def test_nothing_to_learn_and_empty_tables(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.fit(empty)
    assert model.langs == []
    got = langid.predict(docs, model, {"doc_id": F.col("doc_id")}).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.predict(empty, langid.fit(docs), {"doc_id": F.col("doc_id")}).count() == 0


def test_too_many_languages_are_an_error(docs):
    with pytest.raises(ValueError):
        langid.fit(docs, max_langs=2)
