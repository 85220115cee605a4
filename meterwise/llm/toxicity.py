"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

BITS = 18
FIT_ROWS = 16_000
EPOCHS = 6
ALPHA = 2.0
BETA = 1.0
L1 = 10.0
L2 = 0.02
_STEP = 1 << 16
#: ASCII characters that are neither letters nor digits separate words.
_SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed unigrams, bigrams and skip-grams (one word left out) of a whole text, in pieces."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_SEPARATE).split()
    for at in range(0, len(words), _STEP):
        part = words[at : at + _STEP + 2]
        h = np.fromiter(map(crc32, part), np.uint64, len(part))
        last = at + _STEP >= len(words)
        own = len(part) if last else _STEP
        keys = [h[:own] * np.uint64(0x9E3779B97F4A7C15)]
        for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            n = min(own, len(h) - gap)
            if n > 0:
                mixed = h[:n] * np.uint64(0x100000001B3) + h[gap : gap + n] + np.uint64(gap)
                keys.append(mixed * np.uint64(salt))
        yield (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int32)


def distinct_features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Each feature that occurs, once: presence does not grow with a text's length."""
    parts = [np.unique(x) for x in features(text, bits)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Bias and the non-zero weights; L1 keeps them few, so the broadcast is compact."""

    bias: float
    index: np.ndarray
    weight: np.ndarray
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


class Ftrl:
    """State of FTRL-proximal: ``z`` and squared gradients ``n`` for every coordinate.

    The last coordinate is the bias, which L1 does not shrink.
    """

    def __init__(self, size: int):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)
        self.l1 = np.full(size + 1, L1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def update(self, index: np.ndarray, label: float, times: float = 1.0) -> None:
        """Learn from one example that occurs ``times`` times: its gradient counts so often."""
        at = np.append(index, len(self.z) - 1)
        w = self.weights(at)
        g = times * (_sigmoid(w.sum()) - label)
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS, epochs: int = EPOCHS,
        bits: int = BITS) -> Model:
    """Fit on at most ``fit_rows`` examples, the labelled documents that have a label.

    Documents that share id and text are one example, weighted by how often they occur.
    ``fit_rows`` bounds the examples themselves: the first in the order of a hash of id and text,
    so an id on many rows neither fills the sample by one text nor adds rows to it, and labels
    without a document take no place. Features are hashed in parallel; the online learner then
    reads the examples as a stream in hash order, ``epochs`` times, in one task that holds its
    two state arrays and a batch. A label that is null is no label; an id with several labels is
    toxic if any says so; a null text is an empty one. Without examples the model scores 0.5.
    """
    size = 1 << bits
    labelled = hand_over(
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg((F.max(label_col) > 0).cast("double").alias("__label")),
        "labelled",
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    texts = texts.withColumn("__body", F.xxhash64("__text"))
    chosen = hand_over(
        texts.select("__id", "__body").join(labelled, "__id")
        .groupBy("__id", "__body", "__label").agg(F.count("*").cast("double").alias("__times"))
        .withColumn("__order", F.xxhash64("__id", "__body"))
        .orderBy("__order", "__id", "__body")
        .limit(fit_rows),
        "chosen",
    )
    # fit_rows bounds the broadcast side; rows that agree are reduced where they are read.
    once = texts.join(F.broadcast(chosen.select("__id", "__body")), ["__id", "__body"]).dropDuplicates(["__id", "__body"])
    rows = once.join(F.broadcast(chosen), ["__id", "__body"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_features(t, bits) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))],
                ["ord", "label", "times", "features"],
            )

    examples = hand_over(
        rows.select("__order", "__label", "__times", "__text").mapInArrow(
            hashed, "ord bigint, label double, times double, features array<int>"
        ),
        "examples",
    )
    # The stream holds the examples once per epoch, each epoch in the same order.
    epoch = F.explode(F.sequence(F.lit(1), F.lit(epochs)))
    stream = examples.withColumn("epoch", epoch).repartition(1)
    stream = stream.sortWithinPartitions("epoch", "ord", "label", "times")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Ftrl(size)
        for batch in batches:
            lists = batch.column(2)
            pairs = zip(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            for i, (label, times) in enumerate(pairs):
                learner.update(lists[i].values.to_numpy(zero_copy_only=False), label, times)
        weight = learner.weights(np.arange(size + 1))
        at = np.append(np.flatnonzero(weight[:-1]), size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight[at])], ["at", "weight"])

    # The non-zero weights and the bias.
    rows = stream.select("label", "times", "features").mapInArrow(learn, "at bigint, weight double").collect()
    found = sorted((r["at"], r["weight"]) for r in rows)
    bias = found.pop()[1] if found else 0.0
    return Model(
        bias, np.array([a for a, _ in found], np.int64), np.array([w for _, w in found], np.float64), bits
    )


def score_texts(model: Model, texts: list[str | None], dense: np.ndarray | None = None) -> np.ndarray:
    """Probability of the label for every text."""
    dense = model.dense() if dense is None else dense
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        hits = [x[dense[x] != 0] for x in features(text, model.bits)]
        total = dense[np.unique(np.concatenate(hits))].sum() if hits else 0.0
        out[i] = _sigmoid(model.bias + total)
    return out


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep``'s columns with ``score`` and ``predicted`` (1 from 0.5), one row per input row.

    Only ``text_col`` is an input. Null and empty texts score by the bias alone. Whole texts are
    scored, long ones in pieces. Columns that ``keep`` does not name are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("__text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value.dense()
        for batch in batches:
            score = score_texts(shared.value, batch.column(len(names)).to_pylist(), dense)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                [*names, "score", "predicted"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)]]
    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value.dense()
        for batch in batches:
            score = score_texts(shared.value, batch.column(at).to_pylist(), dense)
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
