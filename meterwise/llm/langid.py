"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

ORDERS = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
MAX_LANGS = 100
UNDETERMINED = "und"
_STEP = 1 << 18  # code points handled at a time
_SPACE = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letter_codes(text: str) -> np.ndarray:
    """Lower-cased code points; everything but letters becomes a space, runs of spaces one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, _SPACE)
    codes = np.concatenate(([_SPACE], codes, [_SPACE]))
    return codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]


_Piece = tuple[np.ndarray, np.ndarray, np.ndarray]


def _chunks(texts: list[str | None]) -> Iterator[_Piece]:
    """Code points of many texts in bounded pieces, their rows, and where n-grams may start.

    A long text is cut into pieces that overlap by one n-gram less a character; no n-gram starts
    in the overlap of an earlier piece, so each is counted once, as if there were no cut.
    """
    held: list[_Piece] = []
    size = 0
    overlap = max(ORDERS) - 1
    for row, text in enumerate(texts):
        own = _letter_codes(text or "")
        for at in range(0, max(1, len(own) - overlap), _STEP):
            part = own[at : at + _STEP + overlap]
            opens = np.ones(len(part), bool)
            if at + _STEP + overlap < len(own):
                opens[_STEP:] = False
            held.append((part, np.full(len(part), row, np.int64), opens))
            size += len(part)
            if size >= _STEP:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _buckets(piece: _Piece, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of all n-grams with their rows, one pair of arrays per order."""
    codes, rows, opens = piece
    for order in ORDERS:
        n = len(codes) - order + 1
        if n < 1:
            continue
        key = np.full(n, order, np.uint64)
        for k in range(order):
            key = key * np.uint64(0x100000001B3) + codes[k : k + n]
        whole = (rows[:n] == rows[order - 1 :]) & opens[:n]
        mixed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        yield mixed[whole].astype(np.int64), rows[:n][whole]


@dataclass(frozen=True)
class Model:
    """Languages in code-point order, log prior per language, log probability per bucket."""

    langs: list[str]
    prior: np.ndarray
    log_prob: np.ndarray
    bits: int


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS,
        max_langs: int = MAX_LANGS) -> Model:
    """Count n-grams of all rows with a text and a language.

    Each task counts its rows into one array per language, tasks' counts are summed by a
    shuffle, and only languages x 2^bits sums reach the driver; more than ``max_langs``
    languages raise an error. Nothing to learn from gives a model without languages.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, np.ndarray] = {}
        docs_seen: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                tallies.setdefault(lang, np.zeros(size, np.int64))
                docs_seen[lang] = docs_seen.get(lang, 0) + langs.count(lang)
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs], np.int64)
            for piece in _chunks(batch.column(0).to_pylist()):
                for bucket, row in _buckets(piece, bits):
                    sums = np.bincount(own[row] * size + bucket, minlength=size * len(names))
                    for name, part in zip(names, sums.reshape(len(names), size)):
                        tallies[name] += part
        for lang, tally in tallies.items():
            at = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1), pa.string()),
                    pa.array(np.concatenate(([-1], at))),
                    pa.array(np.concatenate(([docs_seen[lang]], tally[at]))),
                ],
                ["lang", "bucket", "n"],
            )

    known = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    known = known.where("t is not null and l is not null")
    sums = hand_over(
        known.mapInArrow(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n")),
        "ngrams",
    )
    langs = sorted(r.lang for r in sums.where("bucket = -1").select("lang").limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs if that is meant")
    counts = np.zeros((size, len(langs)))
    seen = np.ones(len(langs))
    at = {x: i for i, x in enumerate(langs)}
    rows = sums.toPandas()
    column = rows["lang"].map(at).to_numpy(np.int64) if len(rows) else np.empty(0, np.int64)
    bucket, n = rows["bucket"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    first = bucket < 0
    seen[column[first]] = n[first]
    counts[bucket[~first], column[~first]] = n[~first]
    smooth = counts + SMOOTHING
    return Model(
        langs,
        np.log(seen / seen.sum()) if langs else seen,
        np.log(smooth / smooth.sum(axis=0)) if langs else smooth,
        bits,
    )


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Most probable language and its posterior probability for every text."""
    total = np.zeros((len(texts), len(model.langs)))
    lettered = np.zeros(len(texts), bool)
    for piece in _chunks(texts):
        lettered[piece[1][piece[0] != _SPACE]] = True
        for bucket, row in _buckets(piece, model.bits):
            if not len(row):
                continue
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            total[row[starts]] += np.add.reduceat(model.log_prob[bucket], starts, axis=0)
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total += model.prior
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
    names = [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
    return names, np.where(lettered, score, 0.0)


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep``'s columns with ``lang_pred`` and ``score``, one row per input row.

    Only ``text_col`` is an input of the prediction. A null text, or one without any letter, is
    ``und`` with score 0; so is every text if the model knows no language. Equal probabilities
    go to the language that comes first by code point. Whole texts are scored, long ones in
    pieces. Columns of ``docs`` that ``keep`` does not name are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("__text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = score_texts(shared.value, batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(score)],
                [*names, "lang_pred", "score"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)]]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
