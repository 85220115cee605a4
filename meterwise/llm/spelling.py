"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

WORD = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form occurs at least this many times as often as its variant.
RATIO = 5
#: One run in so many loses a code point.
NOISE = 199
#: Words of a tile times its letters: longer words share a tile with fewer others.
TILE = 1024
TILE_LENGTH = 64
#: Parts of the alphabet whose letter numbers make a block.
PARTS = 4
_STRIP = 512
_LETTERS = 26
_LATIN = 0xC0
_WIDTH = _LETTERS + 0x100 - _LATIN
#: Letters compared at once when candidates are verified.
_COMPARED = 1 << 22


def runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``word``: every run of letters of at least ``MIN_LENGTH`` code points after the noise."""
    run = F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD), F.lit(0)))
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), "run")
    at = F.pmod("h", F.length("run")).cast("int")
    # A shorter run can not become a word, since the noise only removes.
    found = docs.select(id_col, run.alias("run")).where(F.length("run") >= MIN_LENGTH)
    found = found.select(id_col, lower.alias("run")).select("run", F.crc32(key).alias("h"))
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: all words of the texts that occur at least ``MIN_COUNT`` times."""
    counted = runs(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    flat = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
    return flat.reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often every letter occurs in each row.

    Products of counts are whole numbers; floats of the chosen width hold their sums exactly.
    """
    column = np.where(codes < _LATIN, codes - ord("a"), codes - _LATIN + _LETTERS).astype(np.int64)
    column += np.arange(len(codes))[:, None] * _WIDTH
    counts = np.bincount(column.ravel(), minlength=len(codes) * _WIDTH).reshape(len(codes), _WIDTH)
    return counts.astype(np.float32 if codes.shape[1] < 2048 else np.float64)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``b`` that become the row of ``a`` when one code point is deleted."""
    length = a.shape[1]
    front, back = a != b[:, :-1], (a != b[:, 1:])[:, ::-1]
    prefix = np.where(front.any(axis=1), front.argmax(axis=1), length)
    suffix = np.where(back.any(axis=1), back.argmax(axis=1), length)
    return prefix + suffix >= length


def near_pairs(a: np.ndarray, b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray,
               rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``a``'s ``rows`` and ``b`` that are one edit apart.

    One edit moves the letter counts by a squared distance of 1 (inserted, deleted) or 2
    (replaced), so only pairs at 1 or 2 in the Gram matrix are compared letter by letter.
    """
    left = counts_a[rows]
    gram = left @ counts_b.T
    squared = (left * left).sum(axis=1)[:, None] + (counts_b * counts_b).sum(axis=1)[None, :] - 2 * gram
    i, j = np.nonzero((squared <= 2) & (squared > 0))
    i = i + rows.start
    edit = one_replaced if a.shape[1] == b.shape[1] else one_inserted
    step = max(1, _COMPARED // b.shape[1])
    good = [edit(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def _tally(group: pd.DataFrame) -> pd.DataFrame:
    """Near words of the words of a tile and of those that it meets: number and best one."""
    group = group.sort_values(["other", "length", "node"], ignore_index=True)
    words, n = group["word"].to_numpy(object), group["n"].to_numpy(np.int64)
    own = int((~group["other"]).sum())
    order = np.lexsort((np.argsort(np.argsort(words)), -n))  # by falling n, then by code points
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    total, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)

    def note(one: np.ndarray, other: np.ndarray) -> None:
        np.add.at(total, one, 1)
        np.minimum.at(best, one, rank[other])

    if own:
        a = code_points(list(words[:own]))
        counts = letter_counts(a)
        strips = [slice(at, min(at + _STRIP, own)) for at in range(0, own, _STRIP)]
        if group["tile"].iat[0] == group["batch"].iat[0]:
            for rows in strips:
                note(*near_pairs(a, a, counts, counts, rows))
        lengths = group["length"].to_numpy()[own:]
        for length in np.unique(lengths):
            at = own + np.searchsorted(lengths, length)
            b = code_points(list(words[at : own + np.searchsorted(lengths, length, "right")]))
            counts_b = letter_counts(b)
            for rows in strips:
                i, j = near_pairs(a, b, counts, counts_b, rows)
                note(i, j + at)
                note(j + at, i)
    hit = np.flatnonzero(total)
    top = order[best[hit]]
    return pd.DataFrame(
        {
            "node": group["node"].to_numpy()[hit], "n_near": total[hit], "best_n": n[top],
            "best": pd.Series(words[top], dtype=object),
        }
    )


def _part_counts(word: Column) -> Column:
    """How many letters of a word fall into each part of the alphabet."""
    letters = string.ascii_lowercase + "".join(map(chr, range(_LATIN, 0x100)))
    left_out = ["".join(c for k, c in enumerate(letters) if k % PARTS != p) for p in range(PARTS)]
    return F.array(*[F.length(F.translate(word, out, "")) for out in left_out])


def _steps() -> list[list[int]]:
    """How one edit can move part counts, each way once: one more letter, or one for another."""
    unit = np.eye(PARTS, dtype=int)
    more = [unit[i] for i in range(PARTS)]
    moved = [unit[i] - unit[j] for i in range(PARTS) for j in range(i)]
    return [step.tolist() for step in more + moved]


def _dealt(words: DataFrame, tile: int) -> DataFrame:
    """Every word once for each group (home, tile, batch) that it belongs to.

    The group has the words of one tile of the home block, and of every block that it meets
    (itself included) the words of one tile number.
    """
    keyed = words.withColumn("length", F.length("word")).withColumn("key", _part_counts(F.col("word")))
    share = F.ceil(F.count("*") * F.greatest(F.lit(1.0), F.first("length") / TILE_LENGTH) / tile)
    blocks = hand_over(keyed.groupBy("key").agg(share.cast("int").alias("tiles")), "blocks")
    moved = F.array(*[F.array(*[F.col("home")[k] + d for k, d in enumerate(step)]) for step in _steps()])
    meets = blocks.select(F.col("key").alias("home"), F.col("tiles").alias("home_tiles"))
    meets = meets.withColumn("key", F.explode(moved)).join(blocks, "key")
    batches = meets.groupBy(F.col("home").alias("key")).agg(F.max("tiles").alias("batches"))
    placed = keyed.join(blocks.join(batches, "key", "left"), "key")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    count = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1))
    out = ("home", "tile", "batch", "other", "node", "word", "length", "n")
    own = placed.select("*", F.col("key").alias("home"), F.col("own").alias("tile"), F.lit(False).alias("other"),
                        F.explode(count(F.greatest("tiles", "batches"))).alias("batch")).select(*out)
    same = placed.select("*", F.col("key").alias("home"), F.col("own").alias("batch"), F.lit(True).alias("other"),
                         F.explode(count(F.col("own"))).alias("tile")).select(*out)
    homes = placed.drop("tiles", "batches").join(meets.drop("tiles"), "key")
    met = homes.select("*", F.col("own").alias("batch"), F.lit(True).alias("other"),
                       F.explode(count(F.col("home_tiles"))).alias("tile")).select(*out)
    return own.union(same).union(met)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``(node, word, n)`` -> ``(node, n_near, best_n, best)`` for words that have near words.

    ``best`` is the most frequent near word, the first in code-point order among equals. Words
    with the same number of letters in each of ``PARTS`` parts of the alphabet form a block. One
    edit changes one of these numbers by one, or two of them in opposite directions, so a block
    meets itself and the few blocks that far away, of its own and the adjacent length. Blocks
    are cut into tiles by hash, and a task holds one tile of its block and one of each that it
    meets, however many words share a block. A task returns at most one row a word.
    """
    found = _dealt(words, tile).groupBy("home", "tile", "batch").applyInPandas(
        _tally, "node bigint, n_near bigint, best_n bigint, best string"
    )
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return (
        found.groupBy("node").agg(F.sum("n_near").alias("n_near"), top.alias("top"))
        .select("node", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best"))
    )


def roots(links: DataFrame) -> DataFrame:
    """``(word, form)`` -> ``(word, root)``: the last word that forms lead to.

    Every step multiplies the count by ``RATIO`` at least, so chains are short and free of
    circles; each round doubles the steps taken.
    """
    known = hand_over(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not known.join(nxt, "root", "left_semi").take(1):
            return known
        known = hand_over(
            known.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots"
        )


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of the texts.

    Words are runs of Latin letters, A to Z lower-cased; one run in ``NOISE`` (by the crc32 of
    id and run) loses a code point, as a slip of the keyboard would. Words of at least
    ``MIN_LENGTH`` code points with ``MIN_COUNT`` occurrences count. Near words differ by one
    code point inserted, deleted or replaced. The form of a word is its most frequent near word
    if that is ``RATIO`` times as frequent; roots follow forms to their end.

    A null text has no words; a null id counts as an empty one. Repeated rows count each, texts
    are read whole, other columns are not read, an empty table gives an empty one. Equal counts
    are settled by code-point order.
    """
    words = vocabulary(docs, id_col, text_col)
    # Written once, so that the node numbers stay.
    words = hand_over(words.withColumn("node", F.monotonically_increasing_id()), "words")
    known = hand_over(words.join(near_words(words, tile), "node", "left"), "near")
    good = F.col("best_n") >= RATIO * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
    )
    led = roots(known.where(F.col("form").isNotNull()))
    return known.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
