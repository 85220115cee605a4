"""Column expressions over texts and positions that stay linear in the length of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
_CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row.

    A column named inside a lambda may be computed for every element; a lambda's own variable
    is not. Whatever is costly is therefore bound here before a lambda uses it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    """Sum of an array of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _blocks(values: Column) -> Column:
    count = F.greatest(F.ceil(F.size(values) / _BLOCK).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def sums_before(values: Column) -> Column:
    """For every element of an array the sum of those before it.

    Sums run inside blocks of 256, and over the blocks' totals, so the work grows about
    linearly with the array instead of with its square.
    """

    def inside(block: Column, start: Column) -> Column:
        return F.transform(block, lambda _, i: start + total(F.slice(block, F.lit(1), i)))

    def over(blocks: Column) -> Column:
        starts = let(
            F.transform(blocks, total), lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        )
        return F.flatten(F.zip_with(blocks, starts, inside))

    return let(values, lambda v: let(_blocks(v), over))


def chunks(text: Column) -> Column:
    """A text as an array of pieces of 4096 code points, so that ``cut`` need not start at 0."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (0-based) of a text given as its ``chunks``."""
    first = F.floor(start / _CHUNK).cast("int")
    last = F.floor((start + length) / _CHUNK).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(length > 0, F.substring(near, (start - first * _CHUNK + 1).cast("int"), length.cast("int"))).otherwise("")
