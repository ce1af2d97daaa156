"""Edit distances and common subsequences of long sequences, bit-parallel.

A column of the dynamic program is one whole number with a bit a place, so a step costs a few operations on
machine words of 64 places. Short pairs stay with Spark's own ``levenshtein``; only long ones go to Python, in
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paperloom.functions import scalars as S
from paperloom.sources.shared import importable

#: Cells of the dynamic program up to which Spark's own function is used, in characters; in words, up to which words are coded.
CELLS, WORD_CELLS = 1 << 16, 1 << 10
#: The distance that is tried first (a step within it costs hardly more than within a smaller one); of greater ones, the fourfold next.
FIRST = 256


def _places(a: Sequence[Hashable]) -> dict[Hashable, int]:
    """The places of each symbol, as bits; in linear time by way of byte strings."""
    rows: dict[Hashable, bytearray] = {}
    size = (len(a) + 7) // 8
    few = len(set(a)) <= 4096  # then byte strings of all symbols fit in memory
    if not few:
        out: dict[Hashable, int] = {}
        for i, x in enumerate(a):
            out[x] = out.get(x, 0) | 1 << i
        return out
    for i, x in enumerate(a):
        row = rows.get(x)
        if row is None:
            row = rows[x] = bytearray(size)
        row[i >> 3] |= 1 << (i & 7)
    return {x: int.from_bytes(row, "little") for x, row in rows.items()}


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two sequences: vertical differences in two bit vectors."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    at, most = _places(a), max(FIRST, len(a) - len(b))
    while 4 * most < len(a):  # beyond, whole columns cost less
        found = _within(at, len(a), b, most)
        if found <= most:
            return found
        most *= 4
    return _whole(at, len(a), b)


def _whole(at: dict[Hashable, int], size: int, b: Sequence[Hashable]) -> int:
    """The distance by whole columns of the dynamic program; at: places in the other sequence, of ``size`` symbols."""
    every, top = (1 << size) - 1, 1 << size - 1
    up, down, found = every, 0, size
    for x in b:
        same = at.get(x, 0)
        level = (((same & up) + up) ^ up) | same | down
        right = down | every & ~(level | up)
        left = up & level
        if right & top:
            found += 1
        elif left & top:
            found -= 1
        right = right << 1 | 1
        up = (left << 1 | ~(level | right)) & every
        down = right & level & every
    return found


def _within(at: dict[Hashable, int], size: int, b: Sequence[Hashable], most: int) -> int:
    """The distance if it is at most ``most``, else some greater number; b isn't longer than ``size``, nor shorter by more than ``most``.

    Of each column only the places within ``most`` of the diagonal are kept: a window of bits that moves down by
    one place with each step (Hyyro 2003). A step costs what the distance asks for, not what the text's length does.
    """
    width = 2 * most + 1
    every, top = (1 << width) - 1, 1 << width - 1
    block = (1 << 2 * width) - 1
    up, down, found = every >> most << most, 0, most
    cut: dict[Hashable, int] = {}
    base = None
    for j, x in enumerate(b):
        if not j % width:  # the places that the next steps see, of each symbol once
            cut, base = {}, j - most
        same = cut.get(x)
        if same is None:
            whole = at.get(x, 0)
            same = cut[x] = (whole >> base if base >= 0 else whole << -base) & block
        same = same >> j % width & every
        level = ((((same & up) + up) ^ up) | same | down) & every
        right = down | every ^ (level | up)
        left = up & level
        if j < size - most:  # along the window's last place, a diagonal
            if not level & top:
                found += 1
                if found > 2 * most:  # what is left can save no more than ``most``
                    return found
        else:  # along the last row, which moves up in the window
            top >>= 1
            if right & top:
                found += 1
            elif left & top:
                found -= 1
        level >>= 1
        up = left | every ^ (level | right)
        down = level & right
    return found


def aligned(places: Sequence[int], size: int) -> int:
    """The longest chain of pairs (i, j), both growing, where bit i of ``places[j]`` is set; i is below ``size``."""
    every = (1 << size) - 1
    left = every
    for same in places:
        both = left & same
        left = (left + both | left - both) & every
    return size - left.bit_count()


def _udf(f: Callable[[object, object], int]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(LongType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="Int64")

    def made(a: Column, b: Column) -> Column:
        importable(SparkSession.active())
        return run(a, b)

    return made


_long_texts = _udf(distance)
_long_lists = _udf(lambda a, b: distance(list(a), list(b)))


def text_distance(a: Column, b: Column, cells: int = CELLS) -> Column:
    """Levenshtein distance of two texts in code points, NULL if one is."""
    small = (a == b) | (F.length(a).cast("long") * F.length(b) <= cells)
    own = F.when(a == b, F.lit(0)).otherwise(F.levenshtein(F.when(small, a), F.when(small, b))).cast("long")
    return F.coalesce(own, _long_texts(F.when(~small, a), F.when(~small, b)))


def cer(reference: Column | str, hypothesis: Column | str, cells: int = CELLS) -> Column:
    """Character error rate of texts of any length, as ``scalars.cer``."""
    a, b = (S.strip(F.coalesce(S._col(x), F.lit(""))) for x in (reference, hypothesis))
    return S._rate(text_distance(a, b, cells), F.length(a), F.length(b))


def wer(reference: Column | str, hypothesis: Column | str, cells: int = WORD_CELLS) -> Column:
    """Word error rate of texts of any length, as ``scalars.wer``."""

    def words(x):
        return F.filter(F.split(S.strip(F.coalesce(S._col(x), F.lit(""))), r"(?U)\s+"), lambda w: w != "")

    same = F.coalesce(S._col(reference), F.lit("")) == F.coalesce(S._col(hypothesis), F.lit(""))  # no words are told apart then
    a, b = (F.when(~same, words(x)) for x in (reference, hypothesis))
    small = F.size(a).cast("long") * F.size(b) <= cells
    long = _long_lists(F.when(~small, a), F.when(~small, b)) / F.nullif(F.size(a), F.lit(0))
    return F.when(same, F.lit(0.0)).when(small, S.wer(F.when(small, S._col(reference)), F.when(small, S._col(hypothesis)))).otherwise(long)
