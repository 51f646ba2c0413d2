"""Similarity of two short texts by matching blocks, in column expressions.

The longest common block is taken, then the longest ones left and right of it, and so on; the ratio is
twice the characters in blocks over all characters.  Of equally long blocks the first in ``a`` counts,
then the first in ``b``.  In a ``b`` of 200 characters or more, characters that make up over a
hundredth of it start no block, they only extend one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# From this length on, characters of at least one hundredth of the text are popular.
LONG_TEXT, POPULAR_SHARE = 200, 100

_SEGMENT = "struct<a:string,b:string>"
_STATE = f"struct<todo:array<{_SEGMENT}>,size:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def _popular(b: Column) -> Column:
    limit = F.floor(F.length(b) / POPULAR_SHARE) + 1
    often = F.filter(F.array_distinct(F.split(b, "")), lambda c: (c != "") & (_count(b, c) > limit))
    return F.when(F.length(b) >= LONG_TEXT, F.array_join(often, "")).otherwise(F.lit(""))


def _part(text: Column, start: Column, size: Column | int) -> Column:
    """``size`` characters from the one at ``start``, counted from 0."""
    return F.substring(text, start + 1, size if isinstance(size, Column) else F.lit(size))


def _longest(a: Column, b: Column, popular: Column) -> Column:
    """Start in ``a``, start in ``b`` and length of the longest common block."""

    def grow(s: Column, _: Column) -> Column:
        tried = _part(a, s["i"], s["k"] + 1)
        fits = (s["i"] + s["k"] < F.length(a)) & b.contains(tried) & (F.call_function("translate", tried, popular, F.lit("")) == tried)
        return F.when(fits, F.struct(s["i"].alias("i"), (s["k"] + 1).alias("k"), s["i"].alias("best"))).otherwise(
            F.struct((s["i"] + 1).alias("i"), s["k"].alias("k"), s["best"].alias("best"))
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("k"), F.lit(0).alias("best"))
    steps = F.sequence(F.lit(1), F.length(a) + F.least(F.length(a), F.length(b)))
    seed = F.aggregate(
        steps, start, grow,
        lambda s: F.struct(
            s["best"].alias("i"),
            F.when(s["k"] > 0, F.instr(b, _part(a, s["best"], s["k"])) - 1).otherwise(0).alias("j"),
            s["k"].alias("k"),
        ),
    )

    def left(s: Column, _: Column) -> Column:
        more = (s["i"] > 0) & (s["j"] > 0) & (_part(a, s["i"] - 1, 1) == _part(b, s["j"] - 1, 1))
        return F.when(more, F.struct((s["i"] - 1).alias("i"), (s["j"] - 1).alias("j"), (s["k"] + 1).alias("k"))).otherwise(s)

    def right(s: Column, _: Column) -> Column:
        inside = (s["i"] + s["k"] < F.length(a)) & (s["j"] + s["k"] < F.length(b))
        more = inside & (_part(a, s["i"] + s["k"], 1) == _part(b, s["j"] + s["k"], 1))
        return F.when(more, F.struct(s["i"].alias("i"), s["j"].alias("j"), (s["k"] + 1).alias("k"))).otherwise(s)

    each = F.sequence(F.lit(1), F.length(a))
    return F.when(popular == "", seed).otherwise(F.aggregate(each, F.aggregate(each, seed, left), right))


def matching_size(a: Column, b: Column) -> Column:
    """Number of characters in the matching blocks of ``a`` and ``b``."""
    popular = _popular(b)

    def split_at(state: Column, segment: Column, block: Column) -> Column:
        i, j, k = block["i"], block["j"], block["k"]
        before = F.struct(_part(segment["a"], F.lit(0), i).alias("a"), _part(segment["b"], F.lit(0), j).alias("b"))
        after = F.struct(
            _part(segment["a"], i + k, F.length(segment["a"])).alias("a"), _part(segment["b"], j + k, F.length(segment["b"])).alias("b")
        )
        sides = F.filter(F.array(before, after), lambda s: (s["a"] != "") & (s["b"] != "") & (k > 0))
        rest = F.slice(state["todo"], 1, F.size(state["todo"]) - 1)
        return F.struct(F.concat(rest, sides).alias("todo"), (state["size"] + k).alias("size"))

    def step(state: Column, _: Column) -> Column:
        segment = F.try_element_at(state["todo"], F.lit(-1))
        divided = _let(segment, lambda s: _let(_longest(s["a"], s["b"], popular), lambda block: split_at(state, s, block)))
        return F.when(F.size(state["todo"]) > 0, divided).otherwise(state)

    whole = F.array(F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.filter(whole, lambda s: (s["a"] != "") & (s["b"] != "")).alias("todo"), F.lit(0).alias("size")).cast(_STATE)
    steps = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)
    return F.aggregate(steps, start, step, lambda s: s["size"])


def matching_ratio(a: Column, b: Column) -> Column:
    """From 0 to 1; two empty texts are alike."""
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.try_divide(2.0 * matching_size(a, b), size.cast("double")))


def shared_characters_ratio(a: Column, b: Column) -> Column:
    """An upper bound of ``matching_ratio``: characters in common, wherever they stand."""
    chars = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    shared = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(_count(a, c), _count(b, c)))
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.try_divide(2.0 * shared, size.cast("double")))
