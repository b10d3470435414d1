"""Markers in a text and what stands around them, as column expressions.

A text is cut at every match of a pattern; the context of a match is put together again
from the pieces next to it.  A match has a least length, so the number of pieces that a
context of n characters can touch is bounded, and the work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def left(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def strip(c: Column, chars: str = r"\s") -> Column:
    """Without the leading and trailing characters of a regex class body."""
    return F.regexp_replace(F.regexp_replace(c, rf"^[{chars}]+", ""), rf"[{chars}]+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space as one space; a space alone is left as it is."""
    return F.regexp_replace(c, r"\s(?:\s+|(?<! ))", " ")


def matches(text: Column, pattern: str, before: int, after: int, least: int) -> Column:
    """array<struct(ordinal, mark, before, after)> of all matches of ``pattern``, each at
    least ``least`` characters long, with up to ``before`` / ``after`` characters around it."""
    back, ahead = -(-before // least) + 1, -(-after // least) + 1

    def built(pieces: Column, marks: Column) -> Column:
        none = F.lit("")
        # what stands before match i: its own piece, and the pieces and matches before that
        tails = F.transform(pieces, lambda p: right(p, before))
        units = F.zip_with(tails, marks, lambda p, m: F.concat(p, F.coalesce(m, none)))
        heads = F.zip_with(F.transform(pieces, lambda p: left(p, after)), marks, lambda p, m: F.concat(p, F.coalesce(m, none)))
        return let(F.struct(tails.alias("t"), units.alias("u"), heads.alias("h")), lambda s: F.transform(
            marks, lambda m, i: F.struct(
                i.alias("ordinal"), m.alias("mark"),
                right(F.concat(F.array_join(F.slice(s["u"], F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back))), ""),
                               F.get(s["t"], i)), before).alias("before"),
                left(F.array_join(F.slice(s["h"], i + 2, F.lit(ahead)), ""), after).alias("after"))))

    t = F.coalesce(text, F.lit(""))
    return let(F.struct(F.split(t, pattern, -1).alias("p"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m")),
               lambda s: built(s["p"], s["m"]))
