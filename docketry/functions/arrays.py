"""Array helpers that keep work inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stretch(items: Column, first: Column, size: Column) -> Column:
    """``size`` elements (at least one) from position ``first``, counted from 0.

    Reads just those elements; the built-in slice unpacks the whole array every
    time, which adds up when many slices are taken from one long array.
    """
    return F.transform(F.sequence(first, first + size - 1), lambda k: F.get(items, k))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def characters_of(text: Column) -> Column:
    """One array element per code point."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """``array<struct<match, start, before, after>>``; ``start`` counts from 0.

    The text between two matches comes from splitting on the same pattern, so
    offsets are running sums of piece lengths. Meant for one line at a time.
    """
    empty = F.lit([]).cast("array<struct<match:string,start:int>>")

    def walk(found: Column, gaps: Column) -> Column:
        folded = F.aggregate(
            F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(x["m"].alias("match"), (acc["at"] + F.length(x["g"])).alias("start"))),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return folded

    return let(matches(text, pattern), lambda found: let(F.split(text, pattern, -1), lambda gaps: walk(found, gaps)))


def around(text: Column, start: Column, length: Column, reach: int) -> Column:
    """The text from ``reach`` characters before a match to ``reach`` after it."""
    begin = F.greatest(F.lit(0), start - reach)
    return F.substring(text, begin + 1, start + length + reach - begin)


def any_of(value: Column, options: list[str]) -> Column:
    """True when ``value`` contains at least one of the literal ``options``."""
    hit = F.lit(False)
    for option in options:
        hit = hit | F.contains(value, F.lit(option))
    return hit
