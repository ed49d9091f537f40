"""Page and unit splitting, inside one document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.arrays import let, lines_of, matches


def pages_by_feed(text: Column) -> Column:
    """``array<struct<page, text>>`` split on form feeds."""
    return F.transform(F.split(text, "\f", -1), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))


def pages_by_marker(text: Column, marker: str = fv.PAGE_MARKER) -> Column:
    """``array<struct<page, text>>`` split on numbered markers.

    No marker gives one page numbered 1; text before the first marker is left
    out; of equal numbers the last one counts.
    """

    def numbered(numbers: Column) -> Column:
        bodies = F.slice(F.split(text, marker, -1), F.lit(2), F.size(numbers))
        paired = F.zip_with(
            numbers, bodies, lambda n, b: F.struct(n.cast("int").alias("page"), b.alias("text"))
        )
        ordered = F.array_sort(
            F.transform(
                paired, lambda x, i: F.struct(x["page"].alias("page"), i.alias("at"), x["text"].alias("text"))
            )
        )
        last_of_page = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, i: (i == F.size(s) - 1) | (F.coalesce(F.get(s, i + 1)["page"], F.lit(-1)) != x["page"]),
            ),
        )
        return F.transform(last_of_page, lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text")))

    whole = F.array(F.struct(F.lit(1).alias("page"), text.alias("text")))
    return let(matches(text, marker, 1), lambda n: F.when(F.size(n) == 0, whole).otherwise(numbered(n)))


def explode_pages(documents: DataFrame, key: str, pages: Column) -> DataFrame:
    return documents.select(key, F.explode(pages).alias("p")).select(key, "p.page", "p.text")


def units_of(text: Column, limit: int = fv.UNIT_CHARS, marker: str = fv.UNIT_PAGE_MARKER) -> Column:
    """Reading units of a text: its marked pages, else lines packed up to ``limit`` characters.

    The fold touches each line once; the growing unit never exceeds the limit,
    and the list of finished units is extended only when a unit closes.
    """
    empty = F.lit([]).cast("array<string>")

    def marked(heads: Column) -> Column:
        gaps = F.split(text, marker, -1)
        bodies = F.zip_with(heads, F.slice(gaps, F.lit(2), F.size(heads)), lambda h, b: F.concat(h, b))
        first = F.regexp_replace(F.get(gaps, F.lit(0)), r"(?U)^\s+|\s+$", "")
        with_head = F.transform(
            bodies,
            lambda b, i: F.when((i == 0) & (F.length(first) > 0), F.concat(first, F.lit("\n"), b)).otherwise(b),
        )
        trimmed = F.transform(with_head, lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))
        return F.filter(trimmed, lambda b: F.length(b) > 0)

    # A line over the limit is cut into full pieces and a remainder of 1..limit characters.
    def cut(line: Column) -> Column:
        full = F.greatest(F.lit(0), F.ceil(F.length(line) / F.lit(limit)).cast("int") - 1)
        at = F.sequence(F.lit(0), full)
        return F.transform(
            at,
            lambda i: F.struct(
                F.substring(line, i * limit + 1, F.lit(limit)).alias("t"), (i < full).alias("full")
            ),
        )

    pieces = F.flatten(F.transform(lines_of(text), cut))

    def step(acc: Column, piece: Column) -> Column:
        flush = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + F.length(piece["t"]) + 1 > limit)
        done = F.when(flush, F.concat(acc["units"], F.array(acc["cur"]))).otherwise(acc["units"])
        kept = F.when(flush, F.lit("")).otherwise(acc["cur"])
        return F.struct(
            F.when(piece["full"], F.concat(done, F.array(piece["t"]))).otherwise(done).alias("units"),
            F.when(piece["full"], kept).otherwise(F.concat(kept, piece["t"], F.lit("\n"))).alias("cur"),
        )

    packed = F.aggregate(
        pieces,
        F.struct(empty.alias("units"), F.lit("").alias("cur")),
        step,
        lambda acc: F.when(
            acc["cur"].rlike(r"(?U)\S"), F.concat(acc["units"], F.array(acc["cur"]))
        ).otherwise(acc["units"]),
    )
    chosen = let(matches(text, marker), lambda heads: F.when(F.size(heads) > 0, marked(heads)).otherwise(packed))
    return let(chosen, lambda u: F.when(F.size(u) == 0, F.array(F.lit(""))).otherwise(u))


def unit_table(documents: DataFrame, key: str, text: str, limit: int = fv.UNIT_CHARS) -> DataFrame:
    exploded = documents.select(key, F.posexplode(units_of(F.col(text), limit)).alias("i", "text"))
    return exploded.select(key, (F.col("i") + 1).alias("n"), F.lit("text").alias("kind"), "text")


def slice_pages(pages: Column, first: int, last: int) -> Column:
    """Pages ``first``..``last`` of a page array with a local number from 1."""
    kept = F.filter(pages, lambda p: p["page"].between(first, last))
    return F.transform(
        kept,
        lambda p, i: F.struct(
            (i + 1).alias("local_page"), p["page"].alias("source_page"), p["text"].alias("text")
        ),
    )


def page_header(local_page: Column, source_page: Column) -> Column:
    return F.format_string("===== עמוד %d (עמוד %d במקור) =====", local_page, source_page)
