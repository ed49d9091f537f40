"""Blocks, sections, heading context and revisions of markup pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.arrays import let, lines_of, stretch
from docketry.functions.text import expand_templates, section_number, strip_markup

BLOCK = "struct<kind:string,level:int,num:string,title:string,amend:string>"


def statute_line(line: Column) -> Column:
    """Block opened by a line of statute markup, or null.

    Arguments are the parts of the opening template between top-level bars,
    without the named ones. Templates and links inside it are rendered first,
    however deep; what then stands before the first closing braces is its own.
    """
    name = F.regexp_extract(line, fv.MARKUP_BLOCK_START, 1)
    inside = expand_templates(F.when(F.length(name) > 0, F.substring(line, F.lit(3), F.length(line))))
    flat = F.regexp_extract(inside, r"^([^{}]*)\}\}", 1)
    parts = F.filter(F.split(flat, r"\|", -1), lambda p, i: i > 0)
    positional = F.filter(parts, lambda p: ~p.rlike(rf"(?U)^{fv.MARKUP_NAMED_ARGUMENT}"))

    def arg(p: Column, i: int) -> Column:
        return F.coalesce(F.get(p, F.lit(i)), F.lit(""))

    def build(p: Column) -> Column:
        heading = name.rlike("^" + fv.MARKUP_HEADING)
        return F.struct(
            F.when(heading, "heading").otherwise("section").alias("kind"),
            F.when(heading, F.substring(name, -1, 1).try_cast("int")).alias("level"),
            F.trim(arg(p, 0)).alias("num"),
            strip_markup(arg(p, 1)).alias("title"),
            F.when(~heading, strip_markup(arg(p, 2))).alias("amend"),
        )

    return F.when(F.length(name) > 0, let(positional, build))


def _context(starts: Column, at: Column, levels: tuple[int, ...]) -> Column:
    """Titles of the headings above the block number ``at`` (from 0), outermost first.

    A heading clears the deeper ones before it: the last titled heading of a
    level counts while no shallower one is newer.
    """
    numbered = F.transform(starts, lambda x, k: F.struct(k.alias("k"), x["b"]["kind"].alias("kind"), x["b"]["level"].alias("level"), x["b"]["title"].alias("title")))
    above = F.filter(numbered, lambda h: (h["k"] < at) & (h["kind"] == "heading") & (F.length(h["title"]) > 0))

    def at_level(level: int) -> Callable[[Column], Column]:
        return lambda h: h["level"] == level

    def chain(headings: Column) -> Column:
        newest, titles = F.lit(-1), []
        for level in levels:
            last = F.try_element_at(F.filter(headings, at_level(level)), F.lit(-1))
            k = F.coalesce(last["k"], F.lit(-1))
            titles.append(F.when(k > newest, last["title"]))
            newest = F.greatest(newest, k)
        return F.array_compact(F.array(*titles))

    return let(above, chain)


def blocks(
    pages: DataFrame, key: str, text: str, opening: Callable[[Column], Column] = statute_line, levels: tuple[int, ...] = (), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Blocks of every page: from each opening line to the next, text before the first left out.

    Everything happens inside the page's row: opening lines are found once,
    each block takes its slice of the line array. With ``levels`` sections also
    get the titles of the headings above them; ``keep`` names columns of the
    page that go along.
    """

    def cut(lines: Column) -> Column:
        opened = F.transform(lines, lambda line, i: F.struct(i.alias("at"), opening(line).alias("b")))
        starts = F.filter(opened, lambda x: x["b"].isNotNull())
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda x, k: F.struct(
                    (k + 1).alias("pos"),
                    x["b"]["kind"].alias("kind"), x["b"]["level"].alias("level"), x["b"]["num"].alias("num"),
                    x["b"]["title"].alias("title"), x["b"]["amend"].alias("amend"),
                    *([F.when(x["b"]["kind"] == "section", _context(s, k, levels)).alias("context")] if levels else []),
                    F.array_join(
                        stretch(lines, x["at"], F.coalesce(F.get(s, k + 1)["at"], F.size(lines)) - x["at"]), "\n"
                    ).alias("body"),
                ),
            ),
        )

    cut_pages = pages.select(key, *keep, F.explode(let(lines_of(F.col(text)), cut)).alias("b"))
    return cut_pages.select(key, *keep, "b.*")


def sections_in_context(
    pages: DataFrame, key: str, text: str, opening: Callable[[Column], Column] = statute_line, levels: tuple[int, ...] = (2, 3, 4, 5),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Sections with the titles of the headings above them, outermost first; one scan, nothing is shuffled."""
    return blocks(pages, key, text, opening, levels, keep).filter(F.col("kind") == "section")


def near_sections(sections: DataFrame, key: str, wanted: str, limit: int = fv.NEAR_SECTION_LIMIT) -> DataFrame:
    """The exact section of each page, else those with the same leading number, else the same two characters.

    Every page keeps its own best kind of hit; at most ``limit`` near numbers
    are listed per page, in section order.
    """
    number = section_number(F.col("num"))
    want = wanted.strip().rstrip(". ")
    digits = F.regexp_extract(F.lit(want), r"^\d+", 0)
    prefix = F.when(F.length(digits) > 0, digits).otherwise(F.substring(F.lit(want), 1, 2))
    grade = (
        F.when(number == want, 1)
        .when(F.startswith(number, prefix), 2)
        .when(F.startswith(number, F.substring(prefix, 1, 2)), 3)
    )
    graded = sections.withColumn("grade", grade).filter(F.col("grade").isNotNull())
    best = graded.groupBy(key).agg(F.min("grade").alias("best"))
    kept = graded.join(best, key).filter(F.col("grade") == F.col("best"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    return ranked.filter((F.col("grade") == 1) | (F.col("rank") <= limit)).select(key, "pos", "num", "grade")


def latest_revision(revisions: DataFrame, key: str, as_of: Column, days: int = fv.FRESH_DAYS) -> DataFrame:
    """Newest revision of every title, and whether it is younger than ``days``."""
    values = [c for c in revisions.columns if c not in (key, "timestamp")]
    newest = revisions.groupBy(key).agg(F.max(F.struct("timestamp", *values)).alias("m")).select(key, "m.*")
    fresh = F.col("timestamp") > as_of - F.expr(f"interval {days} days")
    return newest.withColumn("fresh", fresh)


def source_line(url: Column, anchor: Column, day: Column, revision: Column) -> Column:
    """Where a section comes from: address with anchor, version date, revision."""
    at = F.concat(F.lit("#"), F.url_encode(F.regexp_replace(anchor, " ", "_")))
    return F.format_string(
        "מקור: %s | ויקיטקסט, גרסה מיום %s (revid %s)",
        F.concat(url, F.coalesce(at, F.lit(""))), F.date_format(day, "yyyy-MM-dd"), revision.cast("string"),
    )


