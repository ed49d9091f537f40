"""Statute pages as a table of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import markup_to_text, section_number, unresolved_markup
from docketry.operators.structure import blocks, sections_in_context, source_line, statute_line


def sections(pages: DataFrame, opening=statute_line) -> DataFrame:
    """Sections with number, title, heading context, readable text and source line.

    ``pages(title, wikitext, revid, timestamp, url)``. ``unresolved`` marks a
    text in which markup remains, as when braces do not balance.
    """
    keyed = pages.withColumnRenamed("title", "page_title")
    found = sections_in_context(keyed, "page_title", "wikitext", opening, keep=("revid", "timestamp", "url"))
    described = found.withColumn("readable", markup_to_text(F.col("body")))
    anchor = F.concat(F.lit("סעיף "), F.col("num"))
    return described.select(
        "page_title", "pos", section_number(F.col("num")).alias("num"), F.col("title").alias("heading"), "amend", "context",
        F.col("readable").alias("body_text"), unresolved_markup(F.col("readable")).alias("unresolved"),
        source_line(F.col("url"), anchor, F.col("timestamp"), F.col("revid")).alias("source"),
    )


def table_of_contents(pages: DataFrame, opening=statute_line, with_sections: bool = False) -> DataFrame:
    """Titled headings (and sections, if asked) in page order with their indent."""
    rows = blocks(pages.withColumnRenamed("title", "page_title"), "page_title", "wikitext", opening)
    heading = (F.col("kind") == "heading") & (F.length("title") > 0)
    kept = rows.filter(heading | (F.lit(with_sections) & (F.col("kind") == "section")))
    indent = F.when(F.col("kind") == "heading", F.col("level") - 2).otherwise(3)
    line = F.when(F.col("kind") == "heading", F.col("title")).otherwise(F.concat_ws(". ", "num", "title"))
    return kept.select("page_title", "pos", indent.alias("indent"), line.alias("line"))
