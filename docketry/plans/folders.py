"""Did a reorganised folder keep every file?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv


def lost_files(source: DataFrame, result: DataFrame) -> DataFrame:
    """Source files without a counterpart of the same size and content.

    ``(rel_path, ext, length, content)`` on both sides. Contents are hashed where
    they are read and never move; what remains meets the sizes once more for the
    reason. Files made along the way do not count.
    """
    digest = F.sha2(F.col("content").cast("binary"), 256).alias("digest")
    wanted = source.filter(~F.col("ext").isin(*fv.DERIVED_EXTENSIONS)).select("rel_path", "length", digest)
    there = result.select("length", digest).groupBy("length", "digest").agg(F.lit(1).alias("there"))
    lost = wanted.join(there, ["length", "digest"], "left_anti").select("rel_path", "length")
    sizes = result.select("length").distinct().withColumn("sized", F.lit(True))
    reason = F.when(F.col("sized"), "content differs").otherwise("no file of this size")
    return lost.join(sizes, "length", "left").select("rel_path", reason.alias("reason"))


def folder_findings(
    source: DataFrame, result: DataFrame, text_chars: DataFrame, summary_part: str | None = None
) -> DataFrame:
    """Findings of the four checks: completeness, clean root, text layer, summary document.

    ``text_chars(rel_path, chars)`` tells how much text each PDF carries; a
    null means it could not be checked, which stays a warning, never a pass.
    """
    def rows(df: DataFrame, check: str, severity: str, detail) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col("rel_path").alias("subject"), detail.alias("detail")
        )

    lost = rows(lost_files(source, result), "1-completeness", "RED", F.col("reason"))
    listed = result.select("rel_path", "ext")
    in_root = listed.filter(~F.col("rel_path").rlike(r"[\\/]") & ~F.col("ext").isin(*fv.DERIVED_EXTENSIONS))
    name = F.regexp_extract("rel_path", r"([^/\\]*)$", 1)
    if summary_part:
        in_root = in_root.filter(~F.contains(name, F.lit(summary_part)))
    loose = rows(in_root, "2-root", "RED", F.lit("left unsorted in the root"))
    pdfs = listed.filter(F.col("ext") == ".pdf").join(text_chars, "rel_path", "left")
    bare = rows(pdfs.filter(F.col("chars") < fv.TEXT_PAGE_CHARS), "3-textlayer", "RED", F.lit("no text layer"))
    unknown = (
        pdfs.filter(F.col("chars").isNull()).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        .select(
            F.lit("3-textlayer").alias("check"), F.lit("ORANGE").alias("severity"), F.lit("").alias("subject"),
            F.format_string("%d not checked", F.col("n")).alias("detail"),
        )
    )
    out = lost.unionByName(loose).unionByName(bare).unionByName(unknown)
    if summary_part:
        missing = (
            listed.agg(F.count_if(F.contains(name, F.lit(summary_part))).alias("n")).filter("n = 0")
            .select(
                F.lit("4-summary").alias("check"), F.lit("RED").alias("severity"), F.lit(summary_part).alias("subject"),
                F.lit("summary document not found").alias("detail"),
            )
        )
        out = out.unionByName(missing)
    return out
