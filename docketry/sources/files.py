"""File listings and stable document keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def list_files(
    spark: SparkSession,
    root: str,
    extensions: list[str] | None = None,
    skipped_folders: list[str] = fv.INTERNAL_FOLDERS,
) -> DataFrame:
    """Every file below ``root``: path, name, extension, size, change time.

    Only the listing is read: the content column is never selected.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    # Paths come back as URIs, whatever scheme the root was given with.
    tail = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    relative = F.regexp_replace("path", rf"^.*?\Q{tail}\E/", "")
    files = listed.select(
        relative.alias("rel_path"),
        base_name(relative).alias("filename"),
        extension(relative).alias("ext"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )
    names = "|".join(rf"\Q{s}\E" for s in skipped_folders)
    files = files.filter(~F.col("rel_path").rlike(rf"(^|/)({names})/"))
    return files.filter(F.col("ext").isin(*extensions)) if extensions else files


def document_key(rel_path: Column, short: bool = False) -> Column:
    """Cleaned stem and a hash of the relative path.

    The short form keeps six hex characters for display; it is not unique over
    a large corpus.
    """
    safe = F.trim(F.regexp_replace(stem(rel_path), r"(?U)[^\w֐-׿ .()\-]", "_"))
    named = F.when(F.length(safe) == 0, F.lit("doc")).otherwise(safe)
    digest = F.sha1(rel_path.cast("binary"))
    return F.concat_ws("__", named, F.substring(digest, 1, 6) if short else digest)
