"""Inclusion checks between tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from docketry import fixed_values as fv


@dataclass(frozen=True)
class Relation:
    child: str
    child_column: str
    parent: str
    parent_column: str


def plain_name(column: str) -> str:
    """Column name without a one or two letter table prefix."""
    return re.sub(r"^[a-z]{1,2}_", "", column)


def candidate_relations(
    tables: dict[str, DataFrame], primary_keys: dict[str, str], skip: str = fv.BACKUP_TABLE_PATTERN
) -> list[Relation]:
    """Numeric columns named like another table's single-column primary key."""
    parents = {t: c for t, c in primary_keys.items() if not re.search(skip, t)}
    found = []
    for child, df in tables.items():
        if re.search(skip, child):
            continue
        for field in df.schema.fields:
            if not isinstance(field.dataType, NumericType):
                continue
            for parent, key in parents.items():
                if parent != child and plain_name(field.name) == plain_name(key):
                    found.append(Relation(child, field.name, parent, key))
    return found


DECIMAL_KEY = "decimal(38,6)"  # in which whole and decimal keys compare alike


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def inclusion_report(tables: dict[str, DataFrame], relations: list[Relation]) -> DataFrame:
    """Rows, filled, distinct and orphan counts of every relation whose child has rows.

    A child is read once for all its columns and reduced to counted keys before
    it meets the parents, so the join carries each key once however often it
    occurs. Keys are compared as numbers: as longs where both sides are whole, as decimals
    elsewhere.
    """
    whole = [r for r in relations if all(isinstance(tables[t].schema[c].dataType, IntegralType) for t, c in ((r.child, r.child_column), (r.parent, r.parent_column)))]
    rest = [r for r in relations if r not in whole]
    return _union([_inclusion(tables, own, key) for own, key in ((whole, "long"), (rest, DECIMAL_KEY)) if own])


def _inclusion(tables: dict[str, DataFrame], relations: list[Relation], key_type: str) -> DataFrame:
    counted = []
    for child in dict.fromkeys(r.child for r in relations):
        columns = list(dict.fromkeys(r.child_column for r in relations if r.child == child))
        pairs = F.array(*[F.struct(F.lit(c).alias("child_column"), F.col(c).cast(key_type).alias("k")) for c in columns])
        rows = tables[child].select(F.explode(pairs).alias("p")).select("p.*")
        counted.append(rows.groupBy("child_column", "k").agg(F.count(F.lit(1)).alias("n")).withColumn("child", F.lit(child)))
    parents = dict.fromkeys((r.parent, r.parent_column) for r in relations)
    known = [
        tables[p].select(F.lit(p).alias("parent"), F.lit(c).alias("parent_column"), F.col(c).cast(key_type).alias("k")).distinct() for p, c in parents
    ]
    targets = F.create_map(
        *[
            v for child, column in dict.fromkeys((r.child, r.child_column) for r in relations) for v in (
                F.lit(f"{child}.{column}"),
                F.array(*[
                    F.struct(F.lit(r.parent).alias("parent"), F.lit(r.parent_column).alias("parent_column"))
                    for r in relations if (r.child, r.child_column) == (child, column)
                ]),
            )
        ]
    )
    every = _union(counted).withColumn("t", F.explode(F.element_at(targets, F.concat_ws(".", "child", "child_column"))))
    met = every.select("child", "child_column", "t.*", "k", "n").join(
        _union(known).withColumn("known", F.lit(True)), ["parent", "parent_column", "k"], "left"
    )
    filled = F.col("k").isNotNull() & (F.col("k") != 0)
    return met.groupBy("child", "child_column", "parent").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"),
        F.count_if(filled).alias("distinct_values"),
        F.coalesce(F.sum(F.when(filled & F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
    )


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Filled child keys without a parent, with their row counts."""
    filled = child.filter(F.col(child_key).isNotNull() & (F.col(child_key) != 0))
    keys = filled.groupBy(F.col(child_key).alias("orphan_key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return keys.join(parent, keys["orphan_key"] == parent[parent_key], "left_anti")


def verify_stored_files(acts: DataFrame, files: DataFrame) -> DataFrame:
    """Acts whose file is missing, or whose file stem is not identifier followed by text.

    ``acts(act_id, act_text, doc_path)``, ``files(doc_path)``.
    """
    from docketry.sources.files import stem

    present = files.select("doc_path").distinct().withColumn("file_present", F.lit(True))
    checked = acts.join(present, "doc_path", "left").select(
        "act_id",
        (stem(F.col("doc_path")) == F.concat(F.col("act_id").cast("string"), F.col("act_text"))).alias("name_ok"),
        F.coalesce("file_present", F.lit(False)).alias("file_present"),
    )
    return checked.filter(~F.col("name_ok") | ~F.col("file_present"))


# --- mergeable profiles -----------------------------------------------------

PROFILE = "path string, length long, modified timestamp, column string, n_rows long, filled long, sketch binary"


def _present_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a table as they are now; only metadata is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.filter(F.col("path").endswith(".parquet")).select("path", "length", F.col("modificationTime").alias("modified"))


def profile_new_files(spark: SparkSession, path: str, store: str) -> int:
    """Profile the files of a Parquet table that the store does not know, and return how many.

    Per file and column: rows, filled values and a sketch of the distinct ones. A file
    that was replaced under its name is new.
    """
    spark.createDataFrame([], PROFILE).write.mode("ignore").parquet(store)
    known = spark.read.schema(PROFILE).parquet(store).select("path", "length", "modified").distinct()
    fresh = _present_files(spark, path).join(known, ["path", "length", "modified"], "left_anti").collect()
    if not fresh:
        return 0
    rows = spark.read.parquet(*[r.path for r in fresh])
    facts = [
        F.struct(
            F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(F.col(f"`{f.name}`")).alias("filled"),
            F.hll_sketch_agg(F.col(f"`{f.name}`").cast("string")).alias("sketch"),
        )
        for f in rows.schema.fields
    ]
    counted = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.array(*facts).alias("facts"))
    listed = spark.createDataFrame(fresh, "path string, length long, modified timestamp")
    named = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the two listings write the scheme differently
    met = counted.select(named(F.col("path")).alias("name"), F.explode("facts").alias("f")).join(listed.withColumn("name", named(F.col("path"))), "name")
    met.select("path", "length", "modified", "f.*").write.mode("append").parquet(store)
    return len(fresh)


def merged_profile(spark: SparkSession, path: str, store: str) -> DataFrame:
    """``column, n_rows, filled, about_distinct`` of the files that the table has now, from their profiles alone."""
    held = spark.read.schema(PROFILE).parquet(store).join(_present_files(spark, path), ["path", "length", "modified"], "left_semi")
    return held.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about_distinct")
    )
