"""Holdings, citations and their validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.operators import ordered


def lookup(holdings: DataFrame, term: str, subject: str, tag: str) -> DataFrame:
    """Matching holdings with the cheapest layer that finds them.

    Layer 1 is the name, 2 the subject, 3 a tag; entries that nobody verified
    are always layer 4.
    """
    name_hit = F.contains(F.col("name"), F.lit(term))
    layer = (
        F.when((F.col("status") == "unverified") & name_hit, 4)
        .when(F.col("status") == "unverified", None)
        .when(name_hit, 1)
        .when(F.col("subject") == subject, 2)
        .when(F.array_contains("tags", tag), 3)
    )
    return holdings.withColumn("layer", layer).filter(F.col("layer").isNotNull())


def view_conditions(as_of: Column) -> dict[str, Column]:
    """The nine saved views as conditions; a holding never checked is not stale."""
    holding = F.col("type") == "holding"
    checked = F.col("citations_checked")
    return {
        "all": holding,
        "approved": holding & (F.col("status") == "approved"),
        "pending": holding & (F.col("status") == "pending"),
        "negative": holding & (F.col("negative_treatment") == "yes"),
        "unchecked": holding & checked.isNull(),
        "stale": holding & (F.datediff(as_of, checked) > fv.STALE_DAYS),
        "tracking": F.col("type") == "tracking",
        "by_decision": holding & F.col("decision").isNotNull(),
        "cards": holding,
    }


def saved_views(holdings: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {name: holdings.filter(condition) for name, condition in view_conditions(as_of).items()}


def view_sizes(holdings: DataFrame, as_of: Column) -> DataFrame:
    """Rows of every view from one pass over the holdings."""
    views = view_conditions(as_of)
    counted = holdings.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in views.items()])
    return counted.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.col(n).alias("n_rows")) for n in views])).alias("v")
    ).select("v.*")


def citation_status(decisions: DataFrame, citers: DataFrame, negative: list[str] = fv.NEGATIVE_TREATMENTS) -> DataFrame:
    """Citing count and negative treatment of each decision.

    ``citers(decision, citer, treatment)`` with a null treatment for a citer
    nobody read. A negative one makes ``yes``; ``no`` needs every found citer
    read; everything else, also no citers found, stays ``unknown``.
    """
    seen = citers.groupBy("decision").agg(
        F.count(F.lit(1)).alias("citing"),
        F.bool_or(F.coalesce(F.col("treatment").isin(*negative), F.lit(False))).alias("hit"),
        F.bool_and(F.col("treatment").isNotNull()).alias("all_read"),
    )
    flag = F.when(F.col("hit"), "yes").when(F.col("all_read"), "no").otherwise("unknown")
    return decisions.select("decision").distinct().join(seen, "decision", "left").select(
        "decision", F.coalesce("citing", F.lit(0)).alias("citations_count"), flag.alias("negative_treatment")
    )


def reading_order(citers: DataFrame, national: list[str]) -> DataFrame:
    """Rank of each citer per decision: national court first, later first, discussion before list.

    ``citers(decision, citer, court, day, is_list)``; ``day`` counts days, and
    cuts a decision that is cited very often into parallel pieces.
    """
    court_rank = F.when(F.col("court").isin(*national), 0).otherwise(1)
    kind_rank = F.col("is_list").cast("int")
    ranked = citers.withColumn("court_rank", court_rank).withColumn("kind_rank", kind_rank)
    order = [F.col("court_rank"), F.col("day").desc(), F.col("kind_rank"), F.col("citer")]
    chunk = F.struct("court_rank", F.col("day").isNull(), -F.floor(F.col("day") / 7))
    return ordered.position(ranked, ["decision"], order, chunk, "reading_rank").drop("court_rank", "kind_rank")


def merge_citers(lists: list[DataFrame], exclude: DataFrame | None = None) -> DataFrame:
    """Union of result lists, one row per decision and citing case, without the decision itself."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.filter(F.col("citer") != F.col("decision")).groupBy("decision", "citer").agg(
        F.count(F.lit(1)).alias("found_in")
    )


def holding_flags(holdings: DataFrame, citers: DataFrame, negative: list[str] = fv.NEGATIVE_TREATMENTS) -> DataFrame:
    """Negative treatment of every holding: ``yes`` only for the holding that was hit.

    ``holdings(holding_id, decision)``; ``citers(decision, citer, treatment,
    holding_id)``, the last being the holding a citer speaks of, null for the
    decision as a whole. ``checked`` tells whether the decision was searched at
    all; a holding that was not hit is ``no`` only when every citer of its
    decision was read and none speaks against the decision as a whole.
    """
    against = F.coalesce(F.col("treatment").isin(*negative), F.lit(False))
    per_decision = citers.groupBy("decision").agg(
        F.bool_and(F.col("treatment").isNotNull()).alias("all_read"),
        F.bool_or(against & F.col("holding_id").isNull()).alias("whole"),
    )
    hit = citers.filter(against & F.col("holding_id").isNotNull()).select("decision", "holding_id").distinct().withColumn("hit", F.lit(True))
    joined = holdings.select("holding_id", "decision").join(per_decision, "decision", "left").join(hit, ["decision", "holding_id"], "left")
    flag = F.when(F.col("hit"), "yes").when(F.col("all_read") & ~F.col("whole"), "no").otherwise("unknown")
    return joined.select("holding_id", "decision", F.col("all_read").isNotNull().alias("checked"), flag.alias("negative_treatment"))


def authority_pack(holdings: DataFrame, tiers: list[tuple[int, str]]) -> DataFrame:
    """Holdings by tier in fixed order, source trust and validity as separate columns.

    Every tier shows: an empty one keeps a row without a holding. The tiers are
    a short fixed list and travel with the expression.
    """
    validity = (
        F.when(F.col("negative_treatment") == "yes", "negative")
        .when(F.col("citations_checked").isNull(), "unchecked")
        .otherwise("checked")
    )
    source = F.when(F.col("status") == "unverified", "index entry").otherwise("read in the decision")
    number = F.try_element_at(F.create_map(*[F.lit(v) for tier, name in tiers for v in (name, tier)]), F.col("status"))
    held = holdings.withColumn("tier", number).filter("tier is not null").select(
        "tier", F.col("status").alias("tier_name"), "holding_id", source.alias("source_trust"), validity.alias("validity")
    )
    listed = holdings.sparkSession.createDataFrame(tiers, "tier int, tier_name string")
    empty = listed.join(held.select("tier").distinct(), "tier", "left_anti")
    blank = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("holding_id", "source_trust", "validity")]
    return held.unionByName(empty.select("tier", "tier_name", *blank))


def internal_references(paragraphs: DataFrame, pattern: str) -> DataFrame:
    """Renumbered paragraphs and whether each internal reference falls on one.

    ``paragraphs(doc_key, paras array)``, the non-empty paragraphs of a document
    in order; number and check need nothing outside the row.
    """
    refs = F.flatten(
        F.transform(
            "paras",
            lambda p, i: F.transform(
                F.regexp_extract_all(p, F.lit(pattern), F.lit(1)),
                lambda r: F.struct((i + 1).alias("in_paragraph"), r.try_cast("int").alias("refers_to")),
            ),
        )
    )
    rows = paragraphs.select("doc_key", F.size("paras").alias("n_paragraphs"), F.explode(refs).alias("r"))
    return rows.select(
        "doc_key", "n_paragraphs", "r.in_paragraph", "r.refers_to",
        F.coalesce(F.col("r.refers_to").between(1, F.col("n_paragraphs")), F.lit(False)).alias("confirmed"),
    )
