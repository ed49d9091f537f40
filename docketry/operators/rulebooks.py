"""Rule tables: rubric points, fee caps, claim matrices, order comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv


# --- rubric -----------------------------------------------------------------

def criteria_points(count: Column) -> Column:
    out = None
    for low, high, points in fv.CRITERIA_POINTS:
        met = count.between(low, high)
        out = F.when(met, points) if out is None else out.when(met, points)
    return out


def band_percent(points: Column) -> Column:
    out = None
    for low, high, percent in fv.RUBRIC_BANDS:
        met = points.between(low, high)
        out = F.when(met, percent) if out is None else out.when(met, percent)
    return out


def points_to_next_band(points: Column) -> Column:
    lows = F.array(*[F.lit(low) for low, _, _ in fv.RUBRIC_BANDS])
    return F.array_min(F.filter(lows, lambda low: low > points)) - points


def rubric_scores(answers: DataFrame, items: dict[str, int] = fv.RUBRIC_MAX_POINTS) -> DataFrame:
    """Total, band and missing items per subject.

    ``answers(subject, item, points)``: unknown items and points above an
    item's maximum are left out of the total, and an item without a valid
    answer is reported, never counted as zero.
    """
    maximum = F.create_map(*[F.lit(v) for pair in items.items() for v in pair])
    limit = F.try_element_at(maximum, F.col("item"))
    valid = F.col("points").isNotNull() & limit.isNotNull() & F.col("points").between(0, limit)
    per_item = answers.filter(valid).groupBy("subject", "item").agg(F.max("points").alias("points"))
    summed = per_item.groupBy("subject").agg(
        F.sum("points").cast("int").alias("total"), F.collect_set("item").alias("answered")
    )
    names = F.array(*[F.lit(i) for i in items])
    everyone = answers.select("subject").distinct().join(summed, "subject", "left")
    missing = F.array_except(names, F.coalesce("answered", F.lit([]).cast("array<string>")))
    return everyone.select(
        "subject", "total", band_percent(F.col("total")).alias("percent"),
        points_to_next_band(F.col("total")).alias("to_next_band"),
        F.size(missing).alias("missing_items"),
    )


def duration_years(age: Column) -> Column:
    """Years of entitlement; null means permanent."""
    return F.when(age < fv.PERMANENT_AGE, F.lit(fv.TEMPORARY_YEARS))


def compare_raters(answers: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Points of two raters per item, their difference, and whether the totals fall in different bands.

    ``answers(subject, rater, item, points)``.
    """
    sides = answers.groupBy("subject", "item").agg(
        F.max(F.when(F.col("rater") == ours, F.col("points"))).alias("ours"),
        F.max(F.when(F.col("rater") == theirs, F.col("points"))).alias("theirs"),
    )
    totals = sides.groupBy("subject").agg(
        F.sum("ours").cast("int").alias("our_total"), F.sum("theirs").cast("int").alias("their_total")
    )
    crosses = band_percent(F.col("our_total")) != band_percent(F.col("their_total"))
    return sides.withColumn("gap", F.col("ours") - F.col("theirs")).join(
        totals.withColumn("crosses_band", crosses), "subject"
    )


# --- fee caps ---------------------------------------------------------------

def _rates(service: Column, percents: dict[str, str], kind: str = "decimal(5,2)") -> Column:
    """A fixed table as a literal map, so no join deals the claims out by a handful of services."""
    entries = [x for k, v in percents.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*entries), service)


def fee_caps(claims: DataFrame, with_fee: str = "a", without_fee: str = "c") -> DataFrame:
    """Fee caps of every event under both models, in decimals, one row per event.

    ``claims(event_id, service, monthly, eligible_months, months_to_pension,
    grant)``; months are null when there is no limit. Claims of one event count
    as one: their bases are summed first and there is one cap and one opening
    fee. ``with_fee`` and ``without_fee`` name the percent table of each model.
    A service of a fixed amount has that cap under either model. A service
    outside the tables gives null caps and ``uncovered``; an event whose claims
    name different services has no single row of the tables, so its service and
    caps are null and ``mixed`` is set.
    """
    money = "decimal(18,2)"
    months = F.least(
        F.coalesce("eligible_months", F.lit(fv.FEE_MONTHS)),
        F.coalesce("months_to_pension", F.lit(fv.FEE_MONTHS)),
        F.lit(fv.FEE_MONTHS),
    )
    # The average monthly amount times sixty is the amount times its months.
    base = F.col("monthly").cast(money) * months
    named = F.coalesce("service", F.lit(""))
    summed = claims.groupBy("event_id").agg(
        F.min(named).alias("first"), F.max(named).alias("last"),
        F.sum(base).cast(money).alias("pension_base"),
        F.sum(F.col("grant").cast(money)).cast(money).alias("grant_sum"),
    )
    mixed = F.col("first") != F.col("last")
    tables = "abc"
    joined = summed.withColumn("mixed", mixed).withColumn("service", F.when(~mixed, F.col("first")))
    joined = joined.withColumns(
        {
            "p_with": _rates(F.col("service"), {k: v[tables.index(with_fee)] for k, v in fv.PENSION_PERCENT.items()}),
            "p_without": _rates(F.col("service"), {k: v[tables.index(without_fee)] for k, v in fv.PENSION_PERCENT.items()}),
            "g_with": _rates(F.col("service"), {k: v[0] for k, v in fv.GRANT_PERCENT.items()}),
            "g_without": _rates(F.col("service"), {k: v[1] for k, v in fv.GRANT_PERCENT.items()}),
            "fixed": _rates(F.col("service"), fv.FIXED_FEES, money),
        }
    )
    opening = F.lit(fv.OPENING_FEE).cast(money)
    average = F.col("pension_base") / fv.FEE_MONTHS
    extra = F.when(average < F.lit(fv.LOW_BASE).cast(money), opening).otherwise(F.lit(0).cast(money))
    of_pension = F.col("p_with").isNotNull()
    of_grant = F.col("g_with").isNotNull()

    def share(basis: str, rate: str) -> Column:
        return F.bround(F.col(basis) * F.col(rate) / 100, 2).cast(money)

    of_fixed = F.col("fixed").isNotNull()
    return joined.select(
        "event_id", "service", "pension_base", "grant_sum",
        F.when(of_pension, (opening + extra + share("pension_base", "p_with")).cast(money))
        .when(of_grant, (opening + share("grant_sum", "g_with")).cast(money)).when(of_fixed, F.col("fixed")).alias("cap_with_fee"),
        F.when(of_pension, share("pension_base", "p_without"))
        .when(of_grant, share("grant_sum", "g_without")).when(of_fixed, F.col("fixed")).alias("cap_without_fee"),
        (~F.col("mixed") & ~of_pension & ~of_grant & ~of_fixed).alias("uncovered"), "mixed",
    )


# --- claims and orders ------------------------------------------------------

def claim_matrix(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per issue: agreed, disputed, unanswered or raised by the respondent only.

    ``(case_id, issue, amount)`` on both sides, amounts decimal.
    """
    c = claims.groupBy("case_id", "issue").agg(F.sum("amount").alias("claimed"))
    r = responses.groupBy("case_id", "issue").agg(F.sum("amount").alias("answered"))
    status = (
        F.when(F.col("answered").isNull(), "unanswered")
        .when(F.col("claimed").isNull(), "respondent only")
        .when(F.col("claimed") == F.col("answered"), "agreed")
        .otherwise("disputed")
    )
    gap = F.col("claimed") - F.col("answered")
    return c.join(r, ["case_id", "issue"], "full").select(
        "case_id", "issue", "claimed", "answered", status.alias("status"), gap.alias("gap"),
        F.when(F.col("answered") != 0, gap / F.col("answered")).alias("gap_ratio"),
    )


def stage_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Claims dropped or added between two stages."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("change", F.lit("dropped")).unionByName(
        b.join(a, keys, "left_anti").withColumn("change", F.lit("added"))
    )


def compare_with_order(bills: DataFrame, order: DataFrame) -> DataFrame:
    """Applied, claimed and ordered value of the same municipality, year and component.

    A missing order gives a null and ``order missing``, or ``only other years``
    when the municipality has an order of another year for the component; such
    a value is never used. ``claim`` says the same of the claimed value, ``not
    claimed`` where there is none.
    """
    keys = ["municipality", "year", "component"]
    other = order.select("municipality", "component").distinct().withColumn("other", F.lit(True))
    joined = bills.join(order, keys, "left").join(other, ["municipality", "component"], "left")
    flag = (
        F.when(F.col("ordered").isNotNull(), F.when(F.col("applied") == F.col("ordered"), "as ordered").otherwise("differs"))
        .when(F.col("other"), "only other years")
        .otherwise("order missing")
    )
    return joined.select(
        *keys, "applied", "claimed", "ordered", flag.alias("finding"),
        (F.col("applied") - F.col("ordered")).alias("gap"),
        F.when(F.col("claimed").isNull(), "not claimed").when(F.col("ordered").isNull(), "not checkable")
        .when(F.col("claimed") == F.col("ordered"), "as ordered").otherwise("differs").alias("claim"),
    )
