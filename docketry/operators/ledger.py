"""Reading ledger, single-use codes and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.operators import ordered
from docketry.operators.joining import shuffled


def first_uses(confirms: DataFrame) -> DataFrame:
    """The first confirmation of every code pair; later ones are reuse."""
    return confirms.groupBy("code_a", "code_b").agg(F.min("ts").alias("ts"))


def judged_confirms(issued: DataFrame, confirms: DataFrame) -> DataFrame:
    """Each confirmation as ``accepted``, ``reused`` or ``mismatch``.

    ``confirms(confirm_id, code_a, code_b, ts)``; equal times go by identifier.
    The first use comes from a partial aggregate, so a code that is confirmed
    very often needs no window.
    """
    first = confirms.groupBy("code_a", "code_b").agg(F.min(F.struct("ts", "confirm_id")).alias("first"))
    known = issued.select("code_a", "code_b").distinct().withColumn("known", F.lit(True))
    codes = first.join(known, ["code_a", "code_b"], "left")
    outcome = (
        F.when(F.col("known").isNull(), "mismatch")
        .when(F.col("first.confirm_id") == F.col("confirm_id"), "accepted")
        .otherwise("reused")
    )
    return confirms.join(codes, ["code_a", "code_b"]).select("confirm_id", "code_a", "code_b", "ts", outcome.alias("outcome"))


def read_units(units: DataFrame, issued: DataFrame, confirms: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """Units with how they were read: ``text``, ``vision`` or null.

    ``units(doc_id, n, kind, text)``, ``issued(code_a, code_b, doc_id, units)``,
    ``vision(doc_id, n, text)``. A code covers text units only; a vision note
    counts for a vision unit and needs at least 30 characters.
    """
    confirmed = issued.join(first_uses(confirms), ["code_a", "code_b"]).select(
        "doc_id", F.explode("units").alias("n"), "ts"
    )
    marks = confirmed.groupBy("doc_id", "n").agg(F.min("ts").alias("ts"))
    out = units.join(shuffled(marks), ["doc_id", "n"], "left").withColumn(
        "how", F.when((F.col("kind") == "text") & F.col("ts").isNotNull(), "text")
    )
    if vision is not None:
        seen = (
            vision.filter(F.length(F.trim("text")) >= fv.VISION_MIN_CHARS)
            .select("doc_id", "n").distinct().withColumn("seen", F.lit(True))
        )
        out = out.join(seen, ["doc_id", "n"], "left").withColumn(
            "how", F.coalesce("how", F.when((F.col("kind") == "vision") & F.col("seen"), "vision"))
        ).drop("seen")
    return out.drop("ts")


def refused_shows(shows: DataFrame, units: DataFrame, limit: int = fv.READ_LIMIT_CHARS) -> DataFrame:
    """Requested ranges and why they are refused: outside the document, or too long for one reading.

    ``shows(show_id, doc_id, first, last)``. A range is followed up only as far
    as its document has units, however far it was asked.
    """
    extent = units.groupBy("doc_id").agg(F.max("n").alias("__last"))
    inside = shows.filter("first >= 1 and first <= last").join(shuffled(extent), "doc_id").filter("last <= __last")
    asked = inside.select("show_id", "doc_id", "first", "last", F.explode(F.sequence("first", "last")).alias("n"))
    sized = asked.join(units.select("doc_id", "n", F.length("text").alias("chars")), ["doc_id", "n"], "left")
    totals = sized.groupBy("show_id").agg(
        F.sum("chars").alias("chars"), F.bool_or(F.col("chars").isNull()).alias("outside")
    )
    reason = (
        F.when(F.coalesce("outside", F.lit(True)), "bad range")
        .when((F.col("chars") > limit) & (F.col("last") > F.col("first")), "too long")
    )
    return shows.join(totals, "show_id", "left").select("show_id", "doc_id", "first", "last", reason.alias("refused"))


def coverage(ledger: DataFrame) -> DataFrame:
    """Units, read units, missing ranges and the gate of every document.

    ``ledger(doc_id, n, how)``; the gate passes only when every unit is read.
    """
    counts = ledger.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("how").isNotNull()).alias("read_units"),
        F.bool_and(F.col("how").isNotNull()).alias("passes"),
    )
    missing = ordered.ranges(ledger.filter(F.col("how").isNull()), ["doc_id"], "n", "missing")
    return counts.join(missing, "doc_id", "left")


def judged_applies(previews: DataFrame, applies: DataFrame, minutes: int = fv.TOKEN_MINUTES) -> DataFrame:
    """Each apply as ``applied``, ``expired`` or ``unknown or used``.

    ``previews(token, ts)``, ``applies(apply_id, token, ts)``. A token is spent
    by its first apply after the preview, also when that one comes too late.
    """
    issued = previews.groupBy("token").agg(F.min("ts").alias("issued"))
    timed = applies.join(issued, "token", "left")
    after = timed.filter(F.col("ts") >= F.col("issued"))
    first = after.groupBy("token").agg(F.min(F.struct("ts", "apply_id")).alias("first"))
    is_first = (F.col("ts") >= F.col("issued")) & (F.col("first.apply_id") == F.col("apply_id"))
    in_time = F.col("ts") <= F.col("issued") + F.expr(f"interval {minutes} minutes")
    outcome = (
        F.when(is_first & in_time, "applied").when(is_first, "expired").otherwise("unknown or used")
    )
    return timed.join(first, "token", "left").select("apply_id", "token", "ts", outcome.alias("outcome"))
