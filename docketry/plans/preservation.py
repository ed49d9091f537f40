"""Did reordering a text change it? Findings for many pairs of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry import fixed_values as fv
from docketry.functions.patterns import legal_references
from docketry.functions.text import comparison_key, leading_addition, nfkc, quotes, word_count
from docketry.operators.matching import best_partner, without_partner
from docketry.operators.quality import operative_tail
from docketry.session import cut_lineage

PAIR = ["pair_id"]
FINDING = ["pair_id", "check", "severity", "at", "subject", "detail"]


def _finding(df: DataFrame, check: str, severity: Column | str, subject: Column, detail: Column | str) -> DataFrame:
    """Findings with the place of the paragraph (``pos``, or ``pos.i`` for a part of it) and its whole text."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    at = F.lit(None).cast("string")
    if "row" in df.columns:
        nested = isinstance(df.schema["row"].dataType, StructType)
        at = F.concat_ws(".", "row.pos", "row.i") if nested else F.col("row").cast("string")
    return df.select(
        "pair_id", F.lit(check).alias("check"), as_column(severity).alias("severity"), at.alias("at"),
        subject.alias("subject"), as_column(detail).alias("detail"),
    ).filter(F.col("severity").isNotNull())


def keyed_paragraphs(paragraphs: DataFrame, side: str) -> DataFrame:
    """Non-empty paragraphs of one version as ``(pair_id, row, text)`` in comparison form."""
    own = paragraphs.filter(F.col("side") == side)
    key = F.col("key") if "key" in paragraphs.columns else comparison_key(F.col("text"))
    return own.select("pair_id", F.col("pos").alias("row"), key.alias("text")).filter(F.length("text") > 0)


def written_once(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs with their comparison form as ``key``, worked out and written once; a text that equals it is not written. A null text becomes empty."""
    key = comparison_key(F.col("text"))
    held = cut_lineage(paragraphs.select("pair_id", "side", "pos", key.alias("key"), F.when(F.col("text") != key, F.col("text")).alias("own")))
    return held.select("pair_id", "side", "pos", "key", F.coalesce("own", "key").alias("text"))


def alignment(old: DataFrame, new: DataFrame, metric: str) -> DataFrame:
    """Best partner of every original paragraph: ``(pair_id, row, text, other, score, partner)``."""
    return best_partner(old, new, PAIR, fv.NEAR_MATCH_THRESHOLD, metric, texts=True)


def paragraph_findings(aligned: DataFrame, old: DataFrame, new: DataFrame, metric: str) -> DataFrame:
    """Originals without a near partner are lost, new ones without one are invented."""
    changed = F.when(F.col("score").isNull(), "RED").when(F.col("score") < fv.PARAGRAPH_MATCH_THRESHOLD, "ORANGE")
    detail = F.when(F.col("score").isNull(), "lost paragraph").otherwise("paragraph may be changed")
    lonely = without_partner(new, old, PAIR, fv.NEAR_MATCH_THRESHOLD, metric)
    return _finding(aligned, "1-paragraphs", changed, F.col("text"), detail).unionByName(
        _finding(lonely, "1-paragraphs", "RED", F.col("text"), "invented paragraph")
    )


def quote_findings(paragraphs: DataFrame, metric: str) -> DataFrame:
    """Every original quote must stand among the new version's quotes."""
    every = paragraphs.select("pair_id", "side", "pos", F.posexplode(quotes(F.col("text"))).alias("i", "text"))
    numbered = every.withColumn("row", F.struct("pos", "i")).select("pair_id", "side", "row", "text")
    old = numbered.filter(F.col("side") == "original").drop("side")
    new = numbered.filter(F.col("side") == "reordered").drop("side")
    matched = best_partner(old, new, PAIR, fv.PARAGRAPH_MATCH_THRESHOLD, metric)
    severity = F.when(F.col("score").isNull(), "RED").when(F.col("score") < 1.0, "ORANGE")
    detail = F.when(F.col("score").isNull(), "lost quote").otherwise("slightly different quote")
    return _finding(matched, "2-quotes", severity, F.col("text"), detail)


def reference_findings(paragraphs: DataFrame, patterns: list[str]) -> DataFrame:
    refs = paragraphs.select("pair_id", "side", F.explode(legal_references(F.col("text"), patterns)).alias("ref"))
    sides = refs.groupBy("pair_id", "ref").agg(
        F.bool_or(F.col("side") == "original").alias("old"), F.bool_or(F.col("side") == "reordered").alias("new")
    )
    detail = F.when(F.col("old"), "lost reference").otherwise("invented reference")
    return _finding(sides.filter(F.col("old") != F.col("new")), "3-refs", "RED", F.col("ref"), detail)


def outcome_findings(paragraphs: DataFrame, markers: list[str]) -> DataFrame:
    """The operative tails must say the same, however they are cut into paragraphs.

    Blank paragraphs do not count; a tail is one version's own paragraphs, joined in order.
    """
    key = F.col("key") if "key" in paragraphs.columns else comparison_key(F.col("text"))
    keyed = paragraphs.withColumn("text", key).drop("key").filter(F.length("text") > 0)
    tail = operative_tail(keyed, ["pair_id", "side"], markers)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    joined_text = F.array_join(F.transform(ordered, lambda x: x["text"]), " ")
    prints = tail.groupBy("pair_id", "side").agg(F.sha2(joined_text, 256).alias("print"))
    differs = prints.groupBy("pair_id").agg(
        (F.count(F.lit(1)) < 2).alias("lost"), F.count_distinct("print").alias("n")
    ).select("pair_id", (F.col("lost") | (F.col("n") > 1)).alias("differs"))
    joined = paragraphs.select("pair_id").distinct().join(differs, "pair_id", "left")
    severity = F.when(F.col("differs").isNull(), "ORANGE").when(F.col("differs"), "DOUBLE_RED")
    detail = F.when(F.col("differs").isNull(), "no operative part found").otherwise("operative part changed")
    return _finding(joined, "4-operative", severity, F.lit(""), detail)


def drift_findings(aligned: DataFrame) -> DataFrame:
    """Matched paragraphs whose word count moved by more than a tenth."""
    old = aligned.filter(F.col("partner").isNotNull())
    a, b = word_count(F.col("text")), word_count(F.col("partner"))
    severity = F.when((a > 0) & (F.abs(b - a) / a > fv.DRIFT_TOLERANCE), "ORANGE")
    return _finding(old, "5-meaning", severity, F.col("text"), F.format_string("%d to %d words", a, b))


def connector_findings(aligned: DataFrame, connectors: list[str]) -> DataFrame:
    """Words put in front of a paragraph must come from the closed list."""
    old = aligned.filter(F.col("score") < fv.SAME_TEXT_THRESHOLD)
    added = old.withColumn("added", leading_addition(F.col("text"), F.col("partner"))).filter(F.length("added") > 0)
    allowed = F.array(*[comparison_key(F.lit(c)) for c in connectors])
    severity = F.when(F.array_contains(allowed, comparison_key(F.col("added"))), "GREEN").otherwise("RED")
    return _finding(added, "6-connectors", severity, F.col("text"), F.col("added"))


def preservation_findings(
    paragraphs: DataFrame,
    metric: str = "blocks",
    patterns: list[str] = fv.LEGAL_REFERENCE_PATTERNS,
    markers: list[str] = fv.OPERATIVE_MARKERS,
    connectors: list[str] = fv.ALLOWED_CONNECTORS,
    compatibility: bool = True,
) -> DataFrame:
    """All findings of ``paragraphs(pair_id, side, pos, text)``.

    ``metric`` is ``blocks`` (matching blocks, for the few pairs
    that pass the bounds) or ``edit`` (edit distance). With
    ``compatibility`` every check reads the texts in their compatibility form.
    """
    if compatibility:
        paragraphs = paragraphs.withColumn("text", nfkc(F.col("text")))
    # All checks read the written paragraphs; neither texts nor keys are worked out again.
    paragraphs = written_once(paragraphs)
    old = keyed_paragraphs(paragraphs, "original")
    new = keyed_paragraphs(paragraphs, "reordered")
    # Written once, since three checks read it.
    aligned = cut_lineage(alignment(old, new, metric))
    parts = [
        paragraph_findings(aligned, old, new, metric),
        quote_findings(paragraphs, metric),
        reference_findings(paragraphs, patterns),
        outcome_findings(paragraphs, markers),
        drift_findings(aligned),
        connector_findings(aligned, connectors),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
