"""Recognition quality, text layers, writing metrics and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.arrays import matches_with_offsets
from docketry.functions.text import valid_characters, word_count
from docketry.operators.ordered import islands


# --- pages ------------------------------------------------------------------

def page_confidence(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Mean word confidence per page to one decimal; a page without counted words has 0.0."""
    counted = words.filter((F.col("conf") >= 0) & (F.length(F.trim("text")) > 0))
    means = counted.groupBy("doc_key", "page").agg(F.bround(F.avg("conf"), 1).alias("confidence"))
    return pages.select("doc_key", "page").join(means, ["doc_key", "page"], "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0))
    )


def document_report(
    documents: DataFrame, page_conf: DataFrame, threshold: float = fv.PAGE_CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Mean page confidence, low pages and status of each document.

    ``documents(doc_key, method, status)``: failed stays failed, native text is
    done, a page under the threshold makes ``low_confidence``; without pages the
    status stays and the confidence is null.
    """
    per_doc = page_conf.groupBy("doc_key").agg(
        F.bround(F.avg("confidence"), 1).alias("mean_confidence"),
        F.count_if(F.col("confidence") < threshold).alias("n_low"),
        F.min(F.when(F.col("confidence") < threshold, F.col("page"))).alias("first_low_page"),
    )
    measured = F.col("mean_confidence").isNotNull() & (F.col("status") != "failed")
    status = (
        F.when(~measured | F.col("mean_confidence").isNull(), F.col("status"))
        .when(F.col("method") == "native", "done")
        .when(F.col("n_low") > 0, "low_confidence")
        .otherwise("done")
    )
    return documents.join(per_doc, "doc_key", "left").select(
        "doc_key",
        F.when(measured, F.col("mean_confidence")).alias("mean_confidence"),
        F.when(measured, F.col("n_low")).alias("low_pages"),
        F.when(measured, F.col("first_low_page")).alias("first_low_page"),
        status.alias("status"),
    )


def status_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "low_confidence", "failed", "pending")],
    )


def acceptance(metrics: DataFrame) -> DataFrame:
    """Route a document to the fallback engine when any limit is missed, with the reasons.

    ``metrics(doc_key, mean_confidence, chars_per_page, valid_ratio)``.
    """
    reasons = F.array_compact(
        F.array(
            F.when(F.col("mean_confidence") < fv.MIN_MEAN_CONFIDENCE, "low_confidence"),
            F.when(F.col("chars_per_page") < fv.MIN_CHARS_PER_PAGE, "little_text"),
            F.when(F.col("valid_ratio") < fv.MIN_VALID_CHAR_RATIO, "invalid_characters"),
        )
    )
    routed = metrics.withColumn("reasons", reasons)
    return routed.withColumn("accepted", F.size("reasons") == 0).withColumn(
        "engine", F.when(F.size("reasons") == 0, "local").otherwise("fallback")
    )


def text_metrics(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Inputs of ``acceptance`` from page texts and word confidences."""
    by_word = (
        words.filter((F.col("conf") >= 0) & (F.length(F.trim("text")) > 0))
        .groupBy("doc_key")
        .agg(F.bround(F.avg("conf"), 1).alias("mean_confidence"))
    )
    # Pages are read as one text with an empty line between them.
    gaps = 2 * (F.count(F.lit(1)) - 1)
    by_page = pages.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("n_pages"),
        (F.sum(F.length("text")) + gaps).alias("chars"),
        (F.sum(valid_characters(F.col("text"))) + gaps).alias("valid"),
    )
    ratio = F.when(F.col("chars") > 0, F.col("valid") / F.col("chars")).otherwise(F.lit(0.0))
    return by_page.join(by_word, "doc_key", "left").select(
        "doc_key",
        F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"),
        F.bround(F.col("chars") / F.col("n_pages"), 1).alias("chars_per_page"),
        F.bround(ratio, 3).alias("valid_ratio"),
    )


def text_layer(pages: DataFrame, documents: DataFrame, minimum: int = fv.TEXT_PAGE_CHARS) -> DataFrame:
    """Class of each document by its share of pages that carry text; no pages is ``empty``."""
    has_text = (F.length(F.trim("text")) >= minimum).cast("int")
    counted = pages.groupBy("doc_key").agg(F.count(F.lit(1)).alias("pages"), F.sum(has_text).alias("with_text"))
    joined = documents.select("doc_key").join(counted, "doc_key", "left")
    ratio = F.col("with_text") / F.col("pages")
    kind = (
        F.when(F.col("pages").isNull(), "empty")
        .when(ratio >= fv.TEXT_RATIO_HIGH, "text")
        .when(ratio <= fv.TEXT_RATIO_LOW, "image")
        .otherwise("mixed")
    )
    return joined.select(
        "doc_key", F.coalesce("pages", F.lit(0)).alias("pages"), kind.alias("kind"),
        F.coalesce(F.bround(ratio, 3), F.lit(0.0)).alias("text_ratio"),
    )


def scan_terms(pages: DataFrame, terms: list[str], minimum: int = fv.TEXT_PAGE_CHARS) -> DataFrame:
    """Terms found on each page; text pages give high confidence, image pages medium."""
    is_text = F.length(F.trim("text")) >= minimum
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("text"), t))
    return pages.filter(F.size(found) > 0).select(
        "doc_key", "page", F.explode(found).alias("term"),
        F.when(is_text, "text").otherwise("image").alias("page_type"),
        F.when(is_text, "high").otherwise("medium").alias("confidence"),
    )


def terms_not_found(findings: DataFrame, documents: DataFrame, terms: list[str]) -> DataFrame:
    """Terms of the list that a document does not contain."""
    seen = findings.groupBy("doc_key").agg(F.collect_set("term").alias("seen"))
    wanted = F.array(*[F.lit(t) for t in terms])
    missing = F.filter(wanted, lambda t: ~F.array_contains(F.coalesce("seen", F.lit([]).cast("array<string>")), t))
    return documents.select("doc_key").join(seen, "doc_key", "left").select(
        "doc_key", F.explode(missing).alias("term")
    )


# --- findings ---------------------------------------------------------------

def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITY_ORDER]), severity)


def overall_status(findings: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """fail, pass with notes or pass; a subject without findings passes."""
    worst = findings.groupBy(key).agg(
        F.bool_or(F.col("severity").isin("RED", "DOUBLE_RED")).alias("red"),
        F.bool_or(F.col("severity") == "ORANGE").alias("orange"),
    )
    status = F.when(F.col("red"), "fail").when(F.col("orange"), "pass with notes").otherwise("pass")
    return subjects.select(key).distinct().join(worst, key, "left").select(key, status.alias("status"))


def findings_table(findings: DataFrame) -> DataFrame:
    """Counts per check with one column per severity."""
    return findings.groupBy("check").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in fv.SEVERITY_ORDER]
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "check")


# --- writing ----------------------------------------------------------------

def writing_metrics(
    paragraphs: DataFrame,
    phrases: dict[str, list[str]] = fv.WRITING_PHRASES,
    words: dict[str, str] = fv.WRITING_WORDS,
    restate: str = fv.RESTATE_PATTERN,
    limits: dict[str, int] = fv.WRITING_LIMITS,
    terms: str = fv.WRITING_TERMS,
    frame: list[str] = fv.WRITING_FRAME_TERMS,
) -> DataFrame:
    """Metric values per document against their limits.

    ``paragraphs(doc_key, pos, is_heading, text)``, with ``is_quote`` where
    quoted paragraphs are known; these are no body. A phrase counts once per
    paragraph; the first word pattern counts every hit, the later ones once per
    paragraph. ``scattered`` counts the terms of a document, found by the
    pattern ``terms`` and not in ``frame``, that occur in clusters apart.
    """
    body = ~F.col("is_heading")
    if "is_quote" in paragraphs.columns:
        body = body & ~F.col("is_quote")
    text = F.col("text")
    aggregates = [
        F.sum(F.when(body, word_count(text)).otherwise(0)).alias("words"),
        F.count_if(F.col("is_heading") & (F.length(F.trim(text)) > 0)).alias("headings"),
    ]
    for metric, options in phrases.items():
        hits = F.lit(0)
        for option in options:
            hits = hits + F.when(F.contains(text, F.lit(option)), 1).otherwise(0)
        aggregates.append(F.sum(F.when(body, hits).otherwise(0)).alias(metric))
    for i, (metric, pattern) in enumerate(words.items()):
        hits = F.regexp_count(text, F.lit(pattern)) if i == 0 else F.when(text.rlike(pattern), 1).otherwise(0)
        aggregates.append(F.sum(F.when(body, hits).otherwise(0)).alias(metric))
    aggregates.append(F.count_if(body & text.rlike(restate)).alias("restate"))
    found = F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(terms), F.lit(0))), F.array(*[F.lit(t) for t in frame]).cast("array<string>"))
    occurrences = paragraphs.filter(body).select("doc_key", "pos", F.explode(found).alias("term"))
    scattered = scattered_terms(occurrences).groupBy("doc_key").agg(F.count(F.lit(1)).alias("scattered"))
    wide = paragraphs.groupBy("doc_key").agg(*aggregates).join(scattered, "doc_key", "left").fillna(0, ["scattered"])
    names = [c for c in wide.columns if c != "doc_key"]
    long = wide.select(
        "doc_key",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("metric"), F.col(n).cast("long").alias("value"), F.lit(limits.get(n)).cast("int").alias("limit")
                    )
                    for n in names
                ]
            )
        ).alias("m"),
    )
    return long.select("doc_key", "m.*").withColumn("within", F.col("value") <= F.col("limit"))


def scattered_terms(occurrences: DataFrame, gap: int = fv.SCATTER_GAP) -> DataFrame:
    """Terms of a document that occur in two or more clusters more than ``gap`` paragraphs apart.

    ``occurrences(doc_key, term, pos)``.
    """
    clusters = islands(occurrences.distinct(), ["doc_key", "term"], "pos", gap, "cluster")
    counted = clusters.groupBy("doc_key", "term").agg(F.max("cluster").alias("clusters"))
    return counted.filter("clusters >= 2")


def operative_tail(paragraphs: DataFrame, keys: list[str], markers: list[str]) -> DataFrame:
    """Paragraphs from the first one that starts with a marker to the end.

    The first marker of each text is a partial aggregate; no window is needed.
    """
    starts = F.lit(False)
    for m in markers:
        starts = starts | F.startswith(F.col("text"), F.lit(m))
    first = paragraphs.filter(starts).groupBy(*keys).agg(F.min("pos").alias("first_pos"))
    return paragraphs.join(first, keys).filter(F.col("pos") >= F.col("first_pos"))


def instruction_blocks(documents: DataFrame, opening: str = "<", closing: str = ">") -> DataFrame:
    """Bracketed instructions, whole in one paragraph or running over several.

    ``documents(doc_key, paras array)``. A paragraph opens a block when it has
    more opening than closing signs and none closes after its last opening
    sign; an open block ends at the first closing sign, and the rest of that
    paragraph is not read. Written as one letter per paragraph (opens ``O``,
    closes ``C``, both ``B``, neither ``N``), a block is a match of
    ``[OB][ON]*[CB]``, so blocks are found inside the document's row without a
    window or a loop over paragraphs.
    """
    o, c = f"\\Q{opening}\\E", f"\\Q{closing}\\E"
    after_last = lambda t: F.regexp_extract(t, f"(?s)^.*{o}(.*)$", 1)

    def letter(t: Column) -> Column:
        opens = (F.regexp_count(t, F.lit(o)) > F.regexp_count(t, F.lit(c))) & ~F.contains(after_last(t), F.lit(closing))
        closes = F.contains(t, F.lit(closing))
        return F.when(opens & closes, "B").when(opens, "O").when(closes, "C").otherwise("N")

    lettered = documents.select("doc_key", "paras", F.array_join(F.transform("paras", letter), "").alias("letters"))
    found = lettered.withColumn("blocks", matches_with_offsets(F.col("letters"), "[OB][ON]*[CB]"))
    last = F.try_element_at("blocks", F.lit(-1))
    read = F.coalesce(last["start"] + F.length(last["match"]), F.lit(0))  # a block left open starts after this, at the first opening
    left_open = F.regexp_instr(F.substring("letters", read + 1, F.length("letters")), F.lit("[OB]"))
    found = found.withColumn("open_from", F.when(left_open > 0, read + left_open - 1).otherwise(F.size("paras")))

    def inside(i: Column) -> Column:
        return (i > F.col("open_from")) | F.exists("blocks", lambda b: (i > b["start"]) & (i < b["start"] + F.length(b["match"])))

    def row(first: Column, last: Column, text: Column, span: str) -> Column:
        return F.struct(first.alias("first_pos"), last.alias("last_pos"), F.trim(text).alias("instruction"), F.lit(span).alias("span"))

    def whole(t: Column, i: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(f"{o}([^{closing}]+){c}"), F.lit(1))
        return F.transform(F.when(~inside(i), hits).otherwise(F.lit([]).cast("array<string>")), lambda h: row(i, i, h, "single"))

    def over_several(b: Column) -> Column:
        end = b["start"] + F.length(b["match"]) - 1
        text = lambda k: F.get("paras", k)
        middle = F.when(end - b["start"] > 1, F.transform(F.sequence(b["start"] + 1, end - 1), text)).otherwise(F.lit([]).cast("array<string>"))
        pieces = F.concat(F.array(after_last(text(b["start"]))), middle, F.array(F.regexp_extract(text(end), f"(?s)^(.*?){c}", 1)))
        return row(b["start"], end, F.array_join(pieces, " "), "multi")

    every = F.concat(F.flatten(F.transform("paras", whole)), F.transform("blocks", over_several))
    return found.select("doc_key", F.explode(every).alias("x")).select("doc_key", "x.*")
