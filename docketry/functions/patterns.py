"""Pattern tables and the detectors built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.arrays import around, let, matches, matches_with_offsets
from docketry.functions.text import comparison_key


@dataclass(frozen=True)
class Detector:
    category: str
    pattern: str
    min_digits: int = 0


HOME_DETECTORS = [
    Detector(c, "(?U)" + p, fv.PHONE_MIN_DIGITS if c == "PHONE" else 0)
    for c, p in fv.DETECTOR_PATTERNS.items()
    if c not in ("DATE", "ISRAELI_ID")
]
IDENTITY_CATEGORY = "ISRAELI_ID"
DATE_DETECTOR = Detector("DATE", "(?U)" + fv.DETECTOR_PATTERNS["DATE"])
# The same categories for text written with other number formats.
LATIN_DETECTORS = [
    Detector("PHONE", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"),
    Detector("EMAIL", fv.DETECTOR_PATTERNS["EMAIL"]),
    Detector("CREDIT_CARD", r"[0-9]{16}"),
]


def detect(line: Column, detectors: list[Detector]) -> Column:
    """``array<struct<category, value>>`` of one line, in detector order."""

    def found(d: Detector) -> Column:
        values = matches(line, d.pattern)
        if d.min_digits:
            values = F.filter(values, lambda v: F.length(F.regexp_replace(v, r"\D", "")) >= d.min_digits)
        return F.transform(values, lambda v: F.struct(F.lit(d.category).alias("category"), v.alias("value")))

    return F.concat(*[found(d) for d in detectors])


def check_digit_valid(number: Column) -> Column:
    """National identity number check; five to nine digits count from the right."""
    digits = F.regexp_replace(number, r"\D", "")
    sized = F.length(digits).between(5, 9)
    return F.coalesce(sized & F.call_function("luhn_check", F.lpad(digits, 9, "0")), F.lit(False))


def identity_numbers(line: Column, label: str = fv.ID_LABEL_PATTERN) -> Column:
    """``array<struct<value, start, valid, labelled>>``: valid numbers, or any next to a label on either side."""
    hits = matches_with_offsets(line, fv.DETECTOR_PATTERNS["ISRAELI_ID"])

    def judge(x: Column) -> Column:
        begin = F.greatest(F.lit(0), x["start"] - fv.ID_LABEL_REACH)
        before = F.substring(line, begin + 1, x["start"] - begin)
        after = F.substring(line, x["start"] + F.length(x["match"]) + 1, F.lit(fv.ID_LABEL_REACH))
        return F.struct(
            x["match"].alias("value"),
            x["start"].alias("start"),
            (F.length(x["match"]).isin(8, 9) & check_digit_valid(x["match"])).alias("valid"),
            F.concat(before, F.lit(" "), after).rlike(label).alias("labelled"),
        )

    return F.filter(F.transform(hits, judge), lambda x: x["valid"] | x["labelled"])


def legal_references(text: Column, patterns: list[str] = fv.LEGAL_REFERENCE_PATTERNS) -> Column:
    """Distinct references of a text over all patterns, white space squeezed."""

    def collect(normal: Column) -> Column:
        return F.array_distinct(F.concat(*[matches(normal, p) for p in patterns]))

    return let(comparison_key(text), collect)


def appendix_references(
    line: Column,
    patterns: list[tuple[str, str]] = fv.APPENDIX_PATTERNS,
    false_positives: list[str] = fv.APPENDIX_FALSE_POSITIVES,
) -> Column:
    """``array<struct<priority, start, ref_id, family, context>>`` for one line.

    Several patterns can find the same reference; the caller keeps the lowest
    (priority, start) per line and identifier.
    """

    def found(priority: int, family: str, pattern: str) -> Column:
        return F.transform(
            matches_with_offsets(line, pattern),
            lambda x: F.struct(
                F.lit(priority).alias("priority"),
                x["start"].alias("start"),
                F.trim(F.regexp_extract(x["match"], pattern, 1)).alias("ref_id"),
                F.lit(family).alias("family"),
                F.trim(around(line, x["start"], F.length(x["match"]), fv.APPENDIX_CONTEXT)).alias("context"),
            ),
        )

    hits = F.concat(*[found(i, family, pattern) for i, (family, pattern) in enumerate(patterns)])
    return F.filter(hits, lambda x: ~x["ref_id"].isin(*false_positives))


def first_per_reference(hits: Column) -> Column:
    """Keep the first hit of every identifier of a line, in (priority, start) order."""
    return let(
        F.array_sort(hits),
        lambda ordered: F.filter(
            ordered,
            lambda x, i: F.array_position(F.transform(ordered, lambda y: y["ref_id"]), x["ref_id"]) == i + 1,
        ),
    )


def numbering_style(
    text: Column,
    letters: str = fv.APPENDIX_LETTER_PATTERN,
    numbers: str = fv.APPENDIX_NUMBER_PATTERN,
    names: tuple[str, str] = ("hebrew", "arabic"),
) -> Column:
    """Numbers win only with strictly more hits."""
    return F.when(
        F.regexp_count(text, F.lit(numbers)) > F.regexp_count(text, F.lit(letters)), F.lit(names[1])
    ).otherwise(F.lit(names[0]))


def appendix_label(index: Column, style: Column) -> Column:
    """Identifier of the appendix at ``index`` (from 0); null outside the letter table."""
    letters = F.array(*[F.lit(x) for x in fv.APPENDIX_LETTERS])
    lettered = F.when(index >= 0, F.get(letters, index))
    return F.when(style == "arabic", (index + 1).cast("string")).otherwise(lettered)


def appendix_index(label: Column, style: Column) -> Column:
    """Index (from 0) of an identifier; null when it is not one."""
    letters = F.array(*[F.lit(x) for x in fv.APPENDIX_LETTERS])
    trimmed = F.trim(label)
    quoted = F.when(F.endswith(trimmed, F.lit("'")), trimmed).otherwise(F.concat(trimmed, F.lit("'")))
    position = F.array_position(letters, quoted).cast("int")
    numbered = trimmed.try_cast("int") - 1
    return F.when(style == "arabic", numbered).otherwise(F.when(position > 0, position - 1))
