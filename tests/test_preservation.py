"""What a reordered text may change, and what it may not."""

import pytest
from pyspark.sql import functions as F

from docketry.operators.quality import findings_table, ordered_findings, overall_status
from docketry.plans.preservation import preservation_findings

FACTS = "המבקשת מפעילה מאפייה ברחוב הרימונים מאז 1998 ומעסיקה בה 11 עובדים בשתי משמרות."
QUOTE = 'השופטת ציינה כי "רישיון לעסק ניתן על יסוד המצב בשטח ולא על יסוד תוכניות" וכך נעשה גם כאן.'
CASES = "להשוואה ראו רע\"א 907/03 וכן ערר 4412/11 שבהם נבחן רעש של מכונות בשעות הלילה."
STATUTE = "סעיף 7 לחוק רישוי עסקים מחייב לשמוע את בעל העסק לפני שמתנים את הרישיון."
OUTCOME = "סוף דבר, הבקשה נדחית והמבקשת תישא בהוצאות של 2,400 שקלים."
TEXT = [FACTS, QUOTE, CASES, STATUTE, OUTCOME]


def versions(spark, before, after, name="a"):
    rows = [(name, side, i, t) for side, texts in (("original", before), ("reordered", after)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pair_id string, side string, pos int, text string")


def judged(spark, before, after, **options):
    rows = versions(spark, before, after)
    found = preservation_findings(rows, **options)
    status = overall_status(found, rows, "pair_id").first()["status"]
    return status, {(r["check"], r["severity"]) for r in found.collect()}


class TestNothingLost:
    @pytest.mark.parametrize("after", [TEXT, [STATUTE, FACTS, CASES, QUOTE, OUTCOME]])
    def test_order_is_free(self, spark, after):
        assert judged(spark, TEXT, after) == ("pass", set())

    def test_typography_is_free(self, spark):
        after = [t.replace('"רישיון', "„רישיון").replace('תוכניות"', "תוכניות”").replace(" ", "   ", 2) + "\u200f" for t in TEXT]
        assert judged(spark, TEXT, after)[0] == "pass"

    def test_compatibility_forms_are_the_same_letters(self, spark):
        before = [*TEXT[:4], OUTCOME.replace("2,400", "\uff12,400")]
        assert judged(spark, before, TEXT) == ("pass", set())
        assert ("4-operative", "DOUBLE_RED") in judged(spark, before, TEXT, compatibility=False)[1]


class TestParagraphs:
    def test_one_is_gone(self, spark):
        assert ("1-paragraphs", "RED") in judged(spark, TEXT, [FACTS, QUOTE, STATUTE, OUTCOME])[1]

    def test_one_is_new(self, spark):
        more = "שכנה אחת סיפרה על ריח נעים של לחם טרי שמגיע אליה מדי בוקר."
        assert ("1-paragraphs", "RED") in judged(spark, TEXT, [FACTS, more, *TEXT[1:]])[1]

    def test_growth_is_noted(self, spark):
        _, found = judged(spark, TEXT, [FACTS + " וכך עולה גם מן התצהיר", *TEXT[1:]])
        assert {c for c, _ in found} & {"1-paragraphs", "5-meaning"}

    def test_whole_text_and_place_tell_findings_apart(self, spark):
        opening = "פתיחה ארוכה שחוזרת על עצמה מילה במילה בשתי הפסקאות האלה ועד כאן היא שווה לגמרי ואז "
        before = [opening + "באה טענה ראשונה בעניין הרעש", opening + "נזכר ספק הקמח ותנאי התשלום שלו", OUTCOME]
        found = preservation_findings(versions(spark, before, [OUTCOME])).filter("`check` = '1-paragraphs'").collect()
        assert {(r["at"], r["subject"]) for r in found} == {("0", before[0]), ("1", before[1])}


class TestQuotesAndReferences:
    def test_a_changed_quote_is_lost(self, spark):
        after = [FACTS, QUOTE.replace("ולא על יסוד תוכניות", "או לפי הבטחות עתידיות"), *TEXT[2:]]
        assert ("2-quotes", "RED") in judged(spark, TEXT, after)[1]

    def test_a_changed_case_number_is_lost(self, spark):
        after = [FACTS, QUOTE, CASES.replace("4412/11", "4413/12"), STATUTE, OUTCOME]
        assert ("3-refs", "RED") in judged(spark, TEXT, after)[1]


class TestOutcome:
    def test_another_outcome(self, spark):
        after = [*TEXT[:4], OUTCOME.replace("נדחית", "מתקבלת")]
        status, found = judged(spark, TEXT, after)
        assert status == "fail" and ("4-operative", "DOUBLE_RED") in found

    @pytest.mark.parametrize(
        "after",
        [
            [*TEXT[:4], "", OUTCOME],
            [*TEXT[:4], "סוף דבר, הבקשה נדחית", "והמבקשת תישא בהוצאות של 2,400 שקלים."],
            [*TEXT[:4], OUTCOME, " \u200f "],
        ],
    )
    def test_cuts_and_blanks_are_no_change(self, spark, after):
        assert ("4-operative", "DOUBLE_RED") not in judged(spark, TEXT, after)[1]

    def test_gaps_in_the_numbering_are_no_change(self, spark):
        rows = versions(spark, [*TEXT, "ניתן היום."], [*TEXT, "ניתן היום."])
        spread = rows.withColumn("pos", F.when(F.col("side") == "original", F.col("pos") * 10).otherwise(F.col("pos")))
        assert preservation_findings(spread).count() == 0

    def test_lost_on_one_side(self, spark):
        assert ("4-operative", "DOUBLE_RED") in judged(spark, TEXT, TEXT[:4])[1]

    def test_none_on_either_side(self, spark):
        assert judged(spark, TEXT[:4], TEXT[:4]) == ("pass with notes", {("4-operative", "ORANGE")})


class TestConnectors:
    def test_listed(self, spark):
        status, found = judged(spark, TEXT, [*TEXT[:3], "בנוסף, " + STATUTE, OUTCOME])
        assert status != "fail" and ("6-connectors", "GREEN") in found

    def test_not_listed(self, spark):
        assert ("6-connectors", "RED") in judged(spark, TEXT, [*TEXT[:3], "כידוע לכל אדם סביר " + STATUTE, OUTCOME])[1]


def test_roll_ups_and_pairs(spark):
    bad = versions(spark, TEXT, [*TEXT[:4], OUTCOME.replace("נדחית", "מתקבלת")], "bad")
    both = versions(spark, TEXT, TEXT).unionByName(bad)
    found = preservation_findings(both)
    assert {r["pair_id"]: r["status"] for r in overall_status(found, both, "pair_id").collect()} == {"a": "pass", "bad": "fail"}
    assert {r["check"]: r["double_red"] for r in findings_table(found).collect()}["4-operative"] == 1
    assert ordered_findings(found).first()["severity"] == "DOUBLE_RED"
