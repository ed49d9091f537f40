"""Markup pages: rendering, structure, context, numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketry.functions.text import markup_to_text, section_number, unresolved_markup
from docketry.operators.structure import latest_revision, near_sections
from docketry.plans.statutes import sections, table_of_contents

PAGE = "\n".join(
    [
        "{{ח:התחלה}}",
        "{{ח:קטע3|שער א|שער א: הגדרות}}",
        "{{ח:סעיף|31|מונחים|תיקון: תשע\"ב}}",
        "{{ח:ת}} בחוק זה, \"מאגר\" כמשמעותו {{ח:פנימי|סעיף 77|בפרק הרישום}}.",
        "{{ח:קטע2|מסגרת|מסגרת שנייה: פיקוח}}",
        "{{ח:קטע4|סימן|סימן ג: בקרה}}",
        "{{ח:סעיף*|32א.|מפקח}}",
        "{{ח:תתת|(ב)|(4)}} המפקח ידווח אחת לשנה.",
        "{{ח:קטע3|שער ד|שער ד: שונות}}",
        "{{ח:סעיף|33|{{ח:הערה|ראו {{ח:פנימי|א|{{ח:חיצוני|ב|{{ח:תיבה|נוסח}}}}}}}} ביצוע|תיקון: [[דף|תשפ]]}}",
        "{{ח:ת}} '''הממונה''' אחראי.",
    ]
)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [("חוק המאגרים", PAGE, 91, dt.datetime(2022, 11, 6), "https://example.org/registry")],
        "title string, wikitext string, revid long, timestamp timestamp, url string",
    )


def test_sections_in_order_with_context(pages):
    rows = sections(pages).orderBy("pos").collect()
    assert [r["num"] for r in rows] == ["31", "32א", "33"]
    assert [r["context"] for r in rows] == [
        ["שער א: הגדרות"], ["מסגרת שנייה: פיקוח", "סימן ג: בקרה"], ["מסגרת שנייה: פיקוח", "שער ד: שונות"],
    ]
    assert rows[0]["amend"] == 'תיקון: תשע"ב' and "מפקח" not in rows[0]["body_text"]
    assert "בפרק הרישום" in rows[0]["body_text"] and not rows[0]["unresolved"]
    assert "(ב) (4)" in rows[1]["body_text"] and "שער ד" not in rows[1]["body_text"]
    assert "revid 91" in rows[2]["source"] and "2022-11-06" in rows[2]["source"]


def test_templates_deep_inside_an_opening_line(pages):
    row = sections(pages).filter("num = '33'").first()
    assert row["heading"] == "(ראו נוסח) ביצוע" and row["amend"] == "תיקון: תשפ"
    assert "(ראו נוסח) ביצוע" in row["body_text"] and "{{" not in row["body_text"]


def test_contents_indent(pages):
    assert [r["indent"] for r in table_of_contents(pages).orderBy("pos").collect()] == [1, 0, 2, 1]


@pytest.mark.parametrize("depth", [1, 6, 9, 25])
def test_any_depth(spark, depth):
    nested = "core"
    for k in range(depth):
        nested = f"{{{{ח:פנימי|עוגן {k}|{nested}}}}}"
    df = spark.createDataFrame([(f"a {nested} b",), ("{{ open " * depth,)], "t string")
    rows = df.select(markup_to_text(F.col("t")).alias("t")).select("t", unresolved_markup(F.col("t")).alias("left")).collect()
    assert (rows[0]["t"], rows[0]["left"], rows[1]["left"]) == ("a core b", False, True)


@pytest.mark.parametrize(
    "markup, text",
    [
        ("לפי [[פקודת הדרכים|הפקודה]] הזו", "לפי הפקודה הזו"),
        ("{{ח:הערה|בוטל}}", "(בוטל)"),
        ("{{ח:הערה|(בוטל)}}", "(בוטל)"),
        ("{{ח:חיצוני|תקנות|{{ח:פנימי|תקנה 8|תקנת משנה}}}} בלבד", "תקנת משנה בלבד"),
        ("{{ח:סוף}}נשאר", "נשאר"),
        ("{{ח:תת|(ד)|(1)}}תוכן", "(ד) (1) תוכן"),
        ("{{ח:סעיף|5|כותרת|תיקון}}", "5. כותרת   [תיקון]"),
        ("{{ח:סעיף||כותרת}}", "כותרת"),
        ("{{ח:כלשהו|א||ב}}", "א ב"),
        ("א<br>ב ''נטוי'' '''מודגש'''", "אב נטוי מודגש"),
        ("תל-אביב", "תל-אביב"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("{{ח:פנימי|סעיף 9|עוגן=x|הסעיף}}", "הסעיף"),
    ],
)
def test_rendering(spark, markup, text):
    df = spark.createDataFrame([(markup,)], "t string")
    assert df.select(markup_to_text(F.col("t"))).first()[0] == text


@pytest.mark.parametrize("raw, number", [(" 62א׳. ", "62א'"), ("5", "5"), (None, ""), ("7״..", '7"')])
def test_numbers(spark, raw, number):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(section_number(F.col("t"))).first()[0] == number


def test_near_numbers(spark):
    rows = [("p", i, n) for i, n in enumerate(["12", "12א", "13", "120"], 1)]
    df = spark.createDataFrame(rows, "page string, pos int, num string")
    assert {r["num"] for r in near_sections(df, "page", "12").collect()} == {"12"}
    assert {r["num"] for r in near_sections(df, "page", "12ב").collect()} == {"12", "12א", "120"}


def test_latest_revision_and_freshness(spark):
    rows = [("a", dt.datetime(2024, 1, 1), 1), ("a", dt.datetime(2024, 1, 9), 2), ("b", dt.datetime(2023, 1, 1), 3)]
    df = spark.createDataFrame(rows, "title string, timestamp timestamp, revid long")
    got = {r["title"]: (r["revid"], r["fresh"]) for r in latest_revision(df, "title", F.lit("2024-01-10").cast("timestamp")).collect()}
    assert got == {"a": (2, True), "b": (3, False)}
