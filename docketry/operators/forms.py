"""Questionnaires, templates and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.arrays import let, matches

OPTION = "struct<value:string,he:string,en:string>"
QUESTION = (
    "struct<id:string,type:string,he:string,en:string,"
    f"options:array<{OPTION}>,showIf:struct<id:string,equals:array<string>>>"
)
CHAPTER = f"struct<id:string,he:string,en:string,questions:array<{QUESTION}>>"
QUESTIONNAIRE = f"array<{CHAPTER}>"


def tolerant_json(text: Column, schema: str) -> Column:
    """Parsed whole, else the outermost braces, else with double quotes, else without trailing commas.

    A required-field-free schema parses any object, so malformed text is told
    apart by the corrupt-record column.
    """

    def parse(value: Column) -> Column:
        inner = schema.removeprefix("struct<").removesuffix(">")
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "allowSingleQuotes": "false"}
        parsed = F.from_json(value, f"struct<{inner},__bad:string>", options)
        fields = [part.split(":")[0] for part in inner.split(",")]
        return let(
            parsed,
            lambda p: F.when(
                p.isNotNull() & p["__bad"].isNull(), F.struct(*[p[f].alias(f) for f in fields])
            ),
        )

    # Nothing but one object may stand in the text for a whole parse.
    whole = F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text)
    return let(
        F.when(text.rlike(r"(?s)\{.*\}"), F.regexp_extract(text, r"(?s)\{.*\}", 0)),
        lambda inner: F.coalesce(
            parse(whole),
            parse(inner),
            parse(F.regexp_replace(inner, "'", '"')),
            parse(F.regexp_replace(inner, r",\s*([}\]])", "$1")),
        ),
    )


def questions_of(forms: DataFrame, form: str, chapters: Column) -> DataFrame:
    """One row per question with its chapter and places."""
    exploded = forms.select(form, F.posexplode(chapters).alias("chapter_pos", "c"))
    return exploded.select(
        form, "chapter_pos", F.col("c.id").alias("chapter_id"),
        F.posexplode("c.questions").alias("pos", "q"),
    ).select(
        form, "chapter_pos", "chapter_id", "pos", F.col("q.id").alias("id"), F.col("q.type").alias("type"),
        F.col("q.he").alias("he"), F.col("q.en").alias("en"), F.col("q.options").alias("options"),
        F.col("q.showIf.id").alias("gate_id"), F.col("q.showIf.equals").alias("gate_values"),
    )


def lint_questionnaires(forms: DataFrame, form: str, chapters: Column) -> DataFrame:
    """Rule violations of each questionnaire: ``(form, question id, rule)``.

    Uniqueness and gate order are joins on (form, id), never a comparison of
    all questions with each other.
    """
    q = questions_of(forms, form, chapters)
    counts = q.groupBy(form, "id").agg(F.count(F.lit(1)).alias("n"))
    firsts = q.groupBy(form, "chapter_pos", F.col("id").alias("gate_id")).agg(F.min("pos").alias("gate_pos"))
    joined = q.join(counts, [form, "id"]).join(firsts, [form, "chapter_pos", "gate_id"], "left")
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    rules = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, "duplicate id"),
            F.when(F.endswith("id", F.lit(fv.RESERVED_QUESTION_SUFFIX)), "reserved id"),
            F.when(
                F.col("gate_id").isNotNull() & (F.col("gate_pos").isNull() | (F.col("gate_pos") >= F.col("pos"))),
                "gate not earlier",
            ),
            F.when(F.col("type").isin(*fv.OPTION_TYPES) & (F.coalesce(F.size("options"), F.lit(0)) <= 0), "options missing"),
            F.when(~F.col("type").isin(*fv.QUESTION_TYPES), "unknown type"),
            F.when(blank(F.col("he")) | blank(F.col("en")), "language missing"),
        )
    )
    per_question = joined.select(form, F.col("id").alias("item"), F.explode(rules).alias("rule"))
    c = forms.select(form, F.explode(chapters).alias("c"))
    per_chapter = c.select(
        form, F.col("c.id").alias("item"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("c.id") == fv.RESERVED_CHAPTER, "reserved chapter"),
                    F.when(blank(F.col("c.he")) | blank(F.col("c.en")), "chapter language missing"),
                )
            )
        ).alias("rule"),
    )
    return per_question.unionByName(per_chapter)


def visible(gate_id: Column, gate_values: Column, answers: Column) -> Column:
    """A question shows without a gate, or when the gate's answer is one of the expected values."""
    given = F.try_element_at(answers, gate_id)
    return F.when(gate_id.isNull(), F.lit(True)).otherwise(
        F.coalesce(F.arrays_overlap(given, gate_values), F.lit(False))
    )


# --- templates --------------------------------------------------------------

def placeholders(text: Column) -> Column:
    return F.array_distinct(matches(text, fv.PLACEHOLDER_PATTERN, 1))


def fill_template(text: Column, data: Column) -> Column:
    """Text with each placeholder replaced by its value.

    ``data`` maps names to lists of strings: several values become lines, a
    checkbox becomes checked when its value is not empty, an absent name
    becomes empty.
    """
    names = matches(text, fv.PLACEHOLDER_PATTERN, 1)
    gaps = F.split(text, fv.PLACEHOLDER_PATTERN, -1)

    def value(name: Column) -> Column:
        given = F.coalesce(F.array_join(F.try_element_at(data, name), "\n"), F.lit(""))
        box = F.when(F.length(given) > 0, F.lit(fv.CHECKED)).otherwise(F.lit(fv.UNCHECKED))
        return F.when(F.startswith(name, F.lit(fv.CHECKBOX_PREFIX)), box).otherwise(given)

    filled = F.concat(F.transform(names, value), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, filled, lambda g, v: F.concat(g, v)), "")


def template_audit(names: Column, data: Column) -> dict[str, Column]:
    """Data keys the template lacks, plain fields left empty, checkbox groups with nothing chosen."""
    def given(name: Column) -> Column:
        return F.length(F.coalesce(F.array_join(F.try_element_at(data, name), ""), F.lit(""))) > 0

    empty = F.filter(names, lambda n: ~F.startswith(n, F.lit(fv.CHECKBOX_PREFIX)) & ~given(n))
    groups = [
        F.when(~F.exists(F.array(*[F.lit(k) for k in keys]), given), F.lit(label))
        for label, keys in fv.CHECKBOX_GROUPS.items()
    ]
    return {
        "unknown": F.array_sort(F.array_except(F.map_keys(data), names)),
        "empty": F.array_sort(empty),
        "unchecked_groups": F.array_compact(F.array(*groups)),
    }
