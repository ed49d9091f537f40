"""Priority rules and lints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.arrays import any_of, let

Rules = list[tuple[str, list[list[str]]]]

# Label key and the word groups that must all be hit, first rule wins.
INSTRUCTION_RULES: Rules = [
    ("rewrite_expand", [fv.INSTRUCTION_REWRITE, fv.INSTRUCTION_EXPAND]),
    ("rewrite", [fv.INSTRUCTION_REWRITE]),
    ("expand", [fv.INSTRUCTION_EXPAND]),
    ("move", [fv.INSTRUCTION_MOVE]),
    ("add", [fv.INSTRUCTION_ADD]),
    ("write", [fv.INSTRUCTION_WRITE]),
]


def first_rule(text: Column, rules: Rules, otherwise: str) -> Column:
    """Label of the first rule of which every word group is hit."""
    branches = None
    for label, groups in rules:
        met = F.lit(True)
        for group in groups:
            met = met & any_of(text, group)
        branches = F.when(met, F.lit(label)) if branches is None else branches.when(met, F.lit(label))
    return branches.otherwise(F.lit(otherwise))


def classify_instruction(text: Column) -> Column:
    rules = [(fv.INSTRUCTION_LABELS[key], groups) for key, groups in INSTRUCTION_RULES]
    return first_rule(text, rules, fv.INSTRUCTION_LABELS["other"])


def rule_scores(text: Column, rules: dict[str, dict[str, int]]) -> Column:
    """``array<struct<class, score>>``: summed weights of the signature phrases a text contains."""
    scored = []
    for label, phrases in rules.items():
        total = F.lit(0)
        for phrase, weight in phrases.items():
            total = total + F.when(F.contains(text, F.lit(phrase)), weight).otherwise(0)
        scored.append(F.struct(F.lit(label).alias("label"), total.alias("score")))
    return F.array(*scored)


def _with_top(scores: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the scores and the best of them; the text is searched once, not once per class that is compared."""
    return let(scores, lambda held: let(F.array_max(F.transform(held, lambda s: s["score"])), lambda top: body(held, top)))


def best_class(scores: Column) -> Column:
    """The single best class; no hit or a tie at the top gives ``unknown``."""
    def best(scores: Column, top: Column) -> Column:
        leaders = F.filter(scores, lambda s: (s["score"] == top) & (s["score"] > 0))
        return F.when(F.size(leaders) == 1, F.get(leaders, 0)["label"]).otherwise(F.lit("unknown"))

    return _with_top(scores, best)


def class_state(scores: Column) -> Column:
    """``found``, ``conflict`` (several classes share the best score) or ``no hit``."""
    def state(scores: Column, top: Column) -> Column:
        leaders = F.size(F.filter(scores, lambda s: s["score"] == top))
        return F.when(F.coalesce(top, F.lit(0)) <= 0, "no hit").when(leaders > 1, "conflict").otherwise("found")

    return _with_top(scores, state)


def target_folder(label: Column, folders: dict[str, str]) -> Column:
    """Folder of a class from a short fixed table; null for a class without one."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in folders.items() for v in pair]), label)


def question_plan(template: Column) -> Column:
    """Passages to ask for and search options of a template; null for an unknown one."""
    names = ("case_law", "statutes", "literature", "analyse", "rerank")
    rows = [
        v for k, values in fv.QUESTION_TEMPLATES.items() for v in (F.lit(k), F.struct(*[F.lit(x).alias(n) for n, x in zip(names, values)]))
    ]
    return F.try_element_at(F.create_map(*rows), template)


def question_violations(question: Column, template: Column, courts: list[str]) -> Column:
    """Codes of the wording rules a search question breaks; one template may name a court."""
    named = any_of(question, courts) if courts else F.lit(False)
    named = named & ~F.coalesce(template == fv.COURT_TEMPLATE, F.lit(False))
    found = F.array(
        F.when(F.length(question) > fv.QUESTION_MAX, "too_long"),
        F.when(~F.endswith(F.rtrim(question), F.lit("?")), "no_question_mark"),
        F.when(question.rlike(r"\d"), "has_digits"),
        F.when(named, "names_court"),
        F.when(F.length(question) - F.length(F.translate(question, "?", "")) > 1, "more_than_one"),
        F.when(~F.coalesce(template.isin(*fv.QUESTION_TEMPLATES), F.lit(False)), "unknown_template"),
    )
    return F.array_compact(found)
