"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry import fixed_values as fv
from docketry.functions.arrays import characters_of, let, matches

_VOWEL_POINTS = "".join(chr(code) for code in range(fv.VOWEL_POINT_RANGE[0], fv.VOWEL_POINT_RANGE[1] + 1))
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def search_key(text: Column) -> Column:
    """Tolerant search key: no vowel points, punctuation or spaces, plain final letters, lower case."""
    folded = F.translate(
        text, fv.FINAL_LETTERS + _VOWEL_POINTS + fv.SEARCH_PUNCTUATION, fv.PLAIN_LETTERS
    )
    return F.coalesce(F.regexp_replace(F.lower(folded), _SPACES, ""), F.lit(""))


def plain_search_key(term: str) -> str:
    """The same key for a term known when the query is written."""
    folded = term.translate(str.maketrans(fv.FINAL_LETTERS, fv.PLAIN_LETTERS, _VOWEL_POINTS + fv.SEARCH_PUNCTUATION))
    return "".join(folded.lower().split())


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility form; plain ASCII rows send only a null to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def comparison_key(text: Column, compatibility: bool = False) -> Column:
    """Same letters, one quote and dash style, single spaces, no direction marks."""
    base = nfkc(text) if compatibility else text
    one_style = F.translate(
        base,
        fv.DOUBLE_QUOTES + fv.SINGLE_QUOTES + fv.LONG_DASHES + fv.DIRECTION_MARKS,
        '"' * len(fv.DOUBLE_QUOTES) + "'" * len(fv.SINGLE_QUOTES) + "-" * len(fv.LONG_DASHES),
    )
    return F.coalesce(F.trim(F.regexp_replace(one_style, _SPACES, " ")), F.lit(""))


def word_count(text: Column) -> Column:
    """Words between white space; a blank text has none."""
    trimmed = F.trim(F.regexp_replace(text, _SPACES, " "))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, " ")))


def replace_typography(text: Column, quotes: bool = False, extra: dict[str, str] | None = None) -> Column:
    """Long dashes become hyphens; with ``quotes`` curly quotes become straight ones."""
    table = {c: "-" for c in fv.BANNED_DASHES}
    if quotes:
        table |= {c: "'" for c in fv.BANNED_SINGLE_QUOTES} | {c: '"' for c in fv.BANNED_DOUBLE_QUOTES}
    table |= extra or {}
    return F.translate(text, "".join(table), "".join(table.values()))


def valid_characters(text: Column, valid: str = fv.VALID_CHARACTERS) -> Column:
    """How many characters of a text belong to the valid set."""
    return F.length(F.regexp_replace(text, "(?U)[^" + valid[1:], ""))


def valid_character_ratio(text: Column, valid: str = fv.VALID_CHARACTERS) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    share = F.when(F.length(trimmed) == 0, F.lit(0.0)).otherwise(valid_characters(trimmed, valid) / F.length(trimmed))
    return F.coalesce(share, F.lit(0.0))


def section_number(text: Column) -> Column:
    plain = F.translate(F.trim(F.coalesce(text, F.lit(""))), "׳״", "'\"")
    return F.regexp_replace(plain, r"(?U)[\s.]+$", "")


def mask(text: Column) -> Column:
    return F.repeat(F.lit(fv.MASK_CHARACTER), F.greatest(F.lit(1), F.length(text)))


def clean_title(text: Column) -> Column:
    """A safe file title of at most 99 characters."""
    quoted = F.regexp_replace(text, '"', "״")
    legal = F.trim(F.regexp_replace(quoted, r"[\\/:*?<>|\r\n]+", " "))
    return F.trim(F.substring(F.regexp_replace(legal, r"\s{2,}", " "), 1, fv.TITLE_MAX))


def reroot_path(path: Column, new_root: str, marker: str = fv.DOCS_FOLDER) -> Column:
    """Put the part of ``path`` after the ``marker`` folder below ``new_root``."""
    pattern = rf"(?is)^.*?[\\/]\Q{marker}\E[\\/](.*)$"
    tail = F.regexp_extract(path, pattern, 1)
    joined = F.concat(F.lit(new_root.rstrip("/\\") + "/"), tail)
    return F.when(path.rlike(pattern), joined).otherwise(path)


# --- similarity -------------------------------------------------------------

def catalog_key(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def stem(word: Column) -> Column:
    prefixed = word.rlike(f"^[{fv.STEM_PREFIX_LETTERS}]") & (F.length(word) > 3)
    return F.when(prefixed, F.substring(word, F.lit(2), F.length(word))).otherwise(word)


def similarity(left: Column, right: Column) -> Column:
    """Best of token overlap, containment and edit distance, to two decimals."""

    def score(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        shortest = F.least(F.length(x), F.length(y))

        def tokens(value: Column) -> Column:
            return F.filter(F.transform(F.split(value, " "), stem), lambda w: F.length(w) > 0)

        overlap = let(
            tokens(x),
            lambda tx: let(
                tokens(y),
                lambda ty: F.size(F.filter(tx, lambda w: F.array_contains(ty, w)))
                / F.greatest(F.lit(1), F.size(F.array_union(tx, ty))),
            ),
        )
        contained = F.when(
            F.contains(x, y) | F.contains(y, x), F.least(F.lit(1.0), shortest / longest + F.lit(0.3))
        ).otherwise(F.lit(0.0))
        edited = F.lit(1) - F.levenshtein(x, y) / longest
        best = F.bround(F.least(F.lit(1.0), F.greatest(overlap, contained, edited)), 2)
        return (
            F.when(x == y, F.lit(1.0))
            .when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0))
            .otherwise(best)
        )

    return let(catalog_key(left), lambda x: let(catalog_key(right), lambda y: score(x, y)))


@F.pandas_udf(T.DoubleType())
def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts, for pairs that passed the cheap bounds."""
    from docketry.functions.partners import exact_block_ratio

    return pd.Series([exact_block_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


# --- quotes -----------------------------------------------------------------

_MARK = "\ue000"


def quotes(text: Column, min_chars: int = fv.QUOTE_MIN_CHARS, min_words: int = fv.QUOTE_MIN_WORDS) -> Column:
    """Double-quoted passages of one paragraph; a quote between two letters is an abbreviation."""
    normal = comparison_key(text)
    marked = F.regexp_replace(normal, '(?<=[א-ת])"(?=[א-ת])', _MARK)
    bodies = F.transform(
        matches(marked, f'"([^"]{{{min_chars},}})"', 1), lambda q: F.trim(F.regexp_replace(q, _MARK, '"'))
    )
    return F.filter(bodies, lambda q: F.size(F.split(q, " ")) >= min_words)


def leading_addition(original: Column, changed: Column) -> Column:
    """What ``changed`` has in front of ``original``; null when nothing was put in front.

    Both sides are comparison keys.
    """
    extra = F.length(changed) - F.length(original)
    head = F.substring(original, 1, 40)
    at = F.when(F.length(original) >= 40, F.instr(changed, head) - 1).otherwise(F.lit(-1))
    return (
        F.when(F.endswith(changed, original) & (extra > 0), F.trim(F.substring(changed, F.lit(1), extra)))
        .when(at > 0, F.trim(F.substring(changed, F.lit(1), at)))
    )


# --- characters -------------------------------------------------------------

def forbidden_characters(line: Column, names: dict[str, str] = fv.FORBIDDEN_CHARACTERS) -> Column:
    """``array<struct<col, char, name, context>>`` for one line, columns from 1."""
    chosen = "".join(names)
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    numbered = F.transform(
        characters_of(line), lambda c, i: F.struct((i + 1).alias("col"), c.alias("char"))
    )
    hits = F.filter(numbered, lambda x: F.instr(F.lit(chosen), x["char"]) > 0)
    return F.transform(
        hits,
        lambda x: F.struct(
            x["col"].alias("col"),
            x["char"].alias("char"),
            F.element_at(lookup, x["char"]).alias("name"),
            F.substring(
                line, F.greatest(F.lit(1), x["col"] - 20), x["col"] + 21 - F.greatest(F.lit(1), x["col"] - 20)
            ).alias("context"),
        ),
    )


# --- markup -----------------------------------------------------------------

_OPEN, _CLOSE = "\ue001", "\ue002"


def _expand_once(text: Column) -> Column:
    """Resolve every template that holds no other template."""

    def names(options: list[str]) -> str:
        return "(?:" + "|".join(rf"\Q{o}\E" for o in options) + ")"

    arg = r"([^{}|]*)"
    optional = r"(?:\|\s*([^{}|]*?)\s*(?=[|}]))?"
    t = F.regexp_replace(text, r"\[\[(?:[^\[\]{}]*\|)?([^\[\]{}|]*)\]\]", "$1")
    t = F.regexp_replace(t, rf"(?U)\|{fv.MARKUP_NAMED_ARGUMENT}[^{{}}|]*(?=[|}}])", "")
    t = F.regexp_replace(t, rf"\{{\{{\s*{names(fv.MARKUP_DROPPED)}\s*(?:\|[^{{}}]*)?\}}\}}", "")
    t = F.regexp_replace(t, rf"\{{\{{\s*{names(fv.MARKUP_FIRST_ARGUMENT)}\s*\|{arg}[^{{}}]*\}}\}}", "$1")
    t = F.regexp_replace(t, rf"\{{\{{\s*{names(fv.MARKUP_LAST_ARGUMENT)}\s*\|(?:[^{{}}]*\|)?{arg}\}}\}}", "$1")
    t = F.regexp_replace(t, rf"\{{\{{\s*{fv.MARKUP_HEADING}\s*\|[^{{}}|]*\|{arg}[^{{}}]*\}}\}}", "$1")
    t = F.regexp_replace(t, rf"\{{\{{\s*{fv.MARKUP_HEADING}\s*\|{arg}\}}\}}", "$1")
    section = rf"\{{\{{\s*{fv.MARKUP_SECTION}\s*\|\s*"
    number, blank = r"([^{}|]*?[^{}|\s])\s*(?=[|}])", r"(?=[|}])"
    with_note = r"(?:\|\s*([^{}|]*?)\s*(?=[|}]))\|\s*([^{}|]*?[^{}|\s])\s*(?=[|}])[^{}]*\}\}"
    plain = optional + r"[^{}]*\}\}"
    t = F.regexp_replace(t, section + number + with_note, "$1. $2   [$3]")
    t = F.regexp_replace(t, section + blank + with_note, "$1   [$2]")
    t = F.regexp_replace(t, section + number + plain, "$1. $2")
    t = F.regexp_replace(t, section + blank + plain, "$1")
    t = F.regexp_replace(t, rf"\{{\{{\s*{fv.MARKUP_NOTE}\s*\|\s*(\([^{{}}|]*\))\s*(?:\|[^{{}}]*)?\}}\}}", "$1")
    t = F.regexp_replace(
        t, rf"\{{\{{\s*{fv.MARKUP_NOTE}\s*\|\s*([^{{}}|]*?)\s*(?:\|[^{{}}]*)?\}}\}}", "($1)"
    )
    for name, depth in fv.MARKUP_INDENTS.items():
        t = F.regexp_replace(
            t, rf"\{{\{{\s*\Q{name}\E\s*\|([^{{}}]*)\}}\}}", " " * depth + _OPEN + "$1" + _CLOSE + " "
        )
    # An outer template may have lost its inner one just now; its own rule takes it in the next round.
    ruled = names([*fv.MARKUP_FIRST_ARGUMENT, *fv.MARKUP_LAST_ARGUMENT, *fv.MARKUP_INDENTS, *fv.MARKUP_DROPPED, fv.MARKUP_NOTE])
    own_rule = rf"(?!\s*(?:{ruled}|{fv.MARKUP_HEADING}|{fv.MARKUP_SECTION})\s*\|)"
    t = F.regexp_replace(t, r"\{\{" + own_rule + r"[^{}|]*\|([^{}]*)\}\}", _OPEN + "$1" + _CLOSE)
    t = F.regexp_replace(t, r"\{\{[^{}|]*\}\}", "")
    t = F.regexp_replace(t, rf"(?<={_OPEN})[\s|]+|[\s|]+(?={_CLOSE})", "")
    t = F.regexp_replace(t, rf"\s*\|[\s|]*(?=[^{_OPEN}{_CLOSE}]*{_CLOSE})", " ")
    return F.translate(t, _OPEN + _CLOSE, "")


def unresolved_markup(text: Column) -> Column:
    """Whether a template or link is still there, as when its braces do not balance."""
    return F.contains(text, F.lit("{{")) | F.contains(text, F.lit("[["))


def nesting(text: Column) -> Column:
    """Depth of the deepest template or link."""
    marks = F.regexp_extract_all(text, F.lit(r"\{\{|\[\[|\}\}|\]\]"), F.lit(0))
    folded = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, m: let(
            F.greatest(F.lit(0), acc["now"] + F.when(m.isin("{{", "[["), 1).otherwise(-1)),
            lambda now: F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most")),
        ),
        lambda acc: acc["most"],
    )
    return F.when(unresolved_markup(text), folded).otherwise(F.lit(0))


def expand_templates(text: Column) -> Column:
    """Innermost-first rounds, as many as the text is deep; one without a template passes through unchanged."""

    def rounds(deep: Column) -> Column:
        steps = F.when(deep > 0, F.sequence(F.lit(0), deep)).otherwise(F.lit([]).cast("array<int>"))
        return F.aggregate(steps, text, lambda t, _: F.when(unresolved_markup(t), _expand_once(t)).otherwise(t))

    return let(nesting(text), rounds)


def strip_markup(text: Column) -> Column:
    """Bold marks and tags go, trailing blanks and runs of empty lines shrink."""
    for pattern, kept in fv.MARKUP_CLEANING:
        text = F.regexp_replace(text, pattern, kept)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def markup_to_text(text: Column) -> Column:
    return strip_markup(expand_templates(text))


# --- planted text -----------------------------------------------------------

def remove_planted(text: Column, planted: list[str] = fv.PLANTED_TEXT) -> tuple[Column, Column, Column]:
    """Cleaned text, number of planted strings removed, number of footnote digits removed."""
    alternation = "|".join(rf"\Q{p}\E" for p in sorted(planted, key=len, reverse=True))
    glued = r"(?<=\p{L})\d{1,2}(?=$|[\s.,;:])"
    without = F.regexp_replace(text, alternation, "")
    return (
        F.regexp_replace(without, glued, ""),
        F.regexp_count(text, F.lit(alternation)),
        F.regexp_count(without, F.lit(glued)),
    )
