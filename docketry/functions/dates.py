"""Dates and times as written in requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted written forms.
DATE_FORMS = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy"]
WRITTEN_FORMS = ["dd.MM.yyyy", "dd/MM/yy", "d-M-yyyy"]
TIME_FORM = "H:mm"


def _try(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form))


def parse_date(text: Column, forms: list[str] = DATE_FORMS) -> Column:
    """First form that fits; null when none does."""
    return F.coalesce(*[_try(text, f) for f in forms]).cast("date")


def parse_written_date(text: Column) -> Column:
    """Also the dotted, short and dashed forms found inside documents."""
    return parse_date(text, DATE_FORMS + WRITTEN_FORMS)


def parse_time_minutes(text: Column) -> Column:
    """Minutes after midnight."""
    at = _try(text, TIME_FORM)
    return F.hour(at) * 60 + F.minute(at)


def file_date(date: Column) -> Column:
    return F.date_format(date, "dd.MM.yy")


def prose_date(date: Column) -> Column:
    """Day and month without leading zeros."""
    return F.date_format(date, "d.M.yyyy")
