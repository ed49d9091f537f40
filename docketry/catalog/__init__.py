"""Registered queries over the driver tables, each with its plain-SQL twin where one exists."""

from __future__ import annotations

import importlib

MODULES = ["sources", "text", "predicates", "joins", "aggregates", "windows", "cases", "forms", "streams", "reports"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"docketry.catalog.{name}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
