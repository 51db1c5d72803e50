"""The queries of this subpackage, in the order of the problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from lexilathe.session import shipped

MODULES = ["mojibake", "splitting", "transcripts", "language", "neighbours", "scans", "clusters", "encode", "shared"]


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= import_module(f"lexilathe.llm.{m}").QUERIES
    return {name: shipped(f) for name, f in sorted(found.items(), key=lambda x: int(x[0].split("_")[0][1:]))}


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for m in MODULES:
        found |= getattr(import_module(f"lexilathe.llm.{m}"), "SQL", {})
    return found
