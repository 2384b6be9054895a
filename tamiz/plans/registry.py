"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

AREAS = ["personal", "logs", "history", "validate", "catalog", "objects", "readers", "streams"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"tamiz.plans.{area}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracle_sql() -> dict:
    return _merged("ORACLE")
