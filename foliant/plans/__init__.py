"""Registered queries: one module per family, each with QUERIES and ORACLE_SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("retrieval", "rollouts", "joins", "labels", "evaluation", "curation", "nested", "files", "growing", "reports")


def queries() -> dict:
    return {name: q for family in FAMILIES for name, q in import_module(f"foliant.plans.{family}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for family in FAMILIES for name, q in import_module(f"foliant.plans.{family}").ORACLE_SQL.items()}
