"""Collects the queries and oracles of the plan modules."""

from __future__ import annotations

from brindle.plans import analytics, assembly, codegraphs, contexts, hostlogs, metrics, planning, retrieval, security, structure

PLANS: list = [retrieval, analytics, structure, hostlogs, codegraphs, planning, security, assembly, metrics, contexts]


def queries() -> dict:
    return {name: q for plan in PLANS for name, q in plan.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
