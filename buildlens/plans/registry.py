"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from buildlens.plans import core, evidence_queries, gate_queries, helper_queries, report_queries, source_queries, state_queries, verdict_queries

MODULES = (core, source_queries, verdict_queries, state_queries, gate_queries, evidence_queries, report_queries, helper_queries)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
