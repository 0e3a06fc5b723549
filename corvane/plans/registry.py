"""All registered queries and their SQL."""

from __future__ import annotations

from corvane.plans import graph_plans, report_plans, scope_plans, source_plans, text_plans

MODULES = (text_plans, graph_plans, report_plans, scope_plans, source_plans)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
