"""All queries of the scan operators."""

from __future__ import annotations

from scanspark.plans import geometry_queries, join_queries, map_queries, metric_queries, motion_queries, pixel_queries, planning_queries, source_queries, surface_queries

MODULES = [pixel_queries, join_queries, map_queries, metric_queries, planning_queries, geometry_queries, surface_queries, source_queries, motion_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
