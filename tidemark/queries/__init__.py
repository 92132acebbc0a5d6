"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from tidemark.queries import checks, checks_sql, core, core_sql, flows, monitoring, monitoring_sql, panels, payments, payments_sql, platform


def all_queries() -> dict:
    return payments.queries() | core.queries() | flows.queries() | platform.queries() | panels.queries() | monitoring.queries() | checks.queries()


def all_sql() -> dict[str, str]:
    return payments_sql.sql() | core_sql.sql() | panels.sql() | monitoring_sql.sql() | checks_sql.sql()
