"""All registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from framewright.plans.queries import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
