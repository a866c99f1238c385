"""All queries of the library itself."""

from __future__ import annotations

from numera.plans import analyses, arrays, flows, more, numerics, programs, semantics, tables  # noqa: F401  importing registers
from numera.plans.catalog import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
