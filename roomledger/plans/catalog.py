"""All named queries, collected from the plan modules."""

from __future__ import annotations

from roomledger.plans import evaluation, forecasts, guests, learning, policies, reporting  # noqa: F401
from roomledger.plans.registry import PLANS, SQL, Plan


def queries() -> dict[str, Plan]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
