"""All registered queries."""

from __future__ import annotations

from tidemark.plans import deal_plans, ledger_plans, market, risk_plans, stream_plans
from tidemark.plans.common import Query

QUERIES: dict[str, Query] = {**market.QUERIES, **risk_plans.QUERIES, **ledger_plans.QUERIES, **deal_plans.QUERIES, **stream_plans.QUERIES}
