"""All oracles, one per registered query that plain SQL can express."""

from __future__ import annotations

from checks import deal_sql, ledger_sql, market_sql, risk_sql, stream_sql

ORACLES: dict[str, str] = {**market_sql.ORACLES, **risk_sql.ORACLES, **ledger_sql.ORACLES, **deal_sql.ORACLES, **stream_sql.ORACLES}
