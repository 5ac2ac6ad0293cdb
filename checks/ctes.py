"""The derived inputs as DuckDB SQL, and a helper that puts the needed ones in front of a query."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(names: str, body: str) -> str:
    """``WITH RECURSIVE`` over the named inputs (space separated) and what they need, then ``body``.

    ``body`` may bring further common tables: write it as ``, x AS (...) SELECT ...``.
    """
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        needs, _ = CTES[name]
        for need in needs:
            add(need)
        done.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS (\n{CTES[name][1].strip()}\n)" for name in done]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()


cte("prices", """
SELECT g.asset, g.day,
       round(1000 * pow(first_px / 1000, 0.1), 6) AS open, round(1000 * pow(hi / 1000, 0.1), 6) AS high,
       round(1000 * pow(lo / 1000, 0.1), 6) AS low, round(1000 * pow(vwap / 1000, 0.1), 6) AS close,
       volume, row_number() OVER (PARTITION BY g.asset ORDER BY g.day) AS ingest_seq
FROM (
  SELECT asset, day, max(px) AS hi, min(px) AS lo, CAST(sum(ext) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS vwap,
         CAST(sum(qty) AS DOUBLE) AS volume
  FROM trades GROUP BY asset, day) g
JOIN (
  SELECT asset, day, px AS first_px FROM trades
  QUALIFY row_number() OVER (PARTITION BY asset, day ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, px) = 1) f
USING (asset, day)
""", "trades")
cte("trades", """
SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS day,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
       l_extendedprice / l_quantity AS px, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem
""")
cte("prices_dirty", """
SELECT asset, day, open, high, low,
       CASE WHEN asset = 'N' AND ingest_seq % 400 = 7 THEN close * 2
            WHEN asset = 'R' AND ingest_seq = 50 THEN -1.0 ELSE close END AS close,
       CASE WHEN asset = 'R' AND ingest_seq = 60 THEN -volume ELSE volume END AS volume,
       CASE WHEN asset = 'R' AND ingest_seq = 70 THEN 1000000 ELSE ingest_seq END AS ingest_seq
FROM prices WHERE NOT (asset = 'N' AND ingest_seq % 97 = 0)
UNION ALL
SELECT asset, day, open, high, low, close, volume, ingest_seq + 2000000 FROM prices
WHERE asset = 'R' AND ingest_seq % 89 = 0
""", "prices")
cte("horizons", "SELECT * FROM (VALUES (1), (7), (14), (30)) h(horizon_days)")
cte("returns", """
SELECT asset, day, row_number() OVER (PARTITION BY asset ORDER BY day) - 1 AS idx, r
FROM (SELECT asset, day, ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY day)) AS r FROM prices)
WHERE r IS NOT NULL
""", "prices")
cte("garch_params", """
SELECT * FROM (VALUES ('A', 2e-4, 8e-2, 85e-2, 0e0), ('N', 5e-4, 1e-1, 55e-2, 1e-4), ('R', 1e-5, 2e-2, 979e-3, 0e0))
p(asset, omega, alpha, beta, mu)
""")
cte("observations", """
SELECT chain_id, 'c' || CAST(l_orderkey % 3 AS VARCHAR) AS contract_address, block_number,
       '0x' || md5(CAST(block_number AS VARCHAR) || CASE WHEN block_number % 17 = 0 AND l_linestatus = 'F' THEN 'b' ELSE 'a' END || chain_id) AS block_hash,
       '0x' || md5('tx' || CAST(l_orderkey AS VARCHAR)) AS tx_hash, CAST(l_orderkey % 64 AS INT) AS tx_index, l_linenumber AS log_index,
       CASE l_linenumber WHEN 1 THEN 'RiskEscrowCreated' WHEN 2 THEN 'RiskEscrowSettled' WHEN 3 THEN 'RiskEscrowRefunded'
            WHEN 4 THEN 'RiskOracleUpdated' WHEN 5 THEN 'PlatformFeeUpdated' WHEN 6 THEN 'PlatformWalletUpdated' ELSE 'Unknown' END AS event_name,
       CASE WHEN l_linenumber <= 3 THEN l_orderkey END AS deal_id,
       l_shipdate AS observed_at, l_partkey AS ord1, l_suppkey AS ord2
FROM (SELECT *, CASE WHEN l_orderkey % 3 = 2 THEN 2 ELSE 1 END AS chain_id,
             date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) - CASE WHEN l_orderkey % 3 = 2 THEN 200 ELSE 0 END AS block_number FROM lineitem)
""")
cte("canonical_blocks", """
SELECT DISTINCT chain_id, block_number, '0x' || md5(CAST(block_number AS VARCHAR) || 'a' || chain_id) AS block_hash FROM observations
""", "observations")
cte("deals", """
SELECT o_orderkey AS deal_id, '0x' || md5('q' || CAST(o_orderkey AS VARCHAR)) AS quote_id,
       'w' || CAST(o_custkey AS VARCHAR) AS depositor, 's' || CAST(o_orderkey % 100 AS VARCHAR) AS counterparty,
       CASE WHEN o_orderkey % 4 = 0 THEN 'erc20' END AS settlement_asset,
       CAST(o_totalprice AS DECIMAL(20,8)) AS notional,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 14 ELSE 30 END AS horizon_days,
       o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'P' THEN 'refunded' ELSE 'active' END AS status
FROM orders
""")
cte("lifecycle", """
SELECT deal_id, quote_id, 'RiskEscrowCreated' AS event_name, created_at AS event_ts, 0 AS log_index, notional FROM deals
UNION ALL
SELECT deal_id, quote_id, 'RiskEscrowSettled', created_at + INTERVAL 3 DAY, 1, notional FROM deals WHERE status = 'settled'
UNION ALL
SELECT deal_id, quote_id, 'RiskEscrowRefunded', created_at + INTERVAL 40 DAY, 1, notional FROM deals WHERE status = 'refunded'
UNION ALL
SELECT deal_id, quote_id, 'RiskEscrowRefunded', created_at + INTERVAL 50 DAY, 2, notional FROM deals WHERE status = 'settled' AND deal_id % 10 = 0
""", "deals")
cte("risk_quotes", """
SELECT quote_id, 1 AS chain_id, 'c' || CAST(deal_id % 3 AS VARCHAR) AS verifying_contract, depositor, counterparty, settlement_asset,
       CAST(CAST(notional * 100 AS DECIMAL(38,0)) AS VARCHAR) || '0000000000000000' AS notional_wei,
       horizon_days * 86400 AS settlement_horizon, 'garch_1_1-v1' AS model_version,
       '0x' || md5('snap' || CAST(deal_id AS VARCHAR)) AS risk_snapshot_hash, '0x' || md5('sig' || quote_id) AS signature,
       created_at AS issued_at, created_at + INTERVAL 5 MINUTE AS quote_expiration
FROM deals
""", "deals")
_ZERO = "'0x" + "0" * 40 + "'"
cte("submissions", f"""
SELECT quote_id, depositor, CASE WHEN deal_id % 41 = 0 THEN depositor ELSE counterparty END AS counterparty,
       CASE WHEN deal_id % 43 = 1 THEN '0xtoken' ELSE coalesce(settlement_asset, {_ZERO}) END AS settlement_asset,
       CAST(CAST(notional * 100 AS DECIMAL(38,0)) AS VARCHAR) || CASE WHEN deal_id % 37 = 0 THEN '0000000000000001' ELSE '0000000000000000' END AS notional_wei,
       CASE WHEN deal_id % 47 = 1 THEN '1' ELSE CAST(CAST(notional * 200 AS DECIMAL(38,0)) AS VARCHAR) || '0000000000000000' END AS required_collateral,
       CAST(epoch(created_at) AS BIGINT) + 300 + CASE WHEN deal_id % 53 = 1 THEN 60 ELSE 0 END AS quote_expiration,
       CASE WHEN deal_id % 59 = 1 THEN 172800 ELSE horizon_days * 86400 END AS settlement_horizon,
       CASE WHEN deal_id % 61 <> 1 THEN 'garch_1_1-v1' WHEN deal_id % 2 = 0 THEN 'garch_1_1-v2' END AS model_version,
       CASE WHEN deal_id % 67 = 1 THEN '0x00' ELSE '0x' || md5('snap' || deal_id) END AS risk_snapshot_hash,
       CASE WHEN deal_id % 71 = 1 THEN NULL WHEN deal_id % 29 = 0 THEN 'bad' ELSE '0x' || md5('sig' || quote_id) END AS signature,
       created_at + CASE WHEN deal_id % 23 = 0 THEN INTERVAL 6 MINUTE ELSE INTERVAL 1 MINUTE END AS submitted_at
FROM deals
""", "deals")
cte("ticks", "SELECT event_type AS asset, ts, event_id, CAST(value AS DOUBLE) AS price, props FROM events")
