"""Oracles for the event ledger."""

from __future__ import annotations

from checks.ctes import cte, with_ctes

_OBS = "chain_id, contract_address, block_number, block_hash, tx_hash, tx_index, log_index, event_name, deal_id, observed_at, ord1, ord2"

cte("outcomes", f"""
SELECT {_OBS}, CASE WHEN held IS NULL THEN 'inserted' WHEN held <> block_hash THEN 'updated_reorg' ELSE 'duplicate_ignored' END AS outcome
FROM (SELECT *, lag(block_hash) OVER (PARTITION BY chain_id, tx_hash, log_index ORDER BY observed_at, ord1, ord2, block_hash) AS held FROM observations)
""", "observations")
cte("current_rows", f"""
SELECT {_OBS} FROM outcomes WHERE outcome <> 'duplicate_ignored'
QUALIFY row_number() OVER (PARTITION BY chain_id, tx_hash, log_index ORDER BY observed_at DESC, ord1 DESC, ord2 DESC, block_hash DESC) = 1
""", "outcomes")


def _confirmation(prefix: str, preconfirmed: str) -> None:
    cte(f"{prefix}_events", f"SELECT *, CASE WHEN {preconfirmed} THEN 'confirmed' ELSE 'observed' END AS state FROM current_rows", "current_rows")
    cte(f"{prefix}_pending", f"""
SELECT DISTINCT chain_id, contract_address, block_number, block_hash FROM {prefix}_events
WHERE state = 'observed' AND block_number <= (SELECT max(block_number) FROM canonical_blocks c WHERE c.chain_id = {prefix}_events.chain_id) - 5
""", f"{prefix}_events", "canonical_blocks")
    cte(f"{prefix}_bad", f"""
SELECT chain_id, contract_address, min(p.block_number) FILTER (WHERE c.block_hash IS DISTINCT FROM p.block_hash) AS first_bad
FROM {prefix}_pending p LEFT JOIN canonical_blocks c USING (chain_id, block_number) GROUP BY ALL
""", f"{prefix}_pending")
    cte(f"{prefix}_confirmed", f"""
SELECT chain_id, tx_hash, log_index, contract_address, block_number, event_name,
       CASE WHEN state = 'observed' AND (first_bad IS NULL OR block_number < first_bad)
             AND block_number <= (SELECT max(block_number) FROM canonical_blocks c WHERE c.chain_id = {prefix}_events.chain_id) - 5 THEN 'confirmed' ELSE state END AS confirmation_state,
       coalesce(block_number >= first_bad, FALSE) AS is_orphaned, state = 'confirmed' AS was_confirmed
FROM {prefix}_events LEFT JOIN {prefix}_bad USING (chain_id, contract_address)
""", f"{prefix}_bad")


_confirmation("pre", "log_index = 4")
_confirmation("fresh", "FALSE")

_UNITS = "CAST(replace(CAST(CAST(notional AS DECIMAL(38,18)) AS VARCHAR), '.', '') AS HUGEINT)"
_ADDRESS = "'0x00000000' || md5({})"
_TOP = "115792089237316195423570985008687907853269984665640564039457584007913129639935"

ORACLES: dict[str, str] = {
    "logs_scan_range": with_ctes("observations", "SELECT * FROM observations WHERE contract_address = 'c1' AND block_number BETWEEN 1500 AND 1600"),
    "decode_logs": with_ctes("lifecycle deals", f"""
, e AS (SELECT l.*, d.depositor, d.counterparty, d.settlement_asset, {_UNITS.replace('notional', 'l.notional')} AS units FROM lifecycle l JOIN deals d USING (deal_id))
, k AS (SELECT *, event_name = 'RiskEscrowCreated' AS c, event_name = 'RiskEscrowSettled' AS s, event_name = 'RiskEscrowRefunded' AS r FROM e)
SELECT 1 AS chain_id, 'c' || (deal_id % 3) AS contract_address, date_diff('day', DATE '1995-01-01', CAST(event_ts AS DATE)) AS block_number,
       '0x' || md5('tx' || deal_id) AS tx_hash, log_index, event_name, deal_id,
       CASE WHEN c THEN quote_id || repeat('0', 32) END AS quoteId,
       CASE WHEN NOT s THEN {_ADDRESS.format('depositor')} END AS depositor,
       CASE WHEN NOT r THEN {_ADDRESS.format('counterparty')} END AS counterparty,
       CASE WHEN c THEN coalesce({_ADDRESS.format('settlement_asset')}, '0x' || repeat('0', 40)) END AS settlementAsset,
       CASE WHEN c THEN CAST(units AS VARCHAR) END AS notional, CASE WHEN c THEN CAST(units * 2 AS VARCHAR) END AS collateralLocked,
       CASE WHEN c THEN CAST(CAST(epoch(event_ts) AS BIGINT) + 604800 AS VARCHAR) END AS settlementDeadline,
       CASE WHEN c THEN 'garch_1_1-v1' END AS modelVersion,
       CASE WHEN c THEN '0x' || md5('snap' || deal_id) || repeat('0', 32) END AS riskSnapshotHash,
       CASE WHEN s THEN CASE WHEN deal_id % 10 = 0 THEN '{_TOP}' ELSE CAST(units AS VARCHAR) END END AS payout,
       CASE WHEN s THEN CAST(deal_id % 1000 AS VARCHAR) END AS platformFee, CASE WHEN s THEN CAST(units AS VARCHAR) END AS depositorRefund,
       CASE WHEN r THEN CAST(units * 2 AS VARCHAR) END AS amount FROM k
"""),
    "event_decode_rejects": with_ctes("lifecycle", """
, r AS (SELECT deal_id AS source_deal, deal_id, event_name, log_index, CASE event_name
  WHEN 'RiskEscrowCreated' THEN CASE
    WHEN deal_id % 31 = 0 THEN 'field "depositor": invalid address "0x12"'
    WHEN deal_id % 23 = 0 THEN 'field "notional": invalid decimal integer "1.5"'
    WHEN deal_id % 19 = 0 THEN 'missing field "notional"'
    WHEN deal_id % 47 = 0 THEN 'field "riskSnapshotHash": invalid bytes32 "0xzz"' END
  WHEN 'RiskEscrowSettled' THEN CASE WHEN deal_id % 29 = 0 THEN 'missing field "payout"' END
  ELSE CASE WHEN deal_id % 31 = 0 THEN 'field "depositor": invalid address "0x12"'
            WHEN deal_id % 37 = 0 THEN 'field "amount": invalid decimal integer "abc"' END END AS reason FROM lifecycle)
SELECT * FROM r WHERE reason IS NOT NULL
"""),
    "observation_outcomes": with_ctes("outcomes", f"SELECT {_OBS}, outcome, count(*) AS n_observations FROM outcomes GROUP BY ALL"),
    "observation_current": with_ctes("current_rows", "SELECT * FROM current_rows"),
    "split_range": with_ctes("observations", """
, s AS (SELECT chain_id, contract_address, min(block_number) AS f, least(max(block_number), min(block_number) + 399) AS batch_end FROM observations GROUP BY ALL)
SELECT chain_id, contract_address, batch_end, chunk_from, least(chunk_from + 99, batch_end) AS chunk_to
FROM (SELECT *, unnest(range(f, batch_end + 1, 100)) AS chunk_from FROM s)
"""),
    "reorg_rewind": with_ctes("observations canonical_blocks", """
, s AS (SELECT *, top - 3 * d AS b FROM (SELECT chain_id, contract_address, CAST(substr(contract_address, 2, 1) AS INTEGER) AS d, max(block_number) AS top
  FROM observations GROUP BY ALL))
, k AS (SELECT *, CASE d WHEN 2 THEN '' ELSE '0x' || md5(CAST(b AS VARCHAR) || CASE d WHEN 0 THEN 'a' ELSE 'b' END || chain_id) END AS h FROM s)
, m AS (SELECT k.*, h <> '' AND b <> 0 AND c.block_hash IS DISTINCT FROM h AS reorg FROM k LEFT JOIN canonical_blocks c ON c.chain_id = k.chain_id AND c.block_number = b)
, t AS (SELECT *, CASE WHEN reorg THEN CASE WHEN b <= 5 THEN 0 ELSE greatest(b - 5, 0) END ELSE b END AS target FROM m)
SELECT t.chain_id, contract_address, reorg, CASE WHEN reorg THEN target + 1 END AS orphan_from_block, target AS last_scanned_block,
       CASE WHEN reorg THEN CASE WHEN target <> 0 THEN c.block_hash END ELSE h END AS last_scanned_block_hash,
       least(b - 2, CASE WHEN reorg THEN target ELSE b - 2 END) AS last_confirmed_block
FROM t LEFT JOIN canonical_blocks c ON c.chain_id = t.chain_id AND c.block_number = target
"""),
    "pending_blocks": with_ctes("pre_pending", "SELECT * FROM pre_pending"),
    "confirm_blocks": with_ctes("pre_confirmed", "SELECT * FROM pre_confirmed"),
    "event_state_counts": with_ctes("pre_confirmed", "SELECT confirmation_state, is_orphaned, event_name, count(*) AS n_events FROM pre_confirmed GROUP BY ALL"),
    "derive_deals": with_ctes("lifecycle deals", """
, e AS (SELECT *, date_diff('day', DATE '1995-01-01', CAST(event_ts AS DATE)) AS block_number, '0x' || md5('tx' || deal_id || event_name) AS tx_hash FROM lifecycle WHERE deal_id % 13 <> 0)
, c AS (SELECT e.*, d.depositor, d.counterparty, d.settlement_asset, CAST(e.notional * 2 AS DECIMAL(20,8)) AS required_collateral,
  'garch_1_1-v1' AS model_version, '0x' || md5('snap' || deal_id) AS risk_snapshot_hash, event_ts + d.horizon_days * INTERVAL 1 DAY AS settlement_deadline
  FROM e JOIN deals d USING (deal_id) WHERE event_name = 'RiskEscrowCreated')
, t AS (SELECT deal_id, event_name, block_number, tx_hash FROM e WHERE event_name <> 'RiskEscrowCreated' QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY block_number, log_index) = 1)
, p AS (SELECT quote_id, depositor, CAST(notional + 1 AS DECIMAL(20,8)) AS notional, 'pending' AS status FROM deals WHERE deal_id % 7 <> 0)
SELECT quote_id, CASE WHEN c.deal_id % 3 = 2 THEN 2 WHEN c.deal_id IS NOT NULL THEN 1 END AS chain_id, 'c' || (c.deal_id % 3) AS contract_address, c.deal_id // 3 AS deal_id,
       coalesce(c.depositor, p.depositor) AS depositor, c.counterparty, c.settlement_asset, coalesce(c.notional, p.notional) AS notional, required_collateral, model_version,
       risk_snapshot_hash, settlement_deadline, c.block_number, c.tx_hash, t.block_number AS terminal_block_number, t.tx_hash AS terminal_tx_hash,
       CASE WHEN c.deal_id IS NULL THEN p.status WHEN t.event_name = 'RiskEscrowSettled' THEN 'settled' WHEN t.event_name = 'RiskEscrowRefunded' THEN 'refunded' ELSE 'active' END AS status,
       t.event_name AS terminal_event
FROM c LEFT JOIN t ON t.deal_id = c.deal_id FULL JOIN p USING (quote_id)
"""),
    "config_state": with_ctes("current_rows", """
SELECT chain_id, contract_address,
       arg_max('o' || ord1, (block_number, tx_index, log_index, tx_hash)) FILTER (WHERE event_name = 'RiskOracleUpdated') AS risk_oracle,
       arg_max(CAST(ord2 % 1000 AS VARCHAR), (block_number, tx_index, log_index, tx_hash)) FILTER (WHERE event_name = 'PlatformFeeUpdated') AS platform_fee_bps,
       arg_max('w' || ord1, (block_number, tx_index, log_index, tx_hash)) FILTER (WHERE event_name = 'PlatformWalletUpdated') AS platform_wallet,
       max(block_number) AS updated_at_block
FROM current_rows WHERE event_name IN ('RiskOracleUpdated', 'PlatformFeeUpdated', 'PlatformWalletUpdated') GROUP BY ALL
"""),
    "checkpoint_latest": with_ctes("observations", """
SELECT * FROM (
  SELECT chain_id, contract_address, observed_at AS updated_at, max(block_number) AS last_scanned_block, min(block_hash) AS last_scanned_block_hash
  FROM observations GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chain_id, contract_address ORDER BY updated_at DESC) = 1
"""),
    "ingest_health": with_ctes("outcomes fresh_confirmed", """
, o AS (SELECT chain_id, contract_address, max(block_number) AS last_scanned_block, count(*) FILTER (WHERE outcome <> 'duplicate_ignored') AS total_events_processed,
  count(*) FILTER (WHERE outcome = 'duplicate_ignored') AS duplicate_events_ignored, count(*) FILTER (WHERE outcome = 'updated_reorg') AS reorg_count FROM outcomes GROUP BY ALL)
, c AS (SELECT chain_id, contract_address, coalesce(max(block_number) FILTER (WHERE confirmation_state = 'confirmed' AND NOT is_orphaned), 0) AS last_confirmed_block
  FROM fresh_confirmed GROUP BY ALL)
SELECT *, 5 AS confirmation_depth, chain_head - last_confirmed_block AS confirmed_lag_blocks
FROM (SELECT *, (SELECT max(block_number) FROM canonical_blocks b WHERE b.chain_id = o.chain_id) AS chain_head FROM o JOIN c USING (chain_id, contract_address))
"""),
    "health_class": """
SELECT snapshot_id, CASE WHEN missing THEN 'unreachable' WHEN stale THEN 'degraded' WHEN lag > 15 THEN 'lagging' ELSE 'healthy' END AS health,
       CASE WHEN missing THEN 'Could not reach the chain indexer’s health endpoint.' WHEN stale AND err THEN 'Last error: e' || snapshot_id
            WHEN stale THEN 'No successful RPC call in over 60s.' WHEN lag > 15 THEN lag || ' blocks behind head (expected up to ~5).'
            ELSE 'Synced within the expected confirmation depth.' END AS detail
FROM (SELECT o_orderkey AS snapshot_id, o_orderkey % 13 = 0 AS missing, o_orderkey % 11 = 0 OR o_orderkey % 120 > 60 AS stale,
             o_orderkey % 7 = 0 AS err, o_custkey % 40 AS lag FROM orders)
""",
}
