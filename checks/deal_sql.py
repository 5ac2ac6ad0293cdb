"""Oracles for deals, quotes, settlement and the scalar expressions."""

from __future__ import annotations

from checks.ctes import cte, with_ctes

_UNITS = "CAST(replace(CAST(CAST(notional AS DECIMAL(38,18)) AS VARCHAR), '.', '') AS HUGEINT)"

cte("placed", """
SELECT *, CASE WHEN deal_id % 13 <> 0 THEN 1 END AS chain_id, CASE WHEN deal_id % 13 <> 0 THEN 'c' || (deal_id % 3) END AS contract_address FROM deals
""", "deals")
cte("life_events", """
SELECT 1 AS chain_id, 'c' || (deal_id % 3) AS contract_address, deal_id, quote_id, event_name, log_index,
       date_diff('day', DATE '1995-01-01', CAST(event_ts AS DATE)) AS block_number, '0x' || md5('tx' || deal_id || event_name) AS tx_hash, event_ts AS observed_at,
       CASE WHEN event_ts < TIMESTAMP '2001-01-01' THEN 'confirmed' ELSE 'observed' END AS confirmation_state, deal_id % 17 = 0 AND log_index > 0 AS is_orphaned
FROM lifecycle
""", "lifecycle")
def _differs(name: str) -> str:
    return f"'Quote field \"{name}\" does not match the quote this server issued'"


cte("audited", f"""
SELECT s.*, CASE
    WHEN signature IS NULL THEN 'Missing required fields: quote, signature'
    WHEN depositor = '' THEN 'Incomplete RiskQuote: missing depositor'
    WHEN model_version IS NULL THEN 'Incomplete RiskQuote: missing modelVersion'
    WHEN unknown THEN 'Unknown quote: no matching quote was issued by this server'
    WHEN counterparty <> i_counterparty THEN {_differs('counterparty')}
    WHEN key % 43 = 1 THEN {_differs('settlementAsset')}
    WHEN key % 37 = 0 THEN {_differs('notional')}
    WHEN key % 47 = 1 THEN {_differs('requiredCollateral')}
    WHEN key % 53 = 1 THEN {_differs('quoteExpiration')}
    WHEN key % 59 = 1 THEN {_differs('settlementHorizon')}
    WHEN key % 61 = 1 THEN {_differs('modelVersion')}
    WHEN key % 67 = 1 THEN {_differs('riskSnapshotHash')}
    WHEN key % 29 = 0 THEN 'Signature does not match the issued quote'
    WHEN key % 3 = 2 THEN 'This quote was issued for a different chain or contract'
    WHEN key % 23 = 0 THEN 'Quote has expired; request a new one'
    WHEN used THEN 'This quote has already been used to create an escrow' END AS reject_reason
FROM (SELECT s.* REPLACE (CASE WHEN substr(s.quote_id, 3, 2) = '0f' THEN '' ELSE s.depositor END AS depositor), d.counterparty AS i_counterparty,
             d.deal_id AS key, d.deal_id % 50 = 3 AS unknown, d.status = 'settled' AND d.deal_id % 5 = 0 AS used
      FROM submissions s JOIN deals d USING (quote_id)) s
""", "submissions", "deals")
cte("amounts", f"""
SELECT deal_id, n AS notional_units, n + deal_id AS collateral_units, deal_id % 1000 AS fee_bps, (n * (deal_id % 1000)) // 10000 AS platform_fee,
       n - (n * (deal_id % 1000)) // 10000 AS payout, CAST(deal_id AS HUGEINT) AS depositor_refund
FROM (SELECT deal_id, {_UNITS} AS n FROM deals)
""", "deals")


def _d30(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DECIMAL(30,0)) AS {n}" for n in names)


def grouped(int_text: str) -> str:
    return f"regexp_replace({int_text}, '(\\d)(?=(\\d{{3}})+$)', '\\1,', 'g')"


_INT, _FRAC = "CAST(CAST(floor(notional) AS BIGINT) AS VARCHAR)", "lpad(CAST(CAST((notional - floor(notional)) * 100 AS INTEGER) AS VARCHAR), 2, '0')"
_COMMA = "format('{:,}', CAST(floor(notional) AS BIGINT))"

ORACLES: dict[str, str] = {
    "quote_request_validation": with_ctes("deals", """
, r AS (SELECT deal_id AS request_id, CASE deal_id % 10 WHEN 0 THEN '1e3' WHEN 1 THEN 'abc' WHEN 2 THEN '-5' WHEN 3 THEN '' WHEN 5 THEN '0' WHEN 4 THEN NULL
    ELSE CAST(notional AS VARCHAR) END AS notional_text, CASE WHEN deal_id % 37 = 0 THEN 'XRP' ELSE 'A' END AS asset,
    CASE WHEN deal_id % 31 = 0 THEN 2 ELSE horizon_days END AS horizon_days,
    CASE WHEN deal_id % 41 = 0 THEN 0.9e0 WHEN deal_id % 2 = 0 THEN 0.95e0 ELSE 0.99e0 END AS confidence FROM deals)
SELECT *, CASE WHEN notional_text IS NULL OR notional_text = '' THEN 'missing notional' WHEN notional_text = 'abc' THEN 'notional is not a valid decimal string'
    WHEN notional_text IN ('-5', '0') OR try_cast(notional_text AS DOUBLE) = 0 THEN 'notional must be positive' WHEN asset = 'XRP' THEN 'unsupported asset' WHEN horizon_days = 2 THEN 'unsupported horizon'
    WHEN confidence = 0.9e0 THEN 'unsupported confidence' END AS reject_reason FROM r
"""),
    "settlement_asset_normalize": with_ctes("deals", """
SELECT deal_id, CASE WHEN deal_id % 4 = 0 THEN '0xabcdef00' || md5(depositor) END AS settlement_asset, CASE WHEN deal_id % 4 = 0 THEN 'ERC20' ELSE 'POL' END AS label FROM deals
"""),
    "allowed_assets": """
SELECT s_suppkey AS owner, '0xaa000000' || md5('a' || s_suppkey) AS address, 'T' || s_suppkey AS symbol, s_name AS label, 6 AS decimals FROM supplier WHERE s_suppkey % 10 <> 3
UNION ALL SELECT s_suppkey, '0xaa000000' || md5('b' || s_suppkey), 'T' || s_suppkey, 'T' || s_suppkey, 18 FROM supplier WHERE s_suppkey % 10 <> 3
""",
    "deal_lookup": with_ctes("placed", """
, k AS (SELECT 1 AS chain_id, 'c' || (deal_id % 3) AS contract_address, deal_id AS d, CASE WHEN deal_id % 19 = 0 THEN 'x' || deal_id
    WHEN deal_id % 23 = 0 THEN CAST(deal_id + 1000000000000 AS VARCHAR) ELSE CAST(deal_id AS VARCHAR) END AS deal_id_text FROM deals)
SELECT k.chain_id, k.contract_address, try_cast(deal_id_text AS BIGINT) AS deal_id, deal_id_text, p.status,
       CASE WHEN d % 19 = 0 THEN 'dealId must be a non-negative integer' WHEN p.status IS NULL THEN 'Not indexed yet' END AS error,
       coalesce(p.status IN ('active', 'settled', 'refunded'), FALSE) AS confirmed
FROM k LEFT JOIN placed p ON p.chain_id = k.chain_id AND p.contract_address = k.contract_address AND p.deal_id = try_cast(deal_id_text AS BIGINT)
"""),
    "deal_timeline": with_ctes("life_events", """
SELECT chain_id, contract_address, deal_id, block_number, log_index, tx_hash,
       CASE event_name WHEN 'RiskEscrowCreated' THEN 'Escrow created' WHEN 'RiskEscrowSettled' THEN 'Escrow settled' ELSE 'Escrow refunded' END AS title,
       strftime(observed_at, '%Y-%m-%d %H:%M') || ' UTC' AS timestamp,
       CASE WHEN is_orphaned THEN 'critical' WHEN confirmation_state = 'confirmed' THEN 'positive' ELSE 'info' END AS tone,
       CASE WHEN is_orphaned THEN 'orphaned (reorg)' ELSE confirmation_state END AS badge,
       'block ' || block_number || ' · ' || substr(tx_hash, 1, 8) || '…' || right(tx_hash, 6) AS detail FROM life_events
"""),
    "escrows_recent": with_ctes("placed", """
SELECT deal_id, quote_id, depositor, counterparty, notional, status, created_at FROM placed
WHERE chain_id IS NULL OR contract_address = 'c1' ORDER BY created_at DESC, deal_id DESC LIMIT 25
"""),
    "escrows_recent_party": with_ctes("placed", """
SELECT deal_id, quote_id, depositor, counterparty, notional, status, created_at FROM placed
WHERE (chain_id IS NULL OR contract_address = 'c1') AND (depositor = 's7' OR counterparty = 's7') ORDER BY created_at DESC, deal_id DESC LIMIT 25
"""),
    "quotes_insert_ignore": with_ctes("risk_quotes", """
SELECT quote_id, depositor, notional_wei, CASE WHEN substr(quote_id, 3, 1) < '8' THEN issued_at ELSE issued_at + INTERVAL 1 MINUTE END AS issued_at FROM risk_quotes
"""),
    "quote_submission_audit": with_ctes("audited", "SELECT quote_id, submitted_at, reject_reason FROM audited"),
    "pending_deals": with_ctes("audited", """
SELECT quote_id, depositor, counterparty, left(notional_wei, length(notional_wei) - 18) || '.' || substr(notional_wei, length(notional_wei) - 17, 2) AS amount,
       'pending' AS status, 'pending' AS payment_status, CASE WHEN substr(quote_id, 4, 1) < '8' THEN 'ERC20' ELSE 'POL' END AS crypto_currency, notional_wei AS notional,
       CASE WHEN substr(quote_id, 4, 1) < '8' THEN '0xtoken' END AS settlement_asset, settlement_horizon AS settlement_horizon_seconds, depositor AS payment_from,
       CASE WHEN substr(quote_id, 3, 1) < '8' THEN 1 ELSE 0 END AS n_rejected_repeats FROM audited WHERE reject_reason IS NULL
"""),
    "payment_records": with_ctes("audited", """
SELECT quote_id AS escrow_id, left(notional_wei, length(notional_wei) - 18) || '.' || substr(notional_wei, length(notional_wei) - 17, 2) AS amount,
       CASE WHEN substr(quote_id, 4, 1) < '8' THEN 'ERC20' ELSE 'POL' END AS crypto_currency, 'crypto' AS payment_method, 'USD' AS currency, 'pending' AS status,
       depositor AS from_address, counterparty AS to_address FROM audited WHERE reject_reason IS NULL
"""),
    "tx_verification": with_ctes("deals", """
, r AS (SELECT deal_id AS escrow_id, CASE WHEN deal_id % 43 <> 0 THEN quote_id END AS quote_id, '0x' || md5('tx' || deal_id) AS tx_hash, CASE
    WHEN deal_id % 43 = 0 THEN 'Escrow has no associated quote_id to verify against' WHEN deal_id % 17 = 0 THEN 'Transaction not found or not yet mined'
    WHEN deal_id % 31 = 0 THEN 'Transaction reverted on-chain' WHEN deal_id % 3 = 2 THEN 'Transaction does not target this deployment''s settlement contract'
    WHEN deal_id % 47 = 0 THEN 'Transaction did not emit a RiskEscrowCreated event for this escrow''s quote' END AS reject_reason FROM deals)
SELECT *, CASE WHEN reject_reason IS NULL THEN escrow_id END AS on_chain_deal_id FROM r
"""),
    "deal_detail": with_ctes("deals risk_quotes", """
SELECT deal_id, d.quote_id, notional, CAST(notional * 1.5 AS DECIMAL(20,8)) AS required_collateral, model_version, CAST(CAST(notional * 1.5 AS DECIMAL(20,8)) - notional AS DECIMAL(20,8)) AS buffer,
       CASE WHEN model_version IS NULL OR deal_id % 7 = 0 THEN NULL ELSE deal_id % 5 <> 0 END AS hashes_match
FROM deals d LEFT JOIN risk_quotes q USING (quote_id)
"""),
    "deal_display_status": with_ctes("deals life_events", """
, d AS (SELECT deal_id, CASE WHEN deal_id % 7 = 0 THEN 'pending' WHEN deal_id % 11 = 0 THEN 'cancelled' WHEN deal_id % 5 = 0 THEN 'active' ELSE status END AS status, deal_id % 2 = 0 AS has_submitted_tx FROM deals)
, l AS (SELECT deal_id, event_name AS e, confirmation_state = 'observed' AS o FROM life_events WHERE NOT is_orphaned
  QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY block_number DESC, log_index DESC, tx_hash DESC) = 1)
, s AS (SELECT d.*, CASE status WHEN 'settled' THEN 'Settled' WHEN 'refunded' THEN 'Refunded' WHEN 'cancelled' THEN 'Cancelled'
    WHEN 'active' THEN CASE WHEN o AND e = 'RiskEscrowSettled' THEN 'Active — settlement observed' WHEN o AND e = 'RiskEscrowRefunded' THEN 'Active — refund observed' ELSE 'Active' END
    ELSE CASE WHEN o AND e = 'RiskEscrowCreated' THEN 'Observed — awaiting confirmation' WHEN has_submitted_tx THEN 'Submitted — not yet observed' ELSE 'Pending' END END AS label
  FROM d LEFT JOIN l USING (deal_id))
SELECT status, has_submitted_tx, label, CASE WHEN deal_id % 3 = 2 THEN 2 ELSE 1 END AS chain_id, 'c' || (deal_id % 3) AS contract_address, deal_id // 3 AS deal_id, CASE WHEN label IN ('Settled', 'Active') THEN 'positive' WHEN label IN ('Refunded', 'Cancelled', 'Pending') THEN 'neutral' WHEN label LIKE 'Submitted%' THEN 'warning' ELSE 'info' END AS tone,
       label IN ('Settled', 'Refunded', 'Cancelled', 'Active') AS confirmed FROM s
"""),
    "settlement_amounts": with_ctes("amounts", f"""
SELECT deal_id, {_d30('notional_units', 'collateral_units', 'platform_fee', 'payout', 'depositor_refund')}, fee_bps FROM amounts
"""),
    "total_locked": with_ctes("deals", """
SELECT settlement_asset, CAST(coalesce(sum(CASE WHEN status = 'active' THEN notional * 2 END), 0) AS DECIMAL(38,8)) AS locked FROM deals GROUP BY settlement_asset
"""),
    "asset_surplus": with_ctes("deals", """
SELECT settlement_asset, CAST(b AS DECIMAL(38,8)) AS balance, CAST(l AS DECIMAL(38,8)) AS locked, CAST(greatest(b - l, 0) AS DECIMAL(38,8)) AS surplus
FROM (SELECT settlement_asset, sum(notional) AS b, coalesce(sum(CASE WHEN status = 'active' THEN notional * 2 END), 0) AS l FROM deals GROUP BY settlement_asset)
"""),
    "deal_rule_audit": with_ctes("deals", """
, r AS (SELECT deal_id, depositor, CASE WHEN deal_id % 79 = 0 THEN 0 ELSE notional END AS n, CASE WHEN deal_id % 83 = 0 THEN 1 ELSE notional * 2 END AS c,
    CASE WHEN deal_id % 71 = 0 THEN '' WHEN deal_id % 73 = 0 THEN depositor ELSE counterparty END AS cp FROM deals)
SELECT deal_id, array_to_string(list_filter([
    CASE WHEN deal_id % 67 = 0 THEN 'Caller is not the quoted depositor' END, CASE WHEN cp = '' THEN 'Invalid counterparty' END,
    CASE WHEN cp = depositor THEN 'Depositor cannot equal counterparty' END, CASE WHEN n <= 0 THEN 'Notional must be greater than 0' END,
    CASE WHEN c < n THEN 'Collateral must cover notional' END, CASE WHEN deal_id % 59 = 0 OR deal_id % 61 = 0 THEN 'Settlement horizon out of bounds' END,
    CASE WHEN deal_id % 89 = 0 THEN 'Risk quote already used' END, CASE WHEN deal_id % 97 = 0 THEN 'Risk quote expired' END], lambda e: e IS NOT NULL), '; ') AS violations FROM r
"""),
    "deal_refundable": with_ctes("deals", """
SELECT deal_id, created_at + horizon_days * INTERVAL 1 DAY AS settlement_deadline, status = 'active' AS settleable,
       status = 'active' AND TIMESTAMP '2000-01-01 12:00:00' > created_at + horizon_days * INTERVAL 1 DAY AS refundable FROM deals
"""),
    "settlement_reconciliation": with_ctes("lifecycle", """
SELECT CASE WHEN deal_id % 3 = 2 THEN 2 ELSE 1 END AS chain_id, 'c' || (deal_id % 3) AS contract_address, deal_id // 3 AS deal_id, event_name, CASE WHEN event_name = 'RiskEscrowSettled' THEN CASE WHEN deal_id % 29 = 0 THEN 1::BIGINT ELSE 0 END END AS payout_diff,
       CASE WHEN event_name = 'RiskEscrowSettled' THEN 0::BIGINT END AS fee_diff,
       CASE WHEN event_name = 'RiskEscrowSettled' THEN 0::BIGINT WHEN deal_id % 31 = 0 THEN -1 ELSE 0 END AS refund_diff
FROM lifecycle WHERE event_name <> 'RiskEscrowCreated'
"""),
    "risk_vs_outcome": with_ctes("risk_quotes deals lifecycle", """
, t AS (SELECT deal_id, event_name FROM lifecycle WHERE event_name <> 'RiskEscrowCreated' QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY event_ts, log_index) = 1)
SELECT CASE t.event_name WHEN 'RiskEscrowSettled' THEN 'settled' WHEN 'RiskEscrowRefunded' THEN 'refunded' ELSE 'open' END AS outcome, d.horizon_days,
       count(*) AS n_deals, CAST(sum(d.notional) AS DECIMAL(38,8)) AS notional
FROM risk_quotes q JOIN deals d USING (quote_id) LEFT JOIN t ON t.deal_id = d.deal_id GROUP BY ALL
"""),
    "legacy_migration": """
SELECT o_orderkey AS id, 'w' || o_custkey AS depositor_wallet_address, c_name AS counterparty_wallet_address, CAST(o_totalprice AS DECIMAL(20,2)) AS amount,
       (o_orderkey % 9) * 60 AS duration_minutes, o_orderstatus AS status, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "constraint_violations": with_ctes("placed life_events", """
, d AS (SELECT deal_id, quote_id, chain_id, contract_address, CASE WHEN deal_id % 53 = 0 THEN 'confirmed' ELSE status END AS status, CASE WHEN deal_id % 59 = 0 THEN 'refund' ELSE 'succeeded' END AS payment_status
  FROM placed)
, r AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE deal_id % 97 = 0)
SELECT 'status not allowed' AS rule, status AS value, count(*) AS n_rows FROM r WHERE status = 'confirmed' GROUP BY ALL
UNION ALL SELECT 'payment_status not allowed', payment_status, count(*) FROM r WHERE payment_status = 'refund' GROUP BY ALL
UNION ALL SELECT 'confirmation_state not allowed', 'final', count(*) FROM life_events WHERE deal_id % 61 = 0 GROUP BY ALL
UNION ALL SELECT 'quote_id not unique', quote_id, count(*) FROM r GROUP BY quote_id HAVING count(*) > 1
UNION ALL SELECT 'chain_id,contract_address,deal_id not unique', '1,' || contract_address || ',' || deal_id, count(*) FROM r
  WHERE chain_id IS NOT NULL GROUP BY contract_address, deal_id HAVING count(*) > 1
UNION ALL SELECT 'tx_hash,log_index not unique', tx_hash || ',' || log_index, count(*) FROM life_events GROUP BY tx_hash, log_index HAVING count(*) > 1
"""),
    "scalar_fixed_point": with_ctes("submissions", """
, u AS (SELECT *, CAST(notional_wei AS HUGEINT) AS w, CAST(left(notional_wei, length(notional_wei) - 18) || '.' || right(notional_wei, 18) AS DECIMAL(38,18)) AS amount FROM submissions)
, c AS (SELECT *, CAST(w // 10000000000 AS HUGEINT) AS e8 FROM u)
SELECT quote_id, amount, CAST(w AS DECIMAL(38,0)) AS units, CAST((w + 3 * 10000000000000000 - 1) // (3 * 10000000000000000) AS DECIMAL(38,0)) AS third_up_cents,
       CAST(CAST(w // 100000000000000000 AS DECIMAL(20,0)) * 0.1 AS DECIMAL(20,1)) AS tenths_down,
       CAST(CAST((w + 50000000000000000) // 100000000000000000 AS DECIMAL(20,0)) * 0.1 AS DECIMAL(20,1)) AS tenths_half_up,
       CAST(CAST((w + 99999999999999999) // 100000000000000000 AS DECIMAL(20,0)) * 0.1 AS DECIMAL(20,1)) AS tenths_up,
       CAST(CAST((e8 * 1075 + 999999999) // 1000000000 AS DECIMAL(20,0)) * 0.01 AS DECIMAL(22,2)) AS marked_up, TRUE AS is_units, CAST(NULL AS VARCHAR) AS signature_number,
       CAST(CAST(settlement_horizon AS BIGINT) AS VARCHAR) AS horizon_number, CAST(settlement_horizon AS BIGINT) AS horizon_seconds FROM c
"""),
    "scalar_format": with_ctes("deals", f"""
, f AS (SELECT *, deal_id * 37 % 400000 AS s, deal_id % 10007 AS p, CAST(epoch(created_at) - epoch(TIMESTAMP '2000-01-01 12:00:00') AS BIGINT) AS seconds_left FROM deals)
SELECT deal_id, {_COMMA} || '.' || {_FRAC} AS grouped, {_INT} || rtrim(rtrim('.' || {_FRAC}, '0'), '.') AS plain,
       (p // 100) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') || '%' AS percent, {_COMMA} || rtrim(rtrim('.' || {_FRAC}, '0'), '.') || ' ETH' AS token_text,
       '$' || {_COMMA.replace('notional', 'notional * 2')} || '.' || {_FRAC.replace('notional', '(notional * 2)')} AS usd_text, strftime(created_at, '%Y-%m-%d %H:%M') || ' UTC' AS utc_text,
       CASE WHEN s < 60 THEN s || 's' ELSE array_to_string(list_filter([CASE WHEN s >= 86400 THEN (s // 86400) || 'd' END, CASE WHEN s >= 3600 THEN ((s // 3600) % 24) || 'h' END,
         ((s // 60) % 60) || 'm'], lambda e: e IS NOT NULL), ' ') END AS duration_text,
       seconds_left, seconds_left <= 0 AS expired, substr(quote_id, 1, 8) || '…' || right(quote_id, 6) AS short_quote, FALSE AS same, '0.9900' AS conf_key, depositor AS decoded_depositor FROM f
"""),
}
