"""Oracles for the streaming queries: those of their batch twins."""

from __future__ import annotations

from checks.ctes import with_ctes
from checks.ledger_sql import ORACLES as LEDGER
from checks.market_sql import ORACLES as MARKET, r8

ORACLES: dict[str, str] = {
    "stream_ewma": MARKET["ewma_variance"],
    "stream_garch_update": with_ctes("early_path", f"""
SELECT asset, day, {r8('sigma2', 'eps2')}, idx - 749 AS n_updates, idx - 749 >= 21 AS refit_due FROM early_path WHERE idx >= 750
"""),
    "stream_observe": LEDGER["observation_current"],
    "stream_confirm": with_ctes("fresh_confirmed", """
SELECT contract_address, confirmation_state, is_orphaned, count(*) AS n_events FROM fresh_confirmed GROUP BY ALL
"""),
    "stream_reorg": with_ctes("current_rows", """
, tops AS (SELECT chain_id, contract_address, max(block_number) FILTER (WHERE block_number < 1000) AS scanned, max(block_number) AS top FROM observations GROUP BY ALL)
, heads AS (SELECT chain_id, max(block_number) AS head FROM observations GROUP BY ALL)
, rewound AS (SELECT chain_id, contract_address, scanned BETWEEN 990 AND 999 AS reorg, top, head,
  CASE WHEN scanned BETWEEN 990 AND 999 THEN greatest(scanned - 5, 0) + 1 END AS orphan_from_block FROM tops JOIN heads USING (chain_id))
, placed AS (SELECT c.*, r.* EXCLUDE (chain_id, contract_address), coalesce(block_number < 1000 AND block_number >= orphan_from_block, FALSE) AS hit
  FROM current_rows c JOIN rewound r USING (chain_id, contract_address))
, bad AS (SELECT chain_id, contract_address, min(block_number) AS first_bad FROM placed WHERE block_number BETWEEN 990 AND 999 AND NOT hit AND block_number <= head - 5 GROUP BY ALL)
, marked AS (SELECT *, hit OR coalesce(block_number >= first_bad, FALSE) AS is_orphaned FROM placed LEFT JOIN bad USING (chain_id, contract_address))
SELECT chain_id, tx_hash, log_index, contract_address, block_number, CASE WHEN NOT is_orphaned AND block_number <= head - 5 THEN 'confirmed' ELSE 'observed' END AS confirmation_state,
       is_orphaned, reorg, orphan_from_block, top AS last_scanned_block, least(top, head - 5, first_bad - 1) AS last_confirmed_block FROM marked
"""),
    "stream_progress": with_ctes("observations", """
, parts AS (SELECT chain_id, tx_hash, log_index, greatest(least(block_number // 500, 2), 0) AS part, CAST(floor(block_number / 1000) AS BIGINT) AS rng FROM observations)
, touched AS (SELECT DISTINCT part, chain_id, tx_hash, log_index FROM parts)
, written AS (SELECT DISTINCT t.part, chain_id, tx_hash, log_index, p.rng FROM touched t JOIN parts p USING (chain_id, tx_hash, log_index) WHERE p.part <= t.part)
, per_part AS (SELECT part, count(*) AS rows_written, count(DISTINCT (chain_id, rng)) AS ranges_written FROM written GROUP BY part)
, due AS (SELECT chain_id, max(block_number) - 5 AS due FROM observations GROUP BY ALL)
, known AS (SELECT DISTINCT t.part, p.chain_id, p.rng FROM (SELECT DISTINCT part FROM touched) t JOIN parts p ON p.part <= t.part)
, checked AS (SELECT k.part, count(*) AS ranges_checked FROM known k JOIN due USING (chain_id)
  WHERE EXISTS (FROM written w WHERE w.part = k.part AND w.chain_id = k.chain_id AND w.rng = k.rng) OR (k.rng * 1000 <= due AND k.rng * 1000 + 999 > due) GROUP BY k.part)
SELECT CAST(part AS INTEGER) AS batch_id, (SELECT count(*) FROM touched t WHERE t.part = p.part) AS identities, rows_written, ranges_written, ranges_checked, 0 AS reorgs
FROM per_part p JOIN checked c USING (part)
"""),
}
