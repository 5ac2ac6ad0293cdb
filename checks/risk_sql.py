"""Oracles for models, scenarios, risk, stress, quotes and validation."""

from __future__ import annotations

from checks.ctes import cte, with_ctes
from checks.market_sql import C95, C99, r8

N = 50_000
SEED = 42
STOPS = (1, 2, 7, 14, 28, 30, 60)

cte("tail_rows", """
SELECT r.asset, r.day, row_number() OVER (PARTITION BY r.asset ORDER BY r.idx) - 1 AS idx, r.r, omega, alpha, beta, mu, (r.r - mu) * (r.r - mu) AS eps2
FROM returns r JOIN garch_params USING (asset) JOIN (SELECT asset, max(idx) AS last FROM returns GROUP BY asset) USING (asset)
WHERE r.idx > last - 750
""", "returns", "garch_params")
cte("tail_seeded", "SELECT *, var_samp(r - mu) OVER (PARTITION BY asset) AS seed FROM tail_rows", "tail_rows")
cte("tail_path", """
SELECT *, omega + (alpha + beta) * seed AS sigma2 FROM tail_seeded WHERE idx = 0
UNION ALL SELECT n.*, n.omega + n.alpha * p.eps2 + n.beta * p.sigma2
FROM tail_path p JOIN tail_seeded n ON n.asset = p.asset AND n.idx = p.idx + 1
""", "tail_seeded")
cte("state", """
SELECT asset, omega, alpha, beta, mu, n_obs_fit, training_window_start, day AS latest_day, sigma2 AS latest_variance, eps2 AS latest_eps2
FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n_obs_fit, min(day) OVER (PARTITION BY asset) AS training_window_start FROM tail_path)
QUALIFY row_number() OVER (PARTITION BY asset ORDER BY idx DESC) = 1
""", "tail_path")
cte("early_rows", """
SELECT asset, day, idx, r, omega, alpha, beta, mu, (r - mu) * (r - mu) AS eps2, var_samp(CASE WHEN idx < 750 THEN r - mu END) OVER (PARTITION BY asset) AS seed
FROM returns JOIN garch_params USING (asset)
""", "returns", "garch_params")
cte("early_path", """
SELECT *, omega + (alpha + beta) * seed AS sigma2 FROM early_rows WHERE idx = 0
UNION ALL SELECT n.*, n.omega + n.alpha * p.eps2 + n.beta * p.sigma2
FROM early_path p JOIN early_rows n ON n.asset = p.asset AND n.idx = p.idx + 1
""", "early_rows")
cte("summary", """
SELECT *, alpha + beta AS persistence, CASE WHEN alpha + beta < 1 THEN omega / (1 - (alpha + beta)) END AS unconditional_variance FROM state
""", "state")
cte("forecast", """
SELECT asset, 1 AS step, omega + alpha * latest_eps2 + beta * latest_variance AS variance, omega, alpha, beta FROM state
UNION ALL SELECT asset, step + 1, omega + (alpha + beta) * variance, omega, alpha, beta FROM forecast WHERE step < 60
""", "state")
_GRID = [(i, a, f"{p!r}::DOUBLE - {a!r}::DOUBLE") for i, (a, p) in enumerate((a, p) for p in (0.6, 0.9, 0.97) for a in (0.03, 0.08, 0.15))]
cte("grid", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b})" for i, a, b in _GRID) + ") g(grid_id, alpha, beta)")
cte("grid_rows", """
SELECT asset, grid_id, idx, s.v * (1 - alpha - beta) AS omega, alpha, beta, s.mu, s.v, (r - s.mu) * (r - s.mu) AS eps2
FROM returns JOIN (SELECT asset, avg(r) AS mu, var_samp(r) AS v FROM returns GROUP BY asset) s USING (asset) CROSS JOIN grid
""", "returns", "grid")
cte("grid_path", """
SELECT *, omega + (alpha + beta) * v AS sigma2 FROM grid_rows WHERE idx = 0
UNION ALL SELECT n.*, n.omega + n.alpha * p.eps2 + n.beta * p.sigma2
FROM grid_path p JOIN grid_rows n ON n.asset = p.asset AND n.grid_id = p.grid_id AND n.idx = p.idx + 1
""", "grid_rows")
cte("means", "SELECT asset, avg(r) AS mean_return FROM returns GROUP BY asset", "returns")
cte("pool", "SELECT asset, list(z ORDER BY idx) AS pool FROM residuals GROUP BY asset", "residuals")


def _uniform(text: str, start: int) -> str:
    return f"((('0x' || substr({text}, {start}, 13))::UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def _mixed(source: str, name: str) -> str:
    """The 32-bit avalanche as a chain of columns ending in ``name``."""
    return f"""xor({source}, {source} >> 16) AS {name}1, ({name}1 * 2246822507::UBIGINT) & 4294967295::UBIGINT AS {name}2,
       xor({name}2, {name}2 >> 13) AS {name}3, ({name}3 * 3266489909::UBIGINT) & 4294967295::UBIGINT AS {name}4, xor({name}4, {name}4 >> 16) AS {name}"""


cte("fhs_draws", f"""
SELECT asset, s AS scenario_id, t AS step, xor(key, s::UBIGINT) AS x, {_mixed('x', 'a')},
       xor(a, (((t + 1)::UBIGINT * 2654435769::UBIGINT) & 4294967295::UBIGINT)) AS y, {_mixed('y', 'b')},
       list_extract(pool, 1 + CAST(floor((b::DOUBLE + 0.5e0) / 4294967296.0::DOUBLE * len(pool)) AS BIGINT)) AS z
FROM (SELECT *, ('0x' || substr(md5('{SEED}#fhs#' || asset), 1, 8))::UBIGINT AS key FROM pool)
CROSS JOIN range(0, {N}) r1(s) CROSS JOIN range(0, {STOPS[-1]}) r2(t)
""", "pool")
cte("fhs_paths", """
SELECT asset, scenario_id, -1::BIGINT AS step, omega, alpha, beta, mu, latest_variance AS s2, sqrt(latest_eps2) AS eps, 0e0 AS total
FROM state CROSS JOIN (SELECT DISTINCT scenario_id FROM fhs_draws)
UNION ALL
SELECT asset, scenario_id, step + 1, omega, alpha, beta, mu, v, z * sqrt(v), total + mu + z * sqrt(v)
FROM (SELECT p.*, d.z, omega + alpha * eps * eps + beta * s2 AS v FROM fhs_paths p
      JOIN fhs_draws d ON d.asset = p.asset AND d.scenario_id = p.scenario_id AND d.step = p.step + 1)
""", "state", "fhs_draws")
cte("fhs_losses", f"""
SELECT asset, CAST(step + 1 AS INTEGER) AS horizon_days, exp(total) - 1 AS x FROM fhs_paths WHERE step + 1 IN {STOPS}
""", "fhs_paths")


def _normals(stream: str) -> str:
    digest = f"md5('{SEED}#{stream}#' || asset || '#' || s)"
    return f"""SELECT asset, latest_variance, s, sqrt(-2 * ln({_uniform(digest, 1)})) * cos(2 * pi() * {_uniform(digest, 14)}) AS z
FROM state CROSS JOIN range(0, {N}) a(s)"""


cte("gbm_losses", f"""
SELECT asset, horizon_days, exp((mean_return * 365 - latest_variance * 365 / 2) * horizon_days / 365
       + sqrt(latest_variance * 365) * sqrt(horizon_days / 365) * z) - 1 AS x
FROM ({_normals('gbm')}) JOIN means USING (asset) CROSS JOIN horizons
""", "state", "means", "horizons")
cte("all_losses", """
SELECT asset, horizon_days, 'historical_simulation' AS method, x FROM horizon_losses
UNION ALL SELECT asset, horizon_days, 'filtered_historical_simulation', x FROM fhs_losses
UNION ALL SELECT asset, horizon_days, 'gbm_monte_carlo', x FROM gbm_losses
""", "horizon_losses", "fhs_losses", "gbm_losses")
cte("all_quantiles", f"""
SELECT asset, horizon_days, method, 0.95e0 AS confidence, quantile_cont(x, {C95}) AS q FROM all_losses GROUP BY ALL
UNION ALL SELECT asset, horizon_days, method, 0.99e0, quantile_cont(x, {C99}) FROM all_losses GROUP BY ALL
""", "all_losses")
cte("tails", f"""
SELECT asset, horizon_days, method, q.confidence, count(*) AS n_scenarios, greatest(-any_value(q), 0) AS value_at_risk,
       greatest(-coalesce(avg(x) FILTER (WHERE x <= q), any_value(q)), 0) AS expected_shortfall,
       {', '.join(f'quantile_cont(x, {p / 100!r}::DOUBLE) AS p{p}' for p in (1, 5, 25, 50, 75, 95, 99))}
FROM all_quantiles q JOIN all_losses l USING (asset, horizon_days, method) GROUP BY asset, horizon_days, method, q.confidence
""", "all_quantiles")
cte("shock_losses", f"""
SELECT asset, horizon_days, m AS multiplier, exp(-(latest_variance * 365 * m * m) / 2 * horizon_days / 365
       + sqrt(latest_variance * 365) * m * sqrt(horizon_days / 365) * z) - 1 AS x
FROM ({_normals('stress')}) CROSS JOIN horizons CROSS JOIN (VALUES (2), (3)) v(m)
""", "state", "horizons")
cte("shock_tails", f"""
SELECT asset, horizon_days, multiplier AS ord, 'vol_shock_' || multiplier || 'x' AS name,
       greatest(-coalesce(avg(x) FILTER (WHERE x <= q), any_value(q)), 0) AS loss_fraction
FROM shock_losses JOIN (SELECT asset, horizon_days, multiplier, quantile_cont(x, {C99}) AS q FROM shock_losses GROUP BY ALL)
USING (asset, horizon_days, multiplier) GROUP BY asset, horizon_days, multiplier
""", "shock_losses")
cte("extended", """
SELECT asset, h.horizon_days, 5 AS ord, 'extended_horizon_' || t.horizon_days || 'd' AS name, expected_shortfall AS loss_fraction
FROM tails t JOIN horizons h ON t.horizon_days = greatest(h.horizon_days + 1, h.horizon_days * 2)
WHERE method = 'filtered_historical_simulation' AND confidence = 0.99e0
""", "tails", "horizons")
cte("gaps", """
SELECT asset, horizon_days, ord, name, loss_fraction FROM (SELECT asset FROM state) CROSS JOIN horizons
CROSS JOIN (VALUES (3, 'gap_down_shock_30%', 0.3e0), (4, 'gap_down_shock_50%', 0.5e0)) g(ord, name, loss_fraction)
""", "state", "horizons")
cte("stress", """
SELECT asset, horizon_days, 0 AS ord, 'historical_worst_case_' || horizon_days || 'd' AS name, loss_fraction FROM worst_moves
UNION ALL SELECT asset, horizon_days, ord - 1, name, loss_fraction FROM shock_tails
UNION ALL SELECT * FROM gaps UNION ALL SELECT * FROM extended
""", "worst_moves", "shock_tails", "gaps", "extended")
cte("worst", """
SELECT asset, horizon_days, name AS worst_stress_scenario, loss_fraction AS stress_loss FROM stress
QUALIFY row_number() OVER (PARTITION BY asset, horizon_days ORDER BY loss_fraction DESC, ord) = 1
""", "stress")


def up12(x: str) -> str:
    """A loss as DECIMAL(14,12), rounded up after 15 places."""
    return f"CAST(CAST((CAST(round({x} * 1e15) AS HUGEINT) + 999) // 1000 AS DECIMAL(20,0)) * 0.000000000001::DECIMAL(13,12) AS DECIMAL(14,12))"


def up18(x: str) -> str:
    """DECIMAL with 20 places rounded up to 18."""
    text = f"CAST(CAST({x} + 0.00000000000000000099::DECIMAL(20,20) AS DECIMAL(37,20)) AS VARCHAR)"
    return f"CAST(left({text}, length({text}) - 2) AS DECIMAL(38,18))"


cte("snapshot", f"""
SELECT *, CAST(1 AS DECIMAL(1,0)) + loss_basis AS raw_ratio FROM (
  SELECT *, greatest(es_loss, stress_loss) AS loss_basis,
         CASE WHEN es_loss >= stress_loss THEN 'expected_shortfall' ELSE 'stress' END AS loss_basis_source FROM (
    SELECT asset, horizon_days, value_at_risk, expected_shortfall, worst_stress_scenario, {up12('stress_loss')} AS stress_loss,
           {up12('expected_shortfall')} AS es_loss, sqrt(latest_variance * 365) AS forecast_volatility_annualized, 0.99e0 AS confidence
    FROM tails JOIN worst USING (asset, horizon_days) JOIN state USING (asset)
    WHERE method = 'filtered_historical_simulation' AND tails.confidence = 0.99e0))
""", "tails", "worst", "state")
cte("spots", """
SELECT asset, CAST(close AS DECIMAL(16,6)) AS spot_price_usd FROM prices QUALIFY row_number() OVER (PARTITION BY asset ORDER BY day DESC) = 1
""", "prices")
cte("requests", """
SELECT deal_id AS request_id, CASE deal_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS asset, notional, horizon_days, created_at
FROM deals
""", "deals")
cte("quotes", f"""
SELECT '0x' || sha256(asset || '|' || horizon_days || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '|' || request_id) AS quote_id,
       request_id, asset, notional, horizon_days, horizon_days * 86400 AS settlement_horizon_seconds, spot_price_usd, confidence,
       forecast_volatility_annualized, value_at_risk, expected_shortfall, es_loss, stress_loss, loss_basis_source,
       CAST(raw_ratio AS DECIMAL(15,12)) AS collateral_ratio,
       {up18('CAST(notional * CAST(raw_ratio AS DECIMAL(15,12)) AS DECIMAL(36,20))')} AS required_collateral,
       created_at AS quote_created_at, created_at + INTERVAL 5 MINUTE AS quote_expiration
FROM requests JOIN snapshot USING (asset, horizon_days) JOIN spots USING (asset)
""", "requests", "snapshot", "spots")
# Walk-forward: segment k is fitted on the 750 rows before oos_start + 21 k and scores the next 21.
cte("walk_rows", """
SELECT r.asset, k AS segment, r.idx AS full_idx, r.idx - (oos_start + 21 * k - 750) AS idx, r.day, r.r, omega, alpha, beta, mu,
       (r.r - mu) * (r.r - mu) AS eps2, r.idx < oos_start + 21 * k AS train
FROM returns r JOIN oos USING (asset) JOIN garch_params USING (asset) CROSS JOIN range(0, 200) s(k)
WHERE oos_start + 21 * k < n AND r.idx >= oos_start + 21 * k - 750 AND r.idx < oos_start + 21 * k + 21
""", "oos", "garch_params")
cte("walk_seeded", "SELECT *, var_samp(CASE WHEN train THEN r - mu END) OVER (PARTITION BY asset, segment) AS seed FROM walk_rows", "walk_rows")
cte("walk_path", """
SELECT *, omega + (alpha + beta) * seed AS sigma2 FROM walk_seeded WHERE idx = 0
UNION ALL SELECT n.*, n.omega + n.alpha * p.eps2 + n.beta * p.sigma2
FROM walk_path p JOIN walk_seeded n ON n.asset = p.asset AND n.segment = p.segment AND n.idx = p.idx + 1
""", "walk_seeded")
cte("walk", "SELECT asset, full_idx AS idx, day, r, sigma2 AS garch FROM walk_path WHERE NOT train", "walk_path")
cte("vol_frame", """
SELECT w.asset, w.idx, w.day, w.r * w.r AS proxy, rolling AS rolling_hist_vol, ewma_forecast AS ewma, garch FROM walk w
JOIN (SELECT asset, idx, var_samp(r) OVER (PARTITION BY asset ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS rolling FROM returns) USING (asset, idx)
JOIN ewma_oos_forecast USING (asset, idx)
""", "walk", "ewma_oos_forecast")
cte("vol_metrics", "\nUNION ALL\n".join(
    f"SELECT asset, '{m}' AS model, count(*) AS n_oos, sqrt(avg(pow(proxy - {m}, 2))) AS rmse, avg(ln({m}) + proxy / {m}) AS qlike FROM vol_frame GROUP BY asset"
    for m in ("rolling_hist_vol", "ewma", "garch")
), "vol_frame")
cte("pre_rows", """
SELECT r.asset, r.idx, r.r, omega, alpha, beta, mu, (r.r - mu) * (r.r - mu) AS eps2, var_samp(r.r - mu) OVER (PARTITION BY r.asset) AS seed
FROM returns r JOIN oos USING (asset) JOIN garch_params USING (asset) WHERE r.idx < oos_start
""", "oos", "garch_params")
cte("pre_path", """
SELECT *, omega + (alpha + beta) * seed AS sigma2 FROM pre_rows WHERE idx = 0
UNION ALL SELECT n.*, n.omega + n.alpha * p.eps2 + n.beta * p.sigma2
FROM pre_path p JOIN pre_rows n ON n.asset = p.asset AND n.idx = p.idx + 1
""", "pre_rows")
cte("pre_z", "SELECT asset, mu, (r - mu) / sqrt(sigma2) AS z FROM pre_path", "pre_path")
cte("multiplier", "\nUNION ALL\n".join(
    f"""SELECT asset, mu, {c} AS confidence, any_value(q) AS z_q, coalesce(avg(z) FILTER (WHERE z <= q), any_value(q)) AS es_z
FROM pre_z JOIN (SELECT asset, quantile_cont(z, {p}) AS q FROM pre_z GROUP BY asset) USING (asset) GROUP BY asset, mu"""
    for c, p in (("0.95e0", C95), ("0.99e0", C99))
), "pre_z")
cte("var_series", """
SELECT asset, confidence, idx, day, r, garch AS sigma2, sqrt(garch) AS sigma, -(mu + z_q * sqrt(garch)) AS var_loss,
       -(mu + es_z * sqrt(garch)) AS es_loss, mu + z_q * sqrt(garch) AS var_threshold, r < mu + z_q * sqrt(garch) AS exceed
FROM walk JOIN multiplier USING (asset)
""", "walk", "multiplier")
cte("es_tests", """
SELECT *, realized_es / predicted_es AS es_ratio FROM (
  SELECT asset, confidence, count(*) AS n_obs, CAST(sum(exceed::INT) AS BIGINT) AS n_exceedances, -avg(r) FILTER (WHERE exceed) AS realized_es,
         coalesce(avg(es_loss) FILTER (WHERE exceed), avg(es_loss)) AS predicted_es, min(day) AS oos_first, max(day) AS oos_last
  FROM var_series GROUP BY asset, confidence)
""", "var_series")
cte("kupiec_lr", """
SELECT asset, confidence, n_obs, n_exceedances, x / n AS exceedance_rate, 1 - confidence AS expected_rate,
       greatest(-2 * (CASE WHEN x = n THEN 0 ELSE (n - x) * ln(confidence) END + CASE WHEN x = 0 THEN 0 ELSE x * ln(1 - confidence) END
         - CASE WHEN x = n THEN 0 ELSE (n - x) * ln(1 - x / n) END - CASE WHEN x = 0 THEN 0 ELSE x * ln(x / n) END), 0) AS lr_statistic
FROM (SELECT *, n_obs::DOUBLE AS n, n_exceedances::DOUBLE AS x FROM es_tests)
""", "es_tests")
# Upper tail of chi-square(1): 1 - erf(sqrt(LR / 2)) by the ascending series of erf.
cte("erf_terms", """
SELECT asset, confidence, 0 AS k, sqrt(lr_statistic / 2) AS x, sqrt(lr_statistic / 2) AS term FROM kupiec_lr
UNION ALL SELECT asset, confidence, k + 1, x, term * 2 * x * x / (2 * k + 3) FROM erf_terms WHERE k < 300
""", "kupiec_lr")
cte("kupiec", """
SELECT k.*, greatest(1 - 2 / sqrt(pi()) * exp(-lr_statistic / 2) * s, 0) AS p_value, lr_statistic > 3.841458820694124e0 AS reject_at_5pct
FROM kupiec_lr k JOIN (SELECT asset, confidence, sum(term) AS s FROM erf_terms GROUP BY ALL) USING (asset, confidence)
""", "erf_terms")
_TERMS = "asset, horizon_days, confidence"
cte("states", """
SELECT asset, 'garch_1_1' AS model_name, day AS latest_observation_day, sigma2 AS latest_conditional_variance, eps2 AS latest_squared_residual,
       alpha, (idx - 750) % 21 = 0 AS is_fit FROM garch_path WHERE idx >= 750
""", "garch_path")
_STATE_COLUMNS = "asset, model_name, latest_observation_day, round(latest_conditional_variance, 8) AS latest_conditional_variance, round(latest_squared_residual, 8) AS latest_squared_residual, alpha, is_fit"

ORACLES: dict[str, str] = {
    "model_state_latest": with_ctes("states", f"SELECT {_STATE_COLUMNS} FROM states QUALIFY row_number() OVER (PARTITION BY asset ORDER BY latest_observation_day DESC) = 1"),
    "model_state_history": with_ctes("states", f"SELECT {_STATE_COLUMNS} FROM states WHERE is_fit"),
    "garch_grid_fit": with_ctes("grid_path", """
, scored AS (SELECT asset, grid_id, omega, alpha, beta, mu, sum(-0.5e0 * (ln(2 * pi()) + ln(sigma2) + eps2 / sigma2)) AS log_likelihood FROM grid_path GROUP BY ALL)
SELECT asset, grid_id, round(omega, 8) AS omega, round(alpha, 8) AS alpha, round(beta, 8) AS beta, round(mu, 8) AS mu, round(log_likelihood, 8) AS log_likelihood
FROM scored QUALIFY row_number() OVER (PARTITION BY asset ORDER BY log_likelihood DESC) = 1
"""),
    "garch_param_checks": with_ctes("returns", """
, c AS (SELECT asset, grid_id, v * round(1 - alpha - beta, 6) AS omega, alpha, beta, mu FROM (SELECT asset, var_samp(r) AS v, avg(r) AS mu FROM returns GROUP BY asset)
  CROSS JOIN (VALUES (0, 1e-1, 8e-1), (1, 2e-1, 9e-1), (2, -1e-1, 9e-1), (3, 3e-1, -1e-1), (4, 5e-1, 5e-1)) g(grid_id, alpha, beta))
SELECT asset, grid_id, round(omega, 8) AS omega, alpha, beta, round(mu, 8) AS mu,
       CASE WHEN omega <= 0 THEN 'omega must be > 0' WHEN alpha < 0 THEN 'alpha must be >= 0' WHEN beta < 0 THEN 'beta must be >= 0' END AS violation FROM c
"""),
    "garch_summary": with_ctes("summary", """
SELECT asset, round(omega, 8) AS omega, alpha, beta, mu, round(persistence, 8) AS persistence, round(unconditional_variance, 8) AS unconditional_variance,
       round(CASE WHEN persistence > 0 AND persistence < 1 THEN ln(0.5) / ln(persistence) END, 8) AS half_life_days,
       round(sqrt(unconditional_variance * 365), 8) AS long_run_vol, round(sqrt(latest_variance * 365), 8) AS current_vol FROM summary
"""),
    "garch_state": with_ctes("state", f"SELECT asset, n_obs_fit, training_window_start, latest_day, {r8('latest_variance', 'latest_eps2')} FROM state"),
    "garch_forecast": with_ctes("forecast", f"SELECT asset, step, {r8('variance')} FROM forecast WHERE step <= 30"),
    "vol_term_structure": with_ctes("forecast", """
SELECT asset, step, round(sqrt(variance * 365), 8) AS vol,
       round(CASE WHEN alpha + beta < 1 THEN sqrt(omega / (1 - (alpha + beta)) * 365) END, 8) AS long_run_vol FROM forecast
"""),
    "garch_update_replay": with_ctes("early_path", f"SELECT asset, day, {r8('sigma2', 'eps2')} FROM early_path WHERE idx >= 750"),
    "refit_due": with_ctes("returns", """
, e AS (SELECT asset, day AS fit_end FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY idx DESC) - 1 AS back FROM returns)
  WHERE back = CASE asset WHEN 'A' THEN 10 WHEN 'N' THEN 21 ELSE 30 END)
SELECT asset, fit_end, count(*) FILTER (WHERE day > fit_end) AS n_updates, count(*) FILTER (WHERE day > fit_end) >= 21 AS refit_due
FROM returns JOIN e USING (asset) GROUP BY asset, fit_end
"""),
    "result_fingerprint": with_ctes("returns", "SELECT asset, max(day) || '|' || count(*) || '|' || max(day) AS fingerprint FROM returns GROUP BY asset"),
    "current_vol_table": with_ctes("state ewma_path", """
SELECT asset, 'garch' AS model, round(sqrt(latest_variance * 365), 8) AS vol FROM state
UNION ALL SELECT asset, 'ewma', round(sqrt(v) * sqrt(365), 8) FROM (SELECT * FROM ewma_path QUALIFY row_number() OVER (PARTITION BY asset ORDER BY idx DESC) = 1)
UNION ALL SELECT asset, 'rolling', round(sd * sqrt(365), 8) FROM (
  SELECT asset, stddev_samp(r) AS sd FROM (SELECT * FROM returns QUALIFY row_number() OVER (PARTITION BY asset ORDER BY idx DESC) <= 30) GROUP BY asset)
"""),
    "tail_risk_fhs": with_ctes("tails", f"""
SELECT {_TERMS}, n_scenarios, {r8('value_at_risk', 'expected_shortfall')} FROM tails
WHERE method = 'filtered_historical_simulation' AND horizon_days IN (1, 7, 14, 30)
"""),
    "tail_risk_gbm": with_ctes("tails", f"SELECT {_TERMS}, n_scenarios, {r8('value_at_risk', 'expected_shortfall')} FROM tails WHERE method = 'gbm_monte_carlo'"),
    "risk_results": with_ctes("tails state", f"""
SELECT {_TERMS}, method, n_scenarios, {r8('value_at_risk', 'expected_shortfall', 'p1', 'p5', 'p25', 'p50', 'p75', 'p95', 'p99')},
       round(sqrt(latest_variance * 365), 8) AS forecast_volatility_annualized FROM tails JOIN state USING (asset) WHERE horizon_days IN (1, 7, 14, 30)
"""),
    "tail_comparison": with_ctes("tails state", f"""
SELECT {_TERMS}, method, {r8('value_at_risk', 'expected_shortfall')}, round(sqrt(latest_variance * 365), 8) AS forecast_volatility_annualized
FROM tails JOIN state USING (asset) WHERE horizon_days IN (1, 7, 14, 30)
"""),
    "tail_comparison_pivot": with_ctes("tails", "SELECT asset, horizon_days, " + ", ".join(
        f"round(any_value(expected_shortfall) FILTER (WHERE method = '{m}'), 8) AS {m}"
        for m in ("historical_simulation", "filtered_historical_simulation", "gbm_monte_carlo")
    ) + " FROM tails WHERE confidence = 0.99e0 AND horizon_days IN (1, 7, 14, 30) GROUP BY asset, horizon_days"),
    "stress_vol_shock": with_ctes("shock_tails", f"SELECT asset, horizon_days, name, {r8('loss_fraction')} FROM shock_tails"),
    "stress_gap_down": with_ctes("gaps", "SELECT asset, horizon_days, name, loss_fraction FROM gaps"),
    "stress_extended_horizon": with_ctes("extended", f"SELECT asset, horizon_days, name, {r8('loss_fraction')} FROM extended"),
    "stress_summary": with_ctes("stress", f"SELECT asset, horizon_days, ord, name, {r8('loss_fraction')} FROM stress"),
    "worst_stress": with_ctes("worst", f"SELECT asset, horizon_days, worst_stress_scenario, {r8('stress_loss')} FROM worst"),
    "risk_snapshot": with_ctes("snapshot", f"""
SELECT asset, horizon_days, {r8('value_at_risk', 'expected_shortfall', 'forecast_volatility_annualized')}, worst_stress_scenario, stress_loss, es_loss,
       loss_basis, loss_basis_source, CAST(raw_ratio AS DECIMAL(15,12)) AS collateral_ratio, confidence,
       CAST(CAST(raw_ratio AS DECIMAL(15,12)) AS DECIMAL(38,18)) AS required_collateral_per_unit FROM snapshot
"""),
    "collateral_policy": with_ctes("deals", f"""
, w AS (SELECT deal_id, notional, CAST(deal_id % 97 AS DECIMAL(4,0)) * 0.01::DECIMAL(14,12) AS es_loss, CAST(deal_id % 131 AS DECIMAL(4,0)) * 0.01::DECIMAL(14,12) AS stress_loss
  FROM deals)
, b AS (SELECT *, CAST(es_loss * 1.10 AS DECIMAL(14,12)) AS we, CAST(stress_loss * 0.90 AS DECIMAL(14,12)) AS ws FROM w)
, c AS (SELECT *, greatest(we, ws) AS loss_basis, CAST(1 + greatest(we, ws) AS DECIMAL(15,12)) AS raw FROM b)
, d AS (SELECT *, CAST(least(greatest(raw, 1.05), 2.00) AS DECIMAL(15,12)) AS collateral_ratio FROM c)
, e AS (SELECT *, {up18('CAST(notional * collateral_ratio AS DECIMAL(36,20))')} AS required_collateral FROM d)
SELECT deal_id, notional, CAST(es_loss AS DECIMAL(14,12)) AS es_loss, CAST(stress_loss AS DECIMAL(14,12)) AS stress_loss, loss_basis, CASE WHEN we >= ws THEN 'expected_shortfall' ELSE 'stress' END AS loss_basis_source,
       raw < 1.05 AS floored, raw > 2.00 AS capped, collateral_ratio, required_collateral, CAST(required_collateral - notional AS DECIMAL(38,18)) AS collateral_buffer FROM e
"""),
    "exposure_usd": with_ctes("deals spots", """
SELECT deal_id, asset, notional, spot_price_usd, CAST(notional * spot_price_usd AS DECIMAL(38,14)) AS exposure_usd
FROM (SELECT deal_id, notional, CASE deal_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS asset FROM deals) JOIN spots USING (asset)
"""),
    "price_quotes": with_ctes("quotes", f"""
SELECT * REPLACE ({r8('value_at_risk', 'expected_shortfall', 'forecast_volatility_annualized')}), CAST(required_collateral - notional AS DECIMAL(38,18)) AS collateral_buffer FROM quotes
"""),
    "unpriced_requests": with_ctes("requests spots horizons", """
, asked AS (SELECT * REPLACE (CASE WHEN request_id % 19 = 0 THEN 'X' ELSE asset END AS asset,
                              CASE WHEN request_id % 23 = 0 THEN 21 ELSE horizon_days END AS horizon_days) FROM requests)
SELECT a.*, CASE WHEN s.asset IS NULL THEN 'no spot price' ELSE 'no terms for the horizon' END AS reason
FROM asked a LEFT JOIN spots s ON a.asset = s.asset LEFT JOIN horizons h ON a.horizon_days = h.horizon_days
WHERE s.asset IS NULL OR h.horizon_days IS NULL
"""),
    "quote_onchain_fields": with_ctes("quotes", """
SELECT quote_id, CAST(replace(CAST(CAST(notional AS DECIMAL(38,18)) AS VARCHAR), '.', '') AS DECIMAL(38,0)) AS notional_units,
       CAST(replace(CAST(required_collateral AS VARCHAR), '.', '') AS DECIMAL(38,0)) AS required_collateral_units,
       CAST(epoch(quote_expiration) AS BIGINT) AS quote_expiration, settlement_horizon_seconds AS settlement_horizon FROM quotes
"""),
    "snapshot_hash": with_ctes("deals", """
, t AS (SELECT deal_id, '{"asset":"' || CASE deal_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END
    || '","collateral_ratio":"' || (1000000000000000000 + (deal_id % 131) * 10000000000000000)
    || '","created_at":' || CAST(epoch(created_at) AS BIGINT) || ',"horizon_days":' || horizon_days
    || ',"loss":{"es":"' || ((deal_id % 131) * 10000000000000000) || '","var":"' || ((deal_id % 97) * 10000000000000000)
    || '"},"notional":"' || CAST(replace(CAST(CAST(notional AS DECIMAL(38,18)) AS VARCHAR), '.', '') AS DECIMAL(38,0)) || '"}' AS snapshot_json FROM deals)
SELECT deal_id, snapshot_json, '0x' || sha256(snapshot_json) AS snapshot_hash FROM t
"""),
    "garch_walk_forward": with_ctes("walk", f"SELECT asset, idx, day, {r8('garch')} FROM walk"),
    "volatility_metrics": with_ctes("vol_metrics", f"SELECT asset, model, n_oos, {r8('rmse', 'qlike')} FROM vol_metrics"),
    "volatility_series": with_ctes("vol_frame", "SELECT asset, day, round(sqrt(proxy * 365), 8) AS proxy_vol, " + ", ".join(
        f"round(sqrt(greatest({m}, 0) * 365), 8) AS {m}" for m in ("rolling_hist_vol", "ewma", "garch")) + " FROM vol_frame"),
    "metrics_ranked": with_ctes("vol_metrics", f"""
SELECT asset, model, n_oos, {r8('rmse', 'qlike')}, CAST(rank() OVER (PARTITION BY asset ORDER BY v.rmse) AS INTEGER) AS rank_rmse,
       CAST(rank() OVER (PARTITION BY asset ORDER BY v.qlike) AS INTEGER) AS rank_qlike FROM vol_metrics v
"""),
    "var_multiplier": with_ctes("multiplier", f"SELECT asset, mu, confidence, {r8('z_q', 'es_z')} FROM multiplier"),
    "var_backtest_series": with_ctes("var_series", f"""
SELECT asset, confidence, idx, day, {r8('r', 'sigma2', 'sigma', 'var_loss', 'es_loss', 'var_threshold')}, exceed FROM var_series
"""),
    "var_backtest": with_ctes("kupiec es_tests", f"""
SELECT asset, k.confidence, k.n_obs, k.n_exceedances, {r8('exceedance_rate', 'expected_rate', 'lr_statistic', 'p_value')}, reject_at_5pct,
       {r8('realized_es', 'predicted_es', 'es_ratio')}, oos_first, oos_last FROM kupiec k JOIN es_tests e USING (asset, confidence)
"""),
    "kupiec_pof": with_ctes("kupiec", f"""
SELECT asset, confidence, n_obs, n_exceedances, {r8('exceedance_rate', 'expected_rate', 'lr_statistic', 'p_value')}, reject_at_5pct FROM kupiec
"""),
    "es_backtest": with_ctes("es_tests", f"SELECT asset, confidence, n_obs, n_exceedances, {r8('realized_es', 'predicted_es', 'es_ratio')} FROM es_tests"),
}
