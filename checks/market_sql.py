"""Oracles for prices, returns, quality, series and statistics."""

from __future__ import annotations

from checks.ctes import cte, with_ctes

C95, C99 = "0.050000000000000044::DOUBLE", "0.010000000000000009::DOUBLE"

cte("ewma_seeded", """
SELECT r.asset, r.day, r.idx, r.r, s.seed
FROM returns r JOIN (SELECT asset, var_samp(r) AS seed FROM returns GROUP BY asset) s USING (asset)
""", "returns")
cte("ewma_path", """
SELECT asset, day, idx, 0.94e0 * seed + (1 - 0.94e0) * r * r AS v FROM ewma_seeded WHERE idx = 0
UNION ALL
SELECT n.asset, n.day, n.idx, 0.94e0 * p.v + (1 - 0.94e0) * n.r * n.r
FROM ewma_path p JOIN ewma_seeded n ON n.asset = p.asset AND n.idx = p.idx + 1
""", "ewma_seeded")
cte("oos", """
SELECT asset, n, greatest(CAST(floor(n * (1 - 0.3e0)) AS BIGINT), 750, 30) AS oos_start
FROM (SELECT asset, count(*) AS n FROM returns GROUP BY asset)
""", "returns")
cte("ewma_oos_seeded", """
SELECT r.asset, r.day, r.idx, r.r, o.oos_start, s.seed FROM returns r JOIN oos o USING (asset)
JOIN (SELECT asset, var_samp(r) AS seed FROM returns JOIN oos USING (asset) WHERE idx < oos_start GROUP BY asset) s USING (asset)
""", "oos")
cte("ewma_oos_path", """
SELECT asset, day, idx, oos_start, 0.94e0 * seed + (1 - 0.94e0) * r * r AS v FROM ewma_oos_seeded WHERE idx = 0
UNION ALL
SELECT n.asset, n.day, n.idx, n.oos_start, 0.94e0 * p.v + (1 - 0.94e0) * n.r * n.r
FROM ewma_oos_path p JOIN ewma_oos_seeded n ON n.asset = p.asset AND n.idx = p.idx + 1
""", "ewma_oos_seeded")
cte("ewma_oos_forecast", """
SELECT asset, day, idx, oos_start, lag(v) OVER (PARTITION BY asset ORDER BY idx) AS ewma_forecast FROM ewma_oos_path
""", "ewma_oos_path")
cte("garch_seeded", """
SELECT r.asset, r.day, r.idx, r.r, omega, alpha, beta, mu, (r.r - mu) * (r.r - mu) AS eps2, s.seed
FROM returns r JOIN garch_params p USING (asset)
JOIN (SELECT asset, var_samp(r - mu) AS seed FROM returns JOIN garch_params USING (asset) GROUP BY asset) s USING (asset)
""", "returns", "garch_params")
cte("garch_path", """
SELECT *, omega + alpha * seed + beta * seed AS sigma2 FROM garch_seeded WHERE idx = 0
UNION ALL
SELECT n.*, n.omega + n.alpha * p.eps2 + n.beta * p.sigma2
FROM garch_path p JOIN garch_seeded n ON n.asset = p.asset AND n.idx = p.idx + 1
""", "garch_seeded")
cte("residuals", "SELECT asset, day, idx, (r - mu) / sqrt(sigma2) AS z FROM garch_path", "garch_path")
cte("horizon_moves", "\nUNION ALL\n".join(
    f"""SELECT asset, {h} AS horizon_days, idx, start_day, day, log_return FROM (
  SELECT asset, idx, day, first(day) OVER f AS start_day, sum(r) OVER f AS log_return FROM returns
  WINDOW f AS (PARTITION BY asset ORDER BY idx ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)) WHERE idx >= {h - 1}"""
    for h in (1, 7, 14, 30)
), "returns")
cte("horizon_losses", "SELECT asset, horizon_days, exp(log_return) - 1 AS x FROM horizon_moves", "horizon_moves")
cte("worst_moves", """
SELECT asset, horizon_days, start_day AS window_start, day AS window_end, log_return AS cumulative_log_return,
       greatest(-(exp(log_return) - 1), 0) AS loss_fraction
FROM horizon_moves QUALIFY row_number() OVER (PARTITION BY asset, horizon_days ORDER BY log_return, idx) = 1
""", "horizon_moves")
cte("loss_quantiles", f"""
SELECT asset, horizon_days, 0.95e0 AS confidence, quantile_cont(x, {C95}) AS q FROM horizon_losses GROUP BY ALL
UNION ALL
SELECT asset, horizon_days, 0.99e0, quantile_cont(x, {C99}) FROM horizon_losses GROUP BY ALL
""", "horizon_losses")
cte("loss_tails", """
SELECT q.asset, q.horizon_days, q.confidence, count(*) AS n_scenarios, greatest(-any_value(q), 0) AS value_at_risk,
       greatest(-coalesce(avg(x) FILTER (WHERE x <= q), any_value(q)), 0) AS expected_shortfall
FROM loss_quantiles q JOIN horizon_losses l USING (asset, horizon_days) GROUP BY ALL
""", "loss_quantiles")
cte("quality", """
SELECT *, least(open, high, low, close) AS low_px, lag(day) OVER (PARTITION BY asset ORDER BY ingest_seq) AS day_before FROM prices_dirty
""", "prices_dirty")
cte("quality_agg", """
SELECT asset, count(*) AS n_rows, count(*) - count(DISTINCT day) AS n_duplicates,
       count(*) FILTER (WHERE day < day_before) AS n_inversions,
       count(*) FILTER (WHERE open IS NULL) AS n_null_open, count(*) FILTER (WHERE high IS NULL) AS n_null_high,
       count(*) FILTER (WHERE low IS NULL) AS n_null_low, count(*) FILTER (WHERE close IS NULL) AS n_null_close,
       count(*) FILTER (WHERE volume IS NULL) AS n_null_volume,
       bool_or(low_px <= 0) AS non_positive, bool_or(volume < 0) AS negative_volume,
       count(*) FILTER (WHERE high < low) AS crossed,
       date_diff('day', min(day), max(day)) + 1 - count(DISTINCT day) AS missing, min(day) AS first_day, max(day) AS last_day
FROM quality GROUP BY asset
""", "quality")
cte("quality_counts", """
SELECT a.asset, coalesce(n_rows, 0) AS n_rows, n_duplicates, n_inversions, n_null_open, n_null_high, n_null_low, n_null_close,
       n_null_volume, non_positive, negative_volume,
       CASE WHEN early = 0 THEN crossed END AS n_high_below_low,
       CASE WHEN n_inversions = 0 AND n_rows > 1 THEN missing END AS n_missing_dates,
       CASE WHEN n_rows IS NULL THEN 1 ELSE early + CASE WHEN early = 0 AND crossed > 0 THEN 1 ELSE 0 END END AS n_errors,
       first_day, last_day
FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(asset) LEFT JOIN (
  SELECT *, CAST(n_duplicates > 0 AS BIGINT) + CAST(n_inversions > 0 AS BIGINT)
         + CAST(n_null_open + n_null_high + n_null_low + n_null_close + n_null_volume > 0 AS BIGINT)
         + CAST(non_positive AS BIGINT) + CAST(negative_volume AS BIGINT) AS early FROM quality_agg) q USING (asset)
""", "quality_agg")
cte("quality_moves", """
SELECT asset, count(*) AS n_extreme, array_to_string(list_slice(list(CAST(day AS VARCHAR) ORDER BY day), 1, 5), ',') AS first_days
FROM (SELECT asset, day, abs(ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY day))) AS move
      FROM prices_dirty SEMI JOIN (SELECT asset FROM quality_counts WHERE n_errors = 0) USING (asset))
WHERE move > 0.25 GROUP BY asset
""", "quality_counts")


def _summed_lags(source: str, column: str, lags: int) -> str:
    return f"""
SELECT a.asset, n, lag, sum(a.c * b.c) / any_value(s0) AS acf
FROM (SELECT asset, idx, {column} - avg({column}) OVER (PARTITION BY asset) AS c FROM {source}) a
CROSS JOIN (SELECT unnest(range(1, {lags + 1}))::INTEGER AS lag) k
JOIN (SELECT asset, idx, {column} - avg({column}) OVER (PARTITION BY asset) AS c FROM {source}) b
  ON b.asset = a.asset AND b.idx = a.idx + k.lag
JOIN (SELECT asset, count(*) AS n, var_pop({column}) * count(*) AS s0 FROM {source} GROUP BY asset) t ON t.asset = a.asset
GROUP BY a.asset, n, lag"""


cte("acf_r", _summed_lags("returns", "r", 40), "returns")
cte("returns_sq", "SELECT *, r * r AS r2 FROM returns", "returns")
cte("acf_r2", _summed_lags("returns_sq", "r2", 40), "returns_sq")
cte("residuals_sq", "SELECT *, z * z AS z2 FROM residuals", "residuals")
cte("acf_z2", _summed_lags("residuals_sq", "z2", 20), "residuals_sq")


def _normal_quantile(p: str) -> str:
    from tidemark.functions.tails import NORMAL_QUANTILE_COEFFICIENTS as K

    def poly(name: str, x: str) -> str:
        text = f"({K[name][0]!r}::DOUBLE)"
        for c in K[name][1:]:
            text = f"({text} * ({x}) + ({c!r}::DOUBLE))"
        return text

    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5e0)"
    sq = f"({mid} * {mid})"
    return (
        f"CASE WHEN {p} < 0.02425e0 THEN {poly('c', low)} / {poly('d', low)} "
        f"WHEN {p} > 1 - 0.02425e0 THEN -({poly('c', high)} / {poly('d', high)}) "
        f"ELSE {poly('a', sq)} * {mid} / {poly('b', sq)} END"
    )


def r8(*names: str) -> str:
    return ", ".join(f"round({n}, 8) AS {n}" for n in names)


ORACLES: dict[str, str] = {
    "candles_normalize": """
SELECT asset, day, round(px, 8) AS open, round(px * 2, 8) AS high, round(px / 2, 8) AS low, round(px, 8) AS close, volume FROM (
  SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, l_quantity AS volume
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, epoch(l_shipdate)
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) = 1)
""",
    "prices_range_scan": with_ctes("prices", """
SELECT asset, day, open, high, low, close, volume FROM prices WHERE asset = 'A' AND day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
"""),
    "missing_ranges": with_ctes("prices", """
, requests AS (SELECT * FROM (VALUES
  ('A', DATE '1990-01-01', DATE '2010-01-01', FALSE), ('N', DATE '1999-01-01', DATE '2000-01-01', FALSE),
  ('R', DATE '1996-01-01', DATE '2003-01-01', TRUE), ('X', DATE '1996-01-01', DATE '2003-01-01', FALSE)) t(asset, start_day, end_day, refresh))
, j AS (SELECT * FROM requests LEFT JOIN (SELECT asset, min(day) AS lo, max(day) AS hi FROM prices GROUP BY asset) USING (asset))
, gaps AS (
  SELECT asset, 'whole' AS gap, start_day AS from_day, end_day AS to_day FROM j WHERE lo IS NULL OR refresh
  UNION ALL SELECT asset, 'head', start_day, lo FROM j WHERE lo IS NOT NULL AND NOT refresh AND start_day < lo
  UNION ALL SELECT asset, 'tail', CAST(hi + INTERVAL 1 DAY AS DATE), end_day FROM j
            WHERE lo IS NOT NULL AND NOT refresh AND end_day > CAST(hi + INTERVAL 1 DAY AS DATE))
SELECT * FROM gaps WHERE from_day < to_day
"""),
    "prices_upsert_keep_last": with_ctes("prices", """
, both_sides AS (
  SELECT asset, day, open, high, low, close, volume, ingest_seq FROM prices
  UNION ALL SELECT asset, day, open, high, low, close * 1.01e0, volume, ingest_seq + 100000 FROM prices WHERE ingest_seq % 3 = 0)
SELECT asset, day, open, high, low, round(close, 8) AS close, volume, ingest_seq FROM both_sides
QUALIFY row_number() OVER (PARTITION BY asset, day ORDER BY ingest_seq DESC) = 1
"""),
    "log_returns": with_ctes("returns", "SELECT asset, day, idx, round(r, 8) AS r FROM returns"),
    "returns_as_of": with_ctes("returns", "SELECT asset, day, idx, round(r, 8) AS r FROM returns WHERE day <= DATE '2000-06-30'"),
    "returns_tail_n": with_ctes("returns", """
SELECT asset, day, 249 - (rank - 1) - greatest(250 - n, 0) AS idx, full_idx, round(r, 8) AS r FROM (
  SELECT asset, day, idx AS full_idx, r, row_number() OVER (PARTITION BY asset ORDER BY idx DESC) AS rank, count(*) OVER (PARTITION BY asset) AS n
  FROM returns) WHERE rank <= 250
"""),
    "oos_split": with_ctes("returns oos", """
SELECT asset, n, oos_start, count(*) FILTER (WHERE idx >= oos_start) AS n_oos,
       min(day) FILTER (WHERE idx >= oos_start) AS oos_first, max(day) FILTER (WHERE idx < oos_start) AS train_last
FROM returns JOIN oos USING (asset) GROUP BY asset, n, oos_start
"""),
    "dq_counts": with_ctes("quality_counts", "SELECT * EXCLUDE (first_day, last_day) FROM quality_counts"),
    "calendar_gaps": with_ctes("prices_dirty", """
SELECT asset, CAST(d AS DATE) AS day FROM (
  SELECT asset, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM prices_dirty GROUP BY asset) c
WHERE NOT EXISTS (SELECT 1 FROM prices_dirty p WHERE p.asset = c.asset AND p.day = CAST(c.d AS DATE))
"""),
    "extreme_moves": with_ctes("quality_moves", "SELECT * FROM quality_moves"),
    "dq_report": with_ctes("quality_counts quality_moves", """
SELECT asset, n_rows, array_to_string(list_filter([
    CASE WHEN n_rows = 0 THEN 'data is empty' END,
    CASE WHEN n_duplicates > 0 THEN n_duplicates || ' duplicate timestamp(s) in index' END,
    CASE WHEN n_inversions > 0 THEN 'index is not sorted ascending' END,
    CASE WHEN non_positive THEN 'non-positive price(s) found in OHLC columns' END,
    CASE WHEN negative_volume THEN 'negative volume(s) found' END,
    CASE WHEN n_high_below_low > 0 THEN n_high_below_low || ' row(s) where high < low' END], lambda e: e IS NOT NULL), '; ') AS errors,
  array_to_string(list_filter([
    CASE WHEN n_missing_dates > 0 THEN n_missing_dates || ' missing date(s) in expected D calendar between ' || first_day || ' and ' || last_day END,
    CASE WHEN n_extreme > 0 THEN n_extreme || ' day(s) with |log return| > 0.25: ' || replace(first_days, ',', ', ') || CASE WHEN n_extreme > 5 THEN '...' ELSE '' END END
    ], lambda e: e IS NOT NULL), '; ') AS warnings, n_errors = 0 AS is_valid
FROM quality_counts LEFT JOIN quality_moves USING (asset)
"""),
    "rolling_volatility": with_ctes("returns", """
SELECT asset, day, round(CASE WHEN n >= 30 THEN sd * sqrt(365) END, 8) AS rolling_vol, round(CASE WHEN n >= 5 THEN sd END, 8) AS rolling_vol_min5 FROM (
  SELECT asset, day, stddev_samp(r) OVER f AS sd, count(r) OVER f AS n FROM returns
  WINDOW f AS (PARTITION BY asset ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""),
    "realized_variance": with_ctes("returns", """
SELECT asset, day, round(CASE WHEN n >= 30 THEN s END, 8) AS realized_variance FROM (
  SELECT asset, day, sum(r * r) OVER f AS s, count(r) OVER f AS n FROM returns
  WINDOW f AS (PARTITION BY asset ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""),
    "rolling_variance_forecast": with_ctes("returns", """
SELECT asset, day, round(CASE WHEN n >= 30 THEN s END, 8) AS rolling_forecast FROM (
  SELECT asset, day, var_samp(r) OVER f AS s, count(r) OVER f AS n FROM returns
  WINDOW f AS (PARTITION BY asset ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
"""),
    "ewma_variance": with_ctes("ewma_path", "SELECT asset, day, round(v, 8) AS ewma_variance FROM ewma_path"),
    "ewma_volatility": with_ctes("ewma_path", "SELECT asset, day, round(sqrt(v) * sqrt(365), 8) AS ewma_vol FROM ewma_path"),
    "ewma_forecast": with_ctes("ewma_oos_forecast", f"SELECT asset, day, {r8('ewma_forecast')} FROM ewma_oos_forecast WHERE idx >= oos_start"),
    "garch_variance_path": with_ctes("garch_path", f"SELECT asset, day, {r8('sigma2', 'eps2')} FROM garch_path"),
    "standardized_residuals": with_ctes("residuals", f"SELECT asset, day, {r8('z')} FROM residuals"),
    "historical_horizon_returns": with_ctes("horizon_moves", f"SELECT asset, horizon_days, start_day, day, {r8('log_return')} FROM horizon_moves"),
    "historical_worst_case": with_ctes("worst_moves", f"""
SELECT asset, horizon_days, window_start, window_end, {r8('cumulative_log_return', 'loss_fraction')} FROM worst_moves
"""),
    "vol_history": with_ctes("returns garch_params", f"""
, ranked AS (SELECT asset, day, idx, r, CASE WHEN count(r) OVER f >= 30 THEN stddev_samp(r) OVER f * sqrt(365) END AS realized_vol,
    row_number() OVER (PARTITION BY asset ORDER BY idx DESC) AS back, count(*) OVER (PARTITION BY asset) AS n
  FROM returns WINDOW f AS (PARTITION BY asset ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
, tail AS (SELECT asset, day, r, realized_vol, least(n, 365) - back AS k FROM ranked WHERE back <= 365)
, seeded AS (SELECT t.*, omega, alpha, beta, (r - mu) * (r - mu) AS eps2, var_samp(r - mu) OVER (PARTITION BY t.asset) AS seed
  FROM tail t JOIN garch_params USING (asset))
, path AS (
  SELECT *, omega + (alpha + beta) * seed AS s FROM seeded WHERE k = 0
  UNION ALL SELECT n.*, n.omega + n.alpha * p.eps2 + n.beta * p.s FROM path p JOIN seeded n ON n.asset = p.asset AND n.k = p.k + 1)
SELECT asset, day, round(sqrt(greatest(s, 0) * 365), 8) AS conditional_vol, round(realized_vol, 8) AS realized_vol FROM path
"""),
    "value_at_risk": with_ctes("loss_tails", f"SELECT asset, horizon_days, confidence, {r8('value_at_risk')} FROM loss_tails"),
    "expected_shortfall": with_ctes("loss_tails", f"SELECT asset, horizon_days, confidence, {r8('expected_shortfall')} FROM loss_tails"),
    "tail_risk_historical": with_ctes("loss_tails", f"""
SELECT asset, horizon_days, confidence, n_scenarios, {r8('value_at_risk', 'expected_shortfall')} FROM loss_tails
"""),
    "return_percentiles": with_ctes("horizon_losses", "\nUNION ALL\n".join(
        f"SELECT asset, horizon_days, {p} AS percentile, round(quantile_cont(x, {p / 100!r}::DOUBLE), 8) AS value FROM horizon_losses GROUP BY asset, horizon_days"
        for p in (1, 5, 25, 50, 75, 95, 99)
    )),
    "series_summary": with_ctes("returns", """
SELECT asset, count(r) AS n, min(day) AS first_day, max(day) AS last_day, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS std,
       round(avg(r) * 365, 8) AS annual_drift, round(stddev_samp(r) * sqrt(365), 8) AS annual_vol FROM returns GROUP BY asset
"""),
    "sample_moments": with_ctes("returns", "SELECT asset, round(skewness(r), 8) AS skew, round(kurtosis(r), 8) AS kurtosis FROM returns GROUP BY asset"),
    "jarque_bera": with_ctes("returns", """
, m AS (SELECT asset, count(*) AS n, avg(pow(r - mean, 2)) AS m2, avg(pow(r - mean, 3)) AS m3, avg(pow(r - mean, 4)) AS m4
  FROM (SELECT *, avg(r) OVER (PARTITION BY asset) AS mean FROM returns) GROUP BY asset)
, j AS (SELECT asset, n / 6e0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m)
SELECT asset, round(jb, 8) AS jb, round(exp(-jb / 2), 8) AS p_value FROM j
"""),
    "acf": with_ctes("acf_r acf_r2", """
SELECT asset, n, lag, round(a.acf, 8) AS acf, round(b.acf, 8) AS acf_squared FROM acf_r a JOIN acf_r2 b USING (asset, n, lag)
"""),
    "ljung_box": with_ctes("acf_z2", """
, q AS (SELECT asset, m AS lags, n * (n + 2) * sum(acf * acf / (n - lag)) AS statistic
  FROM acf_z2 CROSS JOIN (VALUES (10), (20)) v(m) WHERE lag <= m GROUP BY asset, n, m)
, terms AS (SELECT asset, lags, statistic, list_sum([pow(statistic / 2, i) / gamma(i + 1) for i in range(0, lags // 2)]) AS s FROM q)
SELECT asset, lags, round(statistic, 8) AS statistic, round(exp(-statistic / 2) * s, 8) AS p_value FROM terms
"""),
    "return_histogram": with_ctes("returns", """
, s AS (SELECT asset, min(r) AS lo, (max(r) - min(r)) / 120 AS width, avg(r) AS mean, stddev_samp(r) AS sd, count(*) AS n FROM returns GROUP BY asset)
, b AS (SELECT asset, CAST(least(floor((r - lo) / width), 119) AS INTEGER) AS bin, count(*) AS held FROM returns JOIN s USING (asset) GROUP BY ALL)
, e AS (SELECT s.*, CAST(bin AS INTEGER) AS bin FROM s CROSS JOIN range(120) t(bin))
SELECT asset, bin, coalesce(held, 0) AS rows, round(coalesce(held, 0) / (n * width), 8) AS density,
       round(exp(-pow((lo + (bin + 0.5e0) * width - mean) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 8) AS normal_density
FROM e LEFT JOIN b USING (asset, bin)
"""),
    "qq_normal": with_ctes("returns", f"""
, o AS (SELECT asset, r AS sample, row_number() OVER (PARTITION BY asset ORDER BY r, idx) AS position, count(*) OVER (PARTITION BY asset) AS n FROM returns)
, m AS (SELECT *, CASE WHEN position = n THEN pow(0.5, 1.0 / n) WHEN position = 1 THEN 1 - pow(0.5, 1.0 / n)
        ELSE (position - 0.3175e0) / (n + 0.365e0) END AS p FROM o)
SELECT asset, CAST(position AS INTEGER) AS position, round({_normal_quantile('p')}, 8) AS theoretical, round(sample, 8) AS sample FROM m
"""),
}
