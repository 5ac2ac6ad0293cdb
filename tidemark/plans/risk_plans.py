"""Queries on models, scenarios, risk, stress, quotes and validation."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.literal import literal_table
from tidemark.functions.joins import spread_lookup
from tidemark.operators import garch as G, risk as R, scenarios as S, series as SE, stats as A, validation as V
from tidemark.operators.prices import tail_n, with_oos
from tidemark.plans.common import Query, query, returns_of
from tidemark.plans.report import validation_report
from tidemark.sources import fixtures as X, model_state as M
from tidemark.sources.stored import stored

CONFIDENCES = (0.95, 0.99)
METHODS = (S.HISTORICAL, S.FILTERED_HISTORICAL, S.GBM)
N_SCENARIOS = S.DEFAULT_SCENARIOS
SEED = S.DEFAULT_SEED
GRID = [(i, a, p - a) for i, (a, p) in enumerate((a, p) for p in (0.6, 0.9, 0.97) for a in (0.03, 0.08, 0.15))]


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return returns_of(spark, sf_dir), X.garch_params(spark)


def _stored_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """For plans that read the returns several times."""
    return stored(returns_of(spark, sf_dir), "returns"), X.garch_params(spark)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.state_for(*_inputs(spark, sf_dir))


def _early_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """State after the first 750 returns, and all returns."""
    returns, params = _inputs(spark, sf_dir)
    return G.fit_state(SE.garch_variance_path(returns.where("idx < 750").join(params, "asset"))), returns


def model_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state row per observed day from row 750 on; every 21st is a fit."""
    path = SE.garch_variance_path(_inputs(spark, sf_dir)[0].join(X.garch_params(spark), "asset")).where("idx >= 750")
    is_fit = (F.col("idx") - 750) % 21 == 0
    at = F.col("day").cast("timestamp")
    return path.select(
        "asset", F.lit("garch_1_1").alias("model_name"), F.lit("v1").alias("model_version"),
        F.date_sub("day", 750).alias("training_window_start"), F.col("day").alias("training_window_end"),
        F.lit(750).cast("bigint").alias("n_obs_fit"),
        F.create_map(*[x for n in G.PARAMS for x in (F.lit(n), F.col(n))]).alias("fitted_params"),
        F.create_map(F.lit("converged"), F.lit(1.0)).alias("fit_diagnostics"),
        at.alias("fit_timestamp"), F.col("sigma2").alias("latest_conditional_variance"),
        F.col("day").alias("latest_observation_day"), F.col("eps2").alias("latest_squared_residual"),
        F.create_map(F.lit("dist"), F.lit("normal")).alias("config"), is_fit.alias("is_fit"), at.alias("observed_at"),
    )


def _flat_state(states: DataFrame) -> DataFrame:
    return states.select(
        "asset", "model_name", "latest_observation_day", "latest_conditional_variance", "latest_squared_residual",
        F.col("fitted_params")["alpha"].alias("alpha"), "is_fit",
    )


def model_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_state(M.latest_state(model_states(spark, sf_dir)))


def model_state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_state(M.state_history(model_states(spark, sf_dir)))


def garch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum likelihood on the last 750 rows of all 42 series."""
    return G.fit_garch(tail_n(returns_of(spark, sf_dir, X.by_flag_status_line()), 750))


def garch_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = literal_table(spark, GRID, "grid_id int, alpha double, beta double")
    return G.grid_fit(returns_of(spark, sf_dir), grid)


def garch_param_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates derived from each asset's sample variance, some of them invalid."""
    grid = literal_table(spark, [(0, 0.1, 0.8), (1, 0.2, 0.9), (2, -0.1, 0.9), (3, 0.3, -0.1), (4, 0.5, 0.5)], "grid_id int, alpha double, beta double")
    variance = returns_of(spark, sf_dir).groupBy("asset").agg(F.var_samp("r").alias("v"), F.avg("r").alias("mu"))
    candidates = variance.crossJoin(grid).withColumn("omega", F.col("v") * F.round(1 - F.col("alpha") - F.col("beta"), 6))
    return G.param_violations(candidates).select("asset", "grid_id", *G.PARAMS, "violation")


def garch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.garch_summary(_state(spark, sf_dir))


def garch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).drop(*G.PARAMS)


def garch_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.garch_forecast(_state(spark, sf_dir), 30).select("asset", "step", "variance")


def vol_term_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vol_term_structure(_state(spark, sf_dir), 60)


def garch_update_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.apply_updates(*_early_state(spark, sf_dir)).select("asset", "day", "sigma2", "eps2")


def refit_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits end 10, 21 and 30 returns before the end of the three series."""
    returns = returns_of(spark, sf_dir)
    back = F.when(F.col("asset") == "A", 10).when(F.col("asset") == "N", 21).otherwise(30)
    ends = tail_n(returns, 31).where(F.col("idx") == 30 - back).select("asset", F.col("day").alias("fit_end"))
    return G.refit_due(ends, returns)


def result_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, params = _inputs(spark, sf_dir)
    return G.result_fingerprint(returns, G.state_for(returns, params))


def garch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = G.garch_view(*_stored_inputs(spark, sf_dir))
    return view.withColumn("vol_history", F.to_json("vol_history")).withColumn("params", F.to_json("params")).withColumn(
        "training_window", F.to_json("training_window")
    )


def current_vol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.current_vol_table(*_stored_inputs(spark, sf_dir))


def model_of(spark: SparkSession, sf_dir: str, asset: Column | None = None, params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    returns = stored(returns_of(spark, sf_dir, asset), "returns")
    return returns, stored(S.scenario_model(returns, X.garch_params(spark) if params is None else params), "model")


def _tails(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    returns, model = model_of(spark, sf_dir)
    losses = R.losses_by_method(returns, model, X.HORIZONS, [method], N_SCENARIOS, SEED)
    measured = A.tail_measures(losses, ["asset", "horizon_days"], "x", CONFIDENCES)
    return measured.select("asset", "horizon_days", "confidence", "n_scenarios", "value_at_risk", "expected_shortfall")


def tail_risk_fhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tails(spark, sf_dir, S.FILTERED_HISTORICAL)


def tail_risk_gbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tails(spark, sf_dir, S.GBM)


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, model = model_of(spark, sf_dir)
    return R.risk_results(returns, model, X.HORIZONS, CONFIDENCES, n_scenarios=N_SCENARIOS, seed=SEED)


def risk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir)


def tail_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).select(
        "asset", "horizon_days", "method", "confidence", "value_at_risk", "expected_shortfall", "forecast_volatility_annualized"
    )


def tail_comparison_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tail_pivot(_risk(spark, sf_dir), METHODS, max(CONFIDENCES))


def _fhs_tails(returns: DataFrame, model: DataFrame) -> DataFrame:
    stops = sorted(set(X.HORIZONS) | set(R.extended_horizons(X.HORIZONS).values()))
    losses = R.losses_by_method(returns, model, stops, [S.FILTERED_HISTORICAL], N_SCENARIOS, SEED)
    return A.tail_measures(losses, ["asset", "horizon_days"], "x", [0.99])


def stress_vol_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = model_of(spark, sf_dir)
    return R.stress_vol_shock(model, X.HORIZONS, 0.99, n_scenarios=N_SCENARIOS, seed=SEED).drop("ord")


def stress_gap_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stress_gap_down(_state(spark, sf_dir), X.HORIZONS).drop("ord")


def stress_extended_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, model = model_of(spark, sf_dir)
    return R.stress_extended_horizon(_fhs_tails(returns, model), X.HORIZONS).drop("ord")


def _stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, model = model_of(spark, sf_dir)
    return R.stress_summary(returns, model, _fhs_tails(returns, model), X.HORIZONS, 0.99, N_SCENARIOS, SEED)


def stress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stress(spark, sf_dir)


def worst_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.worst_stress(_stress(spark, sf_dir))


def snapshot_of(spark: SparkSession, sf_dir: str, n_scenarios: int = N_SCENARIOS, asset: Column | None = None, params: DataFrame | None = None) -> DataFrame:
    returns, model = model_of(spark, sf_dir, asset, params)
    return R.risk_snapshot(returns, model, X.HORIZONS, 0.99, n_scenarios=n_scenarios, seed=SEED)


def risk_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_of(spark, sf_dir)


def collateral_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per deal; losses derived from the deal reach below and above the clamp."""
    policy = R.CollateralPolicy("1.10", "0.90", "1.05", "2.00")
    rows = X.deals(spark, sf_dir).select(
        "deal_id", "notional",
        ((F.col("deal_id") % 97) / F.lit(100)).cast(R.LOSS).alias("es_loss"),
        ((F.col("deal_id") % 131) / F.lit(100)).cast(R.LOSS).alias("stress_loss"),
    )
    return R.collateral_decision(rows, policy)


def _asset_of_deal() -> Column:
    return F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("deal_id") % 3 + 1).cast("int"))


def exposure_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = R.spot_prices(X.prices(spark, sf_dir))
    deals = X.deals(spark, sf_dir).select("deal_id", _asset_of_deal().alias("asset"), "notional")
    return R.exposure_usd(spread_lookup(deals, spots, ["asset"], "deal_id", how="inner"))


def quote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deals(spark, sf_dir).select(
        F.col("deal_id").alias("request_id"), _asset_of_deal().alias("asset"), "notional", "horizon_days", "created_at"
    )


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = stored(snapshot_of(spark, sf_dir), "snapshot")
    return R.price_quotes(quote_requests(spark, sf_dir), snapshot, R.spot_prices(X.prices(spark, sf_dir)))


def price_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir)


def unpriced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some requests name an asset without prices, some a horizon that the snapshot does not hold."""
    snapshot = stored(snapshot_of(spark, sf_dir).select("asset", "horizon_days"), "snapshot-keys")
    requests = quote_requests(spark, sf_dir)
    rest = lambda n: F.col("request_id") % n == 0
    requests = requests.withColumn("asset", F.when(rest(19), "X").otherwise(F.col("asset"))).withColumn(
        "horizon_days", F.when(rest(23), 21).otherwise(F.col("horizon_days"))
    )
    return R.unpriced_requests(requests, snapshot, R.spot_prices(X.prices(spark, sf_dir)))


def quote_onchain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_onchain_fields(_quotes(spark, sf_dir))


SNAPSHOT_FIELDS = ("asset", "notional", "horizon_days", "loss", "created_at", "collateral_ratio")


def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of a deal's terms and its hash."""
    rows = X.deals(spark, sf_dir).select(
        "deal_id", _asset_of_deal().alias("asset"), "notional", "horizon_days", "created_at",
        F.struct(
            ((F.col("deal_id") % 97) / F.lit(100)).cast(R.LOSS).alias("var"), ((F.col("deal_id") % 131) / F.lit(100)).cast(R.LOSS).alias("es")
        ).alias("loss"),
        (F.lit(1) + (F.col("deal_id") % 131) / F.lit(100)).cast("decimal(15,12)").alias("collateral_ratio"),
    )
    return R.snapshot_hash(rows, SNAPSHOT_FIELDS).select("deal_id", "snapshot_json", "snapshot_hash")


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.volatility_frame(*_stored_inputs(spark, sf_dir))


def garch_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, params = _inputs(spark, sf_dir)
    return V.garch_walk_forward(with_oos(returns), params)


def garch_walk_forward_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every refit done by maximum likelihood."""
    return V.garch_walk_forward(with_oos(returns_of(spark, sf_dir)))


def volatility_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.volatility_metrics(_frame(spark, sf_dir))


def volatility_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.volatility_series(_frame(spark, sf_dir))


def metrics_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.metrics_ranked(V.volatility_metrics(_frame(spark, sf_dir)))


def var_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, params = _inputs(spark, sf_dir)
    return V.var_multiplier(with_oos(returns), CONFIDENCES, params)


def _backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, params = _stored_inputs(spark, sf_dir)
    return V.var_backtest_series(returns, CONFIDENCES, params)


def var_backtest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir)


def var_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.var_backtest(_backtest(spark, sf_dir))


def kupiec_pof(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _backtest(spark, sf_dir).groupBy("asset", "confidence").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum(F.col("exceed").cast("bigint")).alias("n_exceedances")
    )
    return A.kupiec(counts)


def es_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.es_backtest(_backtest(spark, sf_dir), ["asset", "confidence"])


def validation_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns, params = _stored_inputs(spark, sf_dir)
    return validation_report(returns, params, n_scenarios=N_SCENARIOS)


QUERIES: dict[str, Query] = {
    fn.__name__: query(fn)
    for fn in (
        model_state_latest, model_state_history, garch_fit, garch_grid_fit, garch_param_checks, garch_summary, garch_state,
        garch_forecast, vol_term_structure, garch_update_replay, refit_due, result_fingerprint, garch_view, current_vol_table,
        tail_risk_fhs, tail_risk_gbm, risk_results, tail_comparison, tail_comparison_pivot, stress_vol_shock, stress_gap_down,
        stress_extended_horizon, stress_summary, worst_stress, risk_snapshot, collateral_policy, exposure_usd, price_quotes,
        unpriced_requests, quote_onchain_fields, snapshot_hash, garch_walk_forward, garch_walk_forward_fitted, volatility_metrics, volatility_series,
        metrics_ranked, var_multiplier, var_backtest_series, var_backtest, kupiec_pof, es_backtest, validation_report_json,
    )
}
