"""The validation report: one JSON document per asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import risk as R, scenarios as S, validation as V
from tidemark.operators.garch import garch_view
from tidemark.sources.fixtures import HORIZONS

CONFIDENCES = (0.95, 0.99)


def _as_list(df: DataFrame, name: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in ("asset", order)]
    return df.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


def validation_report(returns: DataFrame, params: DataFrame, *, n_scenarios: int = S.DEFAULT_SCENARIOS) -> DataFrame:
    """(asset, document): model, volatility comparison, VaR backtest and tail comparison under one date and row count."""
    model = S.scenario_model(returns, params)
    comparison = V.volatility_metrics(V.volatility_frame(returns, params))
    backtest = V.var_backtest(V.var_backtest_series(returns, CONFIDENCES, params))
    tails = R.risk_results(returns, model, HORIZONS, CONFIDENCES, n_scenarios=n_scenarios)
    slim = tails.select("asset", "horizon_days", "method", "confidence", "value_at_risk", "expected_shortfall")
    head = returns.groupBy("asset").agg(F.max("day").cast("string").alias("as_of"), F.count("r").alias("n_returns"))
    view = garch_view(returns, params).drop("vol_history")
    record = F.struct(*[c for c in view.columns if c != "asset"])
    joined = (
        head.join(view.select("asset", record.alias("garch")), "asset")
        .join(_as_list(comparison, "volatility_comparison", "model"), "asset")
        .join(_as_list(backtest, "var_backtest", "confidence"), "asset")
        .join(_as_list(slim, "tail_comparison", "horizon_days"), "asset")
    )
    document = F.to_json(F.struct("as_of", "n_returns", "garch", "volatility_comparison", "var_backtest", "tail_comparison"))
    return joined.select("asset", document.alias("document"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").partitionBy("asset").text(path)


def write_forecasts(frame: DataFrame, path: str) -> None:
    """The forecast table as parquet, one directory per asset."""
    frame.write.mode("overwrite").partitionBy("asset").parquet(path)


__all__ = ["validation_report", "write_report", "write_forecasts"]
