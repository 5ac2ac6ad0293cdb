"""GARCH(1,1): fitting, state, forecasts, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import garch_mle
from tidemark.functions.joins import spread_work
from tidemark.operators.prices import tail_n, var_to_vol
from tidemark.operators.series import EWMA_LAMBDA, ewma_volatility, garch_variance_path, rolling_volatility, vol_history

FITTING_WINDOW = 750
REFIT_FREQUENCY = 21
PARAMS = ("omega", "alpha", "beta", "mu")


def fit_garch(windows: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """One maximum-likelihood fit per group of ``windows`` (keys, idx, r).

    Groups are fitting windows (750 rows by default), never whole tables; every (asset, window) is its own group,
    so a walk-forward refit of one asset runs on all cores. Standard errors that do not exist are null.
    """
    fields = list(garch_mle.fit(_probe()).keys())
    kinds = {"n_obs": "bigint", "converged": "boolean"}
    schema = ", ".join(
        [f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys] + [f"{f} {kinds.get(f, 'double')}" for f in fields]
    )

    def fit_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fitted = garch_mle.fit(rows.sort_values("idx")["r"].to_numpy())
        row = dict(zip(keys, key)) | {k: (None if isinstance(v, float) and math.isnan(v) else v) for k, v in fitted.items()}
        return pd.DataFrame([row])

    return spread_work(windows.select(*keys, "idx", "r"), *keys).groupBy(*keys).applyInPandas(fit_one, schema)


def _probe():
    import numpy as np

    return np.sin(np.arange(40.0)) / 50


def grid_log_likelihood(returns: DataFrame, grid: DataFrame) -> DataFrame:
    """Log-likelihood of every (asset, grid point); omega is set so that the long-run variance is the sample variance.

    ``grid`` holds (grid_id, alpha, beta), a short literal table.
    """
    whole = W.partitionBy("asset")
    marked = returns.withColumn("mu", F.avg("r").over(whole)).withColumn("_var", F.var_samp("r").over(whole))
    candidates = marked.crossJoin(grid).withColumn("omega", F.col("_var") * (1 - F.col("alpha") - F.col("beta"))).drop("_var")
    path = garch_variance_path(spread_work(candidates, "asset", "grid_id"), keys=("asset", "grid_id"))
    term = -0.5 * (F.lit(math.log(2 * math.pi)) + F.ln("sigma2") + F.col("eps2") / F.col("sigma2"))
    return path.groupBy("asset", "grid_id", *PARAMS).agg(F.sum(term).alias("log_likelihood"))


def grid_fit(returns: DataFrame, grid: DataFrame) -> DataFrame:
    scored = grid_log_likelihood(returns, grid)
    best = scored.groupBy("asset").agg(F.max(F.struct("log_likelihood", "grid_id", *PARAMS)).alias("_b"))
    return best.select("asset", "_b.*")


def param_violations(params: DataFrame) -> DataFrame:
    """Adds ``violation``: the first rule a parameter row breaks, null when valid."""
    return params.withColumn(
        "violation",
        F.when(F.col("omega") <= 0, "omega must be > 0")
        .when(F.col("alpha") < 0, "alpha must be >= 0")
        .when(F.col("beta") < 0, "beta must be >= 0"),
    )


def fit_state(path: DataFrame) -> DataFrame:
    """The recursion's state at the end of each series: last variance and squared residual."""
    agg = path.groupBy("asset", *PARAMS).agg(
        F.count(F.lit(1)).alias("n_obs_fit"),
        F.min("day").alias("training_window_start"),
        F.max(F.struct("idx", "day", "sigma2", "eps2")).alias("_last"),
    )
    return agg.select(
        "asset", *PARAMS, "n_obs_fit", "training_window_start",
        F.col("_last.day").alias("latest_day"),
        F.col("_last.sigma2").alias("latest_variance"),
        F.col("_last.eps2").alias("latest_eps2"),
    )


def state_for(returns: DataFrame, params: DataFrame, window: int = FITTING_WINDOW) -> DataFrame:
    """State of the model whose ``params`` were estimated on the last ``window`` rows."""
    return fit_state(garch_variance_path(tail_n(returns, window).join(params, "asset")))


def apply_updates(state: DataFrame, returns: DataFrame) -> DataFrame:
    """Fold the returns after each state's last day into it, without refitting; one row per update."""
    later = returns.join(state, "asset").where(F.col("day") > F.col("latest_day"))
    order = W.partitionBy("asset").orderBy("day")
    indexed = later.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))
    return garch_variance_path(indexed, init="latest_variance", init_eps2="latest_eps2")


def refit_due(state: DataFrame, returns: DataFrame, refit_frequency: int = REFIT_FREQUENCY) -> DataFrame:
    """Counted from the data, so the answer survives a restart. ``state`` needs (asset, fit_end)."""
    later = returns.join(state.select("asset", "fit_end"), "asset").groupBy("asset", "fit_end").agg(
        F.sum((F.col("day") > F.col("fit_end")).cast("bigint")).alias("n_updates")
    )
    return later.withColumn("refit_due", F.col("n_updates") >= refit_frequency)


def persistence():
    return F.col("alpha") + F.col("beta")


def garch_summary(state: DataFrame) -> DataFrame:
    """Persistence, unconditional variance (null from persistence 1 on), half-life, long-run and current volatility."""
    p = persistence()
    with_p = state.withColumn("persistence", p).withColumn(
        "unconditional_variance", F.when(F.col("persistence") < 1, F.col("omega") / (1 - F.col("persistence")))
    )
    return with_p.select(
        "asset", *PARAMS, "persistence", "unconditional_variance",
        F.when(
            (F.col("persistence") > 0) & (F.col("persistence") < 1), F.lit(math.log(0.5)) / F.ln("persistence")
        ).alias("half_life_days"),
        F.sqrt(F.col("unconditional_variance") * 365).alias("long_run_vol"),
        F.sqrt(F.col("latest_variance") * 365).alias("current_vol"),
    )


def garch_forecast(state: DataFrame, horizon: int) -> DataFrame:
    """Variance forecasts for steps 1..horizon in closed form; valid for any persistence."""
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    p = persistence()
    first = F.col("omega") + F.col("alpha") * F.coalesce("latest_eps2", F.lit(0.0)) + F.col("beta") * F.col("latest_variance")
    steps = state.withColumn("_p", p).withColumn("_s1", first).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = (F.col("step") - 1).cast("double")
    grown = F.pow("_p", ahead)
    variance = F.when(F.col("_p") == 1, F.col("_s1") + F.col("omega") * ahead).otherwise(
        grown * F.col("_s1") + F.col("omega") * (1 - grown) / (1 - F.col("_p"))
    )
    return steps.withColumn("variance", variance).drop("_p", "_s1")


def vol_term_structure(state: DataFrame, horizon: int) -> DataFrame:
    long_run = F.when(persistence() < 1, F.sqrt(F.col("omega") / (1 - persistence()) * 365))
    return garch_forecast(state, horizon).select("asset", "step", var_to_vol(F.col("variance")).alias("vol"), long_run.alias("long_run_vol"))


def staleness(returns: DataFrame, state: DataFrame) -> DataFrame:
    data = returns.groupBy("asset").agg(F.max("day").alias("data_as_of"), F.count(F.lit(1)).alias("n_returns"))
    return data.join(state, "asset").withColumn("staleness_days", F.datediff("data_as_of", "latest_day"))


def result_fingerprint(returns: DataFrame, state: DataFrame) -> DataFrame:
    """(asset, fingerprint) from last day, row count and fit day: derived tables are recomputed only when it changes."""
    return staleness(returns, state).select(
        "asset", F.concat_ws("|", F.col("data_as_of").cast("string"), F.col("n_returns").cast("string"), F.col("latest_day").cast("string")).alias("fingerprint")
    )


def needs_recompute(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Assets whose stored result was computed from another fingerprint, or not at all."""
    return current.join(stored.select("asset", "fingerprint"), ["asset", "fingerprint"], "left_anti")


def current_vol_table(returns: DataFrame, params: DataFrame, lam: float = EWMA_LAMBDA) -> DataFrame:
    """Latest annualised estimate of each model, side by side."""
    latest = lambda df, value, model: df.groupBy("asset").agg(
        F.max_by(value, "idx").alias("vol")
    ).withColumn("model", F.lit(model))
    garch = state_for(returns, params).select("asset", var_to_vol(F.col("latest_variance")).alias("vol"), F.lit("garch").alias("model"))
    # The running series goes through both simple models in one pass.
    both = ewma_volatility(rolling_volatility(returns), lam)
    rolling = latest(both, "rolling_vol", "rolling")
    return rolling.unionByName(latest(both, "ewma_vol", "ewma")).unionByName(garch)


def garch_view(returns: DataFrame, params: DataFrame, history_days: int = 365) -> DataFrame:
    """One nested record per asset: parameters, summary, window, staleness and the volatility history."""
    state = state_for(returns, params)
    summary = garch_summary(state)
    history = vol_history(returns, params, history_days).groupBy("asset").agg(
        F.array_sort(F.collect_list(F.struct("day", "conditional_vol", "realized_vol"))).alias("vol_history")
    )
    placed = staleness(returns, state.drop(*PARAMS))
    return summary.join(placed, "asset").join(history, "asset").select(
        "asset",
        F.struct(*PARAMS).alias("params"),
        "persistence", "half_life_days",
        F.col("current_vol").alias("current_vol_annualized"),
        F.col("long_run_vol").alias("long_run_vol_annualized"),
        F.struct(
            F.col("training_window_start").alias("start"), F.col("latest_day").alias("end"), F.col("n_obs_fit").alias("n_obs")
        ).alias("training_window"),
        F.lit(REFIT_FREQUENCY).alias("refit_frequency"),
        "staleness_days", "vol_history",
    )
