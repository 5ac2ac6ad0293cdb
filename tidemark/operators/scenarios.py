"""Horizon scenarios per asset: historical windows, filtered historical simulation, geometric Brownian motion.

Random numbers are a function of (seed, stream, asset, scenario, step), so a scenario is the same on any
partitioning and after any retry. One simulated path serves every horizon it passes, so asking for more horizons costs nothing
until the longest one grows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.counter_rng import standard_normal, stream_key, uniforms
from tidemark.functions.joins import spread_work
from tidemark.operators.garch import FITTING_WINDOW, PARAMS, fit_state, state_for
from tidemark.operators.prices import tail_n
from tidemark.operators.series import garch_variance_path, historical_horizon_returns, standardized_residuals

HISTORICAL = "historical_simulation"
FILTERED_HISTORICAL = "filtered_historical_simulation"
GBM = "gbm_monte_carlo"
DEFAULT_SCENARIOS = 50_000
DEFAULT_SEED = 42
BLOCK_SCENARIOS = 4096
MAX_SCENARIOS = 2**32


def scenario_model(
    returns: DataFrame, params: DataFrame, *, window: int = FITTING_WINDOW, residual_pool_window: int | None = None
) -> DataFrame:
    """One row per asset with all a simulation needs: parameters, filtered state, mean return, residual pool.

    The pool spans the whole history although the state comes from the fitting window. It is one double per
    calendar day (290 KB a century), so it travels as an array inside the asset's row.
    """
    state = state_for(returns, params, window)
    pooled = returns if residual_pool_window is None else tail_n(returns, residual_pool_window)
    residuals = standardized_residuals(garch_variance_path(pooled.join(params, "asset")))
    pool = residuals.groupBy("asset").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "z"))), lambda x: x["z"]).alias("pool")
    )
    mean = returns.groupBy("asset").agg(F.avg("r").alias("mean_return"))
    return state.join(pool, "asset").join(mean, "asset")


def _in_blocks(model: DataFrame, n_scenarios: int) -> DataFrame:
    """One row per (asset, block of 4,096 scenarios), spread over the cluster; ``_lo`` and ``_hi`` bound the block."""
    blocks = -(-n_scenarios // BLOCK_SCENARIOS)
    spread = spread_work(model.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "asset", "_block")
    low = F.col("_block") * BLOCK_SCENARIOS
    return spread.withColumn("_lo", low.cast("bigint")).withColumn(
        "_hi", F.least(low + (BLOCK_SCENARIOS - 1), F.lit(n_scenarios - 1)).cast("bigint")
    )


def scenarios_historical(returns: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return historical_horizon_returns(returns, horizons).select(
        "asset", "horizon_days", F.col("idx").alias("scenario_id"), "log_return"
    )


def scenarios_fhs(model: DataFrame, horizons: Sequence[int], n_scenarios: int = DEFAULT_SCENARIOS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Filtered historical paths: each step draws a residual from the pool and runs the variance recursion.

    Spark spreads blocks of scenarios over the cluster; a block is simulated at once on arrays, since a recursion of
    this length as a fold over rows or array elements costs about ten times as much. No draw is ever shuffled.
    """
    if min(horizons) < 1:
        raise ValueError(f"horizon_days must be >= 1, got {min(horizons)}")
    if not 1 <= n_scenarios <= MAX_SCENARIOS:
        raise ValueError(f"n_scenarios must be in [1, 2^32], got {n_scenarios}")
    stops = sorted(set(horizons))
    key = stream_key(F.lit(seed), F.lit("fhs"), F.col("asset"))
    blocks = _in_blocks(model, n_scenarios).select(
        "asset", *PARAMS, F.col("latest_variance").alias("s2"), F.coalesce("latest_eps2", F.lit(0.0)).alias("e2"), "pool", "_lo", "_hi", key.alias("_key")
    )

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                asset, omega, alpha, beta, mu, s2, e2, pool, low, high, stream = row
                pool = np.asarray(pool, dtype=float)
                ids = np.arange(low, high + 1)
                variance, squared, total = np.full(len(ids), s2), np.full(len(ids), e2), np.zeros(len(ids))
                for t in range(stops[-1]):
                    z = pool[(uniforms(stream, ids, t) * len(pool)).astype(np.int64)]
                    variance = omega + alpha * squared + beta * variance
                    eps = z * np.sqrt(variance)
                    squared = eps * eps
                    total = total + mu + eps
                    if t + 1 in stops:
                        yield pd.DataFrame({"asset": asset, "horizon_days": t + 1, "scenario_id": ids, "log_return": total})

    return blocks.mapInPandas(simulate, "asset string, horizon_days int, scenario_id bigint, log_return double")


def normal_draws(model: DataFrame, n_scenarios: int, seed: int, stream: str) -> DataFrame:
    """``model`` without its pool, one row per scenario with a standard normal ``z``."""
    rows = _in_blocks(model.drop("pool"), n_scenarios).withColumn("scenario_id", F.explode(F.sequence("_lo", "_hi")))
    z = standard_normal(F.lit(seed), F.lit(stream), F.col("asset"), F.col("scenario_id"))
    return rows.withColumn("z", z).drop("_block", "_lo", "_hi")


def gbm_log_return(mu_annual, sigma_annual, horizon_days, z):
    """N((mu - sigma^2/2) dt, sigma^2 dt) at the horizon directly, with dt = days / 365."""
    dt = horizon_days / F.lit(365.0)
    return (mu_annual - sigma_annual * sigma_annual / 2) * dt + sigma_annual * F.sqrt(dt) * z


def scenarios_gbm(model: DataFrame, horizons: Sequence[int], n_scenarios: int = DEFAULT_SCENARIOS, seed: int = DEFAULT_SEED) -> DataFrame:
    draws = normal_draws(model, n_scenarios, seed, "gbm")
    sigma = F.sqrt(F.col("latest_variance") * 365)
    spread = draws.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return spread.select(
        "asset", "horizon_days", "scenario_id",
        gbm_log_return(F.col("mean_return") * 365, sigma, F.col("horizon_days"), F.col("z")).alias("log_return"),
    )


__all__ = [
    "HISTORICAL", "FILTERED_HISTORICAL", "GBM", "DEFAULT_SCENARIOS", "DEFAULT_SEED", "PARAMS", "fit_state", "scenario_model",
    "scenarios_historical", "scenarios_fhs", "scenarios_gbm", "normal_draws", "gbm_log_return",
]
