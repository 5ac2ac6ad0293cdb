"""Rolling and recursive series per asset. A rolling value is null until its window is full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.affine import affine_scan
from tidemark.operators.prices import annualize_vol, tail_n

EWMA_LAMBDA = 0.94


def _frame(start: int, end: int, keys: Sequence[str] = ("asset",)):
    return W.partitionBy(*keys).orderBy("idx").rowsBetween(start, end)


def rolling_volatility_column(window: int = 30, *, annualize: bool = True, min_periods: int | None = None) -> Column:
    frame = _frame(-(window - 1), 0)
    vol = F.stddev_samp("r").over(frame)
    if annualize:
        vol = annualize_vol(vol)
    return F.when(F.count("r").over(frame) >= (min_periods or window), vol)


def rolling_volatility(returns: DataFrame, window: int = 30, *, annualize: bool = True, min_periods: int | None = None) -> DataFrame:
    return returns.withColumn("rolling_vol", rolling_volatility_column(window, annualize=annualize, min_periods=min_periods))


def realized_variance(returns: DataFrame, window: int) -> DataFrame:
    frame = _frame(-(window - 1), 0)
    square = F.col("r") * F.col("r")
    return returns.withColumn("realized_variance", F.when(F.count("r").over(frame) >= window, F.sum(square).over(frame)))


def rolling_variance_forecast(returns: DataFrame, window: int = 30) -> DataFrame:
    """Sample variance of the ``window`` rows before each row: one frame, no extra lag."""
    frame = _frame(-window, -1)
    return returns.withColumn("rolling_forecast", F.when(F.count("r").over(frame) >= window, F.var_samp("r").over(frame)))


def _check_lambda(lam: float) -> None:
    if not 0 < lam < 1:
        raise ValueError(f"lam must be in (0, 1), got {lam}")


def ewma_variance(returns: DataFrame, lam: float = EWMA_LAMBDA, *, seed: Column | None = None, levels: int = 1) -> DataFrame:
    """v = lam * v_before + (1 - lam) * r^2. The default seed is the sample variance of the whole series."""
    _check_lambda(lam)
    seed = F.var_samp("r").over(W.partitionBy("asset")) if seed is None else seed
    update = F.lit(1 - lam) * F.col("r") * F.col("r")
    steps = returns.withColumn("_seed", seed).withColumn("_a", F.lit(lam)).withColumn(
        "_b", F.when(F.col("idx") == 0, F.lit(lam) * F.col("_seed") + update).otherwise(update)
    )
    return affine_scan(steps.drop("_seed"), ["asset"], "idx", "_a", "_b", "ewma_variance", levels=levels).drop("_a", "_b")


def ewma_volatility(returns: DataFrame, lam: float = EWMA_LAMBDA, *, annualize: bool = True) -> DataFrame:
    vol = F.sqrt("ewma_variance")
    return ewma_variance(returns, lam).withColumn("ewma_vol", annualize_vol(vol) if annualize else vol)


def ewma_variance_forecast(returns_with_oos: DataFrame, lam: float = EWMA_LAMBDA) -> DataFrame:
    """One-step forecast seeded only from rows before ``oos_start``, so nothing scored leaks into the seed."""
    train = F.when(F.col("idx") < F.col("oos_start"), F.col("r"))
    scanned = ewma_variance(returns_with_oos, lam, seed=F.var_samp(train).over(W.partitionBy("asset")))
    return scanned.withColumn("ewma_forecast", F.lag("ewma_variance").over(W.partitionBy("asset").orderBy("idx")))


def garch_variance_path(
    rows: DataFrame,
    *,
    keys: Sequence[str] = ("asset",),
    train: Column | None = None,
    init: str | None = None,
    init_eps2: str | None = None,
    levels: int = 1,
) -> DataFrame:
    """Conditional variance ``sigma2`` and squared residual ``eps2`` for rows (keys, idx, r, omega, alpha, beta, mu).

    The value before index 0 is, for variance and squared residual alike, the sample variance of the residuals
    (of the ``train`` rows only, if given), never omega / (1 - alpha - beta), which explodes near persistence 1.
    ``init`` and ``init_eps2`` name columns that replace it by a stored state.
    """
    whole = W.partitionBy(*keys)
    by_idx = W.partitionBy(*keys).orderBy("idx")
    eps = rows.withColumn("_eps", F.col("r") - F.col("mu")).withColumn("eps2", F.col("_eps") * F.col("_eps"))
    if init:
        seeded = eps.withColumn("_s0", F.col(init)).withColumn("_e0", F.coalesce(F.col(init_eps2 or init), F.lit(0.0)))
    else:
        sample = F.col("_eps") if train is None else F.when(train, F.col("_eps"))
        seeded = eps.withColumn("_s0", F.var_samp(sample).over(whole)).withColumn("_e0", F.col("_s0"))
    steps = seeded.withColumn(
        "_b",
        F.col("omega")
        + F.col("alpha") * F.coalesce(F.lag("eps2").over(by_idx), F.col("_e0"))
        + F.when(F.col("idx") == 0, F.col("beta") * F.col("_s0")).otherwise(0.0),
    ).drop("_eps", "_s0", "_e0")
    scanned = affine_scan(steps.withColumn("_a", F.col("beta")), keys, "idx", "_a", "_b", "sigma2", levels=levels)
    return scanned.drop("_a", "_b")


def standardized_residuals(path: DataFrame) -> DataFrame:
    return path.withColumn("z", (F.col("r") - F.col("mu")) / F.sqrt("sigma2"))


def historical_horizon_returns(returns: DataFrame, horizons: Sequence[int], *, strict: bool = False) -> DataFrame:
    """Overlapping h-day log returns (asset, horizon_days, idx, start_day, day, log_return) for all horizons.

    One sort of the series serves every horizon. ``strict`` raises for an asset shorter than a horizon; otherwise
    that pair just has no rows.
    """
    if min(horizons) < 1:
        raise ValueError(f"horizon_days must be >= 1, got {min(horizons)}")
    by_idx = W.partitionBy("asset").orderBy("idx")
    n = F.count(F.lit(1)).over(W.partitionBy("asset"))
    windows = [
        F.struct(
            F.lit(h).alias("horizon_days"),
            F.lag("day", h - 1).over(by_idx).alias("start_day"),
            F.sum("r").over(_frame(-(h - 1), 0)).alias("log_return"),
        )
        for h in horizons
    ]
    spread = returns.select("asset", "idx", "day", n.alias("_n"), F.array(*windows).alias("_w"))
    if strict:
        short = F.concat(F.lit(f"fewer than {max(horizons)} returns for "), F.col("asset"))
        spread = spread.where(F.when(F.col("_n") < max(horizons), F.raise_error(short).cast("boolean")).otherwise(True))
    return (
        spread.select("asset", "idx", "day", F.inline("_w"))
        .where(F.col("idx") >= F.col("horizon_days") - 1)
        .select("asset", "horizon_days", "idx", "start_day", "day", "log_return")
    )


def historical_worst_case(returns: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """The worst h-day window per asset and horizon, the earliest on ties, with its dates and loss."""
    moves = historical_horizon_returns(returns, horizons)
    worst = moves.groupBy("asset", "horizon_days").agg(
        F.min(F.struct("log_return", "idx", "start_day", "day")).alias("_w")
    )
    return worst.select(
        "asset", "horizon_days",
        F.col("_w.start_day").alias("window_start"),
        F.col("_w.day").alias("window_end"),
        F.col("_w.log_return").alias("cumulative_log_return"),
        F.greatest(-F.expm1("_w.log_return"), F.lit(0.0)).alias("loss_fraction"),
    )


def vol_history(returns: DataFrame, params: DataFrame, n: int = 365, realized_window: int = 30) -> DataFrame:
    """The last ``n`` days: conditional volatility recomputed on that slice beside realised volatility of the full series.

    The realised value is carried along through the slice, so no join is needed to bring both together.
    """
    full = rolling_volatility(returns, realized_window).withColumnRenamed("rolling_vol", "realized_vol")
    path = garch_variance_path(tail_n(full, n).join(params, "asset"))
    return path.select(
        "asset", "day",
        F.sqrt(F.greatest(F.col("sigma2"), F.lit(0.0)) * 365).alias("conditional_vol"),
        "realized_vol",
    )
