"""Walk-forward validation: volatility forecasts, VaR coverage and ES backtests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.joins import spread_work
from tidemark.operators.garch import FITTING_WINDOW, REFIT_FREQUENCY, fit_garch
from tidemark.operators.prices import var_to_vol, with_oos
from tidemark.operators.series import ewma_variance_forecast, garch_variance_path, rolling_variance_forecast, standardized_residuals
from tidemark.operators.stats import es_backtest, kupiec, qlike, rmse

MODELS = ("rolling_hist_vol", "ewma", "garch")


def walk_forward_segments(placed: DataFrame, window: int = FITTING_WINDOW, refit: int = REFIT_FREQUENCY) -> DataFrame:
    """Rows of every refit segment: (asset, segment, idx, full_idx, day, r, train).

    Segment k starts at s = oos_start + k * refit, is fitted on the ``window`` rows before s and scores the ``refit``
    rows from s on. Segments do not depend on each other, so all of them run at once. A row lists the segments it
    belongs to by arithmetic; there is no range join.
    """
    i, start = F.col("full_idx"), F.col("oos_start")
    first = F.greatest(F.floor((i - start - refit) / refit) + 1, F.lit(0))
    last_segment = F.floor((F.col("n") - 1 - start) / refit)
    last = F.least(F.floor((i - start + window) / refit), last_segment)
    rows = placed.withColumnRenamed("idx", "full_idx").withColumn("_first", first).withColumn("_last", last)
    spread = rows.where(F.col("_first") <= F.col("_last")).withColumn(
        "segment", F.explode(F.sequence("_first", "_last"))
    )
    begin = start + F.col("segment") * refit
    local = (i - F.greatest(begin - window, F.lit(0))).cast("bigint")
    return spread.select("asset", "segment", local.alias("idx"), "full_idx", "day", "r", (i < begin).alias("train"))


def garch_walk_forward(
    placed: DataFrame, params: DataFrame | None = None, window: int = FITTING_WINDOW, refit: int = REFIT_FREQUENCY
) -> DataFrame:
    """(asset, idx, day, garch): one-step forecasts of all out-of-sample rows.

    Without ``params`` every segment is fitted by maximum likelihood; with them the recursion alone is walked forward.
    """
    segments = walk_forward_segments(placed, window, refit)
    keys = ["asset", "segment"]
    # Each row is repeated window / refit times: segments, not assets, are what is spread over the cores.
    segments = spread_work(segments, *keys)
    if params is None:
        fits = fit_garch(segments.where("train"), keys).select(*keys, "omega", "alpha", "beta", "mu")
        rows = segments.join(fits, keys)
    else:
        rows = segments.join(params, "asset")
    path = garch_variance_path(rows, keys=keys, train=F.col("train"))
    return path.where(~F.col("train")).select("asset", F.col("full_idx").alias("idx"), "day", F.col("sigma2").alias("garch"))


def volatility_frame(returns: DataFrame, params: DataFrame | None = None, *, realized_window: int = 30, strict: bool = True, **walk) -> DataFrame:
    """Out-of-sample rows with the squared-return proxy and the three forecasts; incomplete rows are dropped."""
    placed = with_oos(returns, strict=strict)
    simple = ewma_variance_forecast(rolling_variance_forecast(placed, realized_window)).where("idx >= oos_start")
    garch = garch_walk_forward(placed, params, **walk).select("asset", "idx", "garch")
    return (
        simple.join(garch, ["asset", "idx"])
        .select(
            "asset", "idx", "day", (F.col("r") * F.col("r")).alias("proxy"),
            F.col("rolling_forecast").alias("rolling_hist_vol"), F.col("ewma_forecast").alias("ewma"), "garch",
        )
        .dropna(subset=["proxy", *MODELS])
    )


def volatility_metrics(frame: DataFrame) -> DataFrame:
    """(asset, model, n_oos, rmse, qlike), all models in one aggregate."""
    proxy = F.col("proxy")
    wide = frame.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_oos"),
        *[rmse(proxy, F.col(m)).alias(f"_r_{m}") for m in MODELS],
        *[qlike(proxy, F.col(m)).alias(f"_q_{m}") for m in MODELS],
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"_r_{m}").alias("rmse"), F.col(f"_q_{m}").alias("qlike")) for m in MODELS
    ])
    return wide.select("asset", "n_oos", F.inline(rows))


def volatility_series(frame: DataFrame) -> DataFrame:
    return frame.select("asset", "day", var_to_vol(F.col("proxy")).alias("proxy_vol"), *[var_to_vol(F.col(m)).alias(m) for m in MODELS])


def metrics_ranked(metrics: DataFrame) -> DataFrame:
    by = lambda c: F.rank().over(W.partitionBy("asset").orderBy(c))
    return metrics.withColumn("rank_rmse", by("rmse")).withColumn("rank_qlike", by("qlike"))


def var_multiplier(placed: DataFrame, confidences: Sequence[float], params: DataFrame | None = None) -> DataFrame:
    """(asset, confidence, mu, z_q, es_z): tail of the standardised residuals before ``oos_start`` only.

    Parameters come from all rows before ``oos_start``, unlike the 750-row windows of the forecasts.
    """
    before = placed.where("idx < oos_start").select("asset", "idx", "day", "r")
    fitted = params if params is not None else fit_garch(before).select("asset", "omega", "alpha", "beta", "mu")
    z = standardized_residuals(garch_variance_path(before.join(fitted, "asset")))
    levels = F.array(*[F.lit(1 - c) for c in confidences])
    marked = z.withColumn("_q", F.percentile("z", levels).over(W.partitionBy("asset")))
    agg = marked.groupBy("asset", "mu").agg(
        F.first("_q").alias("_q"),
        *[F.avg(F.when(F.col("z") <= F.get("_q", F.lit(i)), F.col("z"))).alias(f"_t{i}") for i in range(len(confidences))],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("confidence"), F.get("_q", F.lit(i)).alias("z_q"),
            F.coalesce(F.col(f"_t{i}"), F.get("_q", F.lit(i))).alias("es_z"),
        )
        for i, c in enumerate(confidences)
    ])
    return agg.select("asset", "mu", F.inline(rows))


def var_backtest_series(
    returns: DataFrame, confidences: Sequence[float], params: DataFrame | None = None, *, strict: bool = True, **walk
) -> DataFrame:
    """Daily VaR and ES forecasts on log returns with the exceedance flag and the chart threshold -VaR."""
    placed = with_oos(returns, strict=strict)
    forecast = garch_walk_forward(placed, params, **walk).join(placed.select("asset", "idx", "r"), ["asset", "idx"])
    sigma = F.sqrt("garch")
    return (
        forecast.join(var_multiplier(placed, confidences, params), "asset")
        .withColumn("sigma", sigma)
        .withColumn("var_loss", -(F.col("mu") + F.col("z_q") * F.col("sigma")))
        .withColumn("es_loss", -(F.col("mu") + F.col("es_z") * F.col("sigma")))
        .withColumn("var_threshold", -F.col("var_loss"))
        .withColumn("exceed", F.col("r") < -F.col("var_loss"))
        .select("asset", "confidence", "idx", "day", "r", F.col("garch").alias("sigma2"), "sigma", "var_loss", "es_loss", "var_threshold", "exceed")
    )


def var_backtest(series: DataFrame) -> DataFrame:
    """Coverage test and ES diagnostic per (asset, confidence)."""
    span = series.groupBy("asset", "confidence").agg(F.min("day").alias("oos_first"), F.max("day").alias("oos_last"))
    tested = kupiec(es_backtest(series, ["asset", "confidence"]))
    return tested.join(span, ["asset", "confidence"])


def tail_pivot(risk: DataFrame, methods: Sequence[str], confidence: float) -> DataFrame:
    """Method by horizon table of ES at one confidence."""
    top = risk.where(F.col("confidence") == confidence)
    return top.groupBy("asset", "horizon_days").pivot("method", list(methods)).agg(F.first("expected_shortfall"))
