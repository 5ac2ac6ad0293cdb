"""Queries on prices and returns: sources, filters, quality, series, statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.literal import literal_table
from tidemark.operators import prices as P, quality as Q, series as S, stats as A
from tidemark.plans.common import Query, query, returns_of
from tidemark.sources import fixtures as X

CONFIDENCES = (0.95, 0.99)
AS_OF = dt.date(2000, 6, 30)


def raw_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as one raw candle in epoch seconds, so most (asset, time) pairs repeat."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return X.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("asset"),
        F.unix_timestamp("l_shipdate").alias("time"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        px.alias("open"), (px * 2).alias("high"), (px / 2).alias("low"), px.alias("close"), F.col("l_quantity").alias("volume"),
    )


def candles_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.normalize_candles(raw_candles(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def prices_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = X.prices(spark, sf_dir).drop("ingest_seq")
    return P.in_range(stored, "A", dt.date(1998, 1, 1), dt.date(1999, 12, 31))


def range_requests(spark: SparkSession) -> DataFrame:
    day = dt.date
    return literal_table(
        spark,
        [
            ("A", day(1990, 1, 1), day(2010, 1, 1), False),
            ("N", day(1999, 1, 1), day(2000, 1, 1), False),
            ("R", day(1996, 1, 1), day(2003, 1, 1), True),
            ("X", day(1996, 1, 1), day(2003, 1, 1), False),
        ],
        "asset string, start_day date, end_day date, refresh boolean",
    )


def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.plan_missing_ranges(X.prices(spark, sf_dir), range_requests(spark))


def prices_upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third day is delivered again, restated by 1 %."""
    old = X.prices(spark, sf_dir)
    restated = old.where(F.col("ingest_seq") % 3 == 0).withColumn("close", F.col("close") * 1.01)
    return P.upsert_prices(old, restated.withColumn("ingest_seq", F.col("ingest_seq") + 100000))


def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns_of(spark, sf_dir)


def returns_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice is taken on prices, in front of the window, so that it reaches the scan."""
    return P.log_returns(P.as_of(X.prices(spark, sf_dir).drop("ingest_seq"), AS_OF))


def returns_tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tail_n(returns_of(spark, sf_dir), 250)


def oos_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = P.with_oos(returns_of(spark, sf_dir))
    out = F.col("idx") >= F.col("oos_start")
    return placed.groupBy("asset", "n", "oos_start").agg(
        F.sum(out.cast("bigint")).alias("n_oos"),
        F.min(F.when(out, F.col("day"))).alias("oos_first"),
        F.max(F.when(~out, F.col("day"))).alias("train_last"),
    )


def dq_requested(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [("A",), ("N",), ("R",), ("X",)], "asset string")


def dq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_counts(X.prices_dirty(spark, sf_dir), dq_requested(spark)).drop("first_day", "last_day")


def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.calendar_gaps(X.prices_dirty(spark, sf_dir))


def extreme_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = X.prices_dirty(spark, sf_dir)
    moves = Q.extreme_moves(dirty, Q.quality_counts(dirty), 0.25)
    return moves.select("asset", "n_extreme", F.array_join(F.transform("first_days", lambda d: d.cast("string")), ",").alias("first_days"))


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = Q.data_quality(X.prices_dirty(spark, sf_dir), dq_requested(spark), 0.25)
    return report.select("asset", "n_rows", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid")


def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = S.rolling_volatility_column(30, annualize=False, min_periods=5).alias("rolling_vol_min5")
    return S.rolling_volatility(returns_of(spark, sf_dir)).select("asset", "day", "rolling_vol", early)


def realized_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.realized_variance(returns_of(spark, sf_dir), 30).select("asset", "day", "realized_variance")


def rolling_variance_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling_variance_forecast(returns_of(spark, sf_dir)).select("asset", "day", "rolling_forecast")


def ewma_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ewma_variance(returns_of(spark, sf_dir)).select("asset", "day", "ewma_variance")


def ewma_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ewma_volatility(returns_of(spark, sf_dir)).select("asset", "day", "ewma_vol")


def ewma_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast = S.ewma_variance_forecast(P.with_oos(returns_of(spark, sf_dir)))
    return forecast.where("idx >= oos_start").select("asset", "day", "ewma_forecast")


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.garch_variance_path(returns_of(spark, sf_dir).join(X.garch_params(spark), "asset"))


def garch_variance_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir).select("asset", "day", "sigma2", "eps2")


def standardized_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.standardized_residuals(_path(spark, sf_dir)).select("asset", "day", "z")


def historical_horizon_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.historical_horizon_returns(returns_of(spark, sf_dir), X.HORIZONS).drop("idx")


def historical_worst_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.historical_worst_case(returns_of(spark, sf_dir), X.HORIZONS)


def vol_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vol_history(returns_of(spark, sf_dir), X.garch_params(spark))


def horizon_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = S.historical_horizon_returns(returns_of(spark, sf_dir), X.HORIZONS)
    return moves.select("asset", "horizon_days", F.expm1("log_return").alias("x"))


def value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_at_risk(horizon_losses(spark, sf_dir), ["asset", "horizon_days"], "x", CONFIDENCES)


def expected_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.expected_shortfall(horizon_losses(spark, sf_dir), ["asset", "horizon_days"], "x", CONFIDENCES)


def tail_risk_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = A.tail_measures(horizon_losses(spark, sf_dir), ["asset", "horizon_days"], "x", CONFIDENCES)
    return measured.select("asset", "horizon_days", "confidence", "n_scenarios", "value_at_risk", "expected_shortfall")


def return_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.return_percentiles(horizon_losses(spark, sf_dir), ["asset", "horizon_days"], "x")


def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.series_summary(returns_of(spark, sf_dir))


def sample_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sample_moments(returns_of(spark, sf_dir))


def jarque_bera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.jarque_bera(returns_of(spark, sf_dir))


def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = returns_of(spark, sf_dir)
    squared = A.acf(returns.withColumn("r2", F.col("r") * F.col("r")), "r2").withColumnRenamed("acf", "acf_squared")
    return A.acf(returns, "r").join(squared, ["asset", "n", "lag"])


def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = S.standardized_residuals(_path(spark, sf_dir))
    return A.ljung_box(z.withColumn("z2", F.col("z") * F.col("z")), "z2")


def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(returns_of(spark, sf_dir), "r", 120)


def qq_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.qq_normal(returns_of(spark, sf_dir), "r")


QUERIES: dict[str, Query] = {
    fn.__name__: query(fn)
    for fn in (
        candles_normalize, prices_range_scan, missing_ranges, prices_upsert_keep_last, log_returns, returns_as_of,
        returns_tail_n, oos_split, dq_counts, calendar_gaps, extreme_moves, dq_report, rolling_volatility,
        realized_variance, rolling_variance_forecast, ewma_variance, ewma_volatility, ewma_forecast,
        garch_variance_path, standardized_residuals, historical_horizon_returns, historical_worst_case, vol_history,
        value_at_risk, expected_shortfall, tail_risk_historical, return_percentiles, series_summary, sample_moments,
        jarque_bera, acf, ljung_box, return_histogram, qq_normal,
    )
}
