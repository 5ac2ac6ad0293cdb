"""Risk measures, backtest statistics and descriptive statistics per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.joins import spread_lookup
from tidemark.functions.selection import quantiles
from tidemark.functions.tails import CHI2_1_AT_5PCT, chi2_sf_1, chi2_sf_2, chi2_sf_even, normal_pdf, normal_quantile
from tidemark.sources.stored import stored

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


def _check_confidence(c: float) -> None:
    if not 0 < c < 1:
        raise ValueError(f"confidence must be in (0, 1), got {c}")


def value_at_risk(df: DataFrame, keys: Sequence[str], x: str, confidences: Sequence[float]) -> DataFrame:
    """max(-quantile(x, 1-c), 0) with linear interpolation, one row per group and confidence."""
    for c in confidences:
        _check_confidence(c)
    _, found = quantiles(df, keys, x, {f"_q{i}": 1 - c for i, c in enumerate(confidences)})
    named = F.array(*[
        F.struct(F.lit(c).alias("confidence"), F.greatest(-F.col(f"_q{i}"), F.lit(0.0)).alias("value_at_risk"))
        for i, c in enumerate(confidences)
    ])
    return found.select(*keys, F.inline(named))


def tail_measures(
    df: DataFrame, keys: Sequence[str], x: str, confidences: Sequence[float], carry: Sequence[str] = ()
) -> DataFrame:
    """VaR, ES and the percentile vector of ``x`` per group.

    The values are written once, so an expensive input (a simulation) is computed once. Order statistics are selected by
    bucket counts and tail means are conditional sums; no task holds a group. ``carry`` columns are constant within a
    group. A group without values has null measures.
    """
    for c in confidences:
        _check_confidence(c)
    keys = list(keys)
    levels = {f"_q{i}": 1 - c for i, c in enumerate(confidences)} | {f"p{p}": p / 100 for p in PERCENTILES}
    values, measured = quantiles(df, keys, x, levels, carry)
    measured = stored(measured, "quantiles")
    bounds = [f"_q{i}" for i in range(len(confidences))]
    beside = spread_lookup(values, measured.select(*keys, *bounds), keys, "_x", how="inner")
    tails = beside.groupBy(*keys).agg(*[
        (F.sum(F.when(F.col("_x") <= F.col(q), F.col("_x"))) / F.nullif(F.count(F.when(F.col("_x") <= F.col(q), 1)), F.lit(0))).alias(f"{q}_mean")
        for q in bounds
    ])
    per_confidence = F.array(*[
        F.struct(
            F.lit(c).alias("confidence"),
            F.greatest(-F.col(q), F.lit(0.0)).alias("value_at_risk"),
            F.greatest(-F.coalesce(f"{q}_mean", q), F.lit(0.0)).alias("expected_shortfall"),
        )
        for c, q in zip(confidences, bounds)
    ])
    joined = measured.join(tails, keys, "left")
    return joined.select(*keys, "n_scenarios", *carry, *[f"p{p}" for p in PERCENTILES], F.inline(per_confidence))


def expected_shortfall(df: DataFrame, keys: Sequence[str], x: str, confidences: Sequence[float]) -> DataFrame:
    """max(-mean(x | x <= q), 0); the mean falls back to q when the tail is empty."""
    return tail_measures(df, keys, x, confidences).select(*keys, "confidence", "expected_shortfall")


def return_percentiles(df: DataFrame, keys: Sequence[str], x: str, percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    _, found = quantiles(df, keys, x, {f"_p{p}": p / 100 for p in percentiles})
    named = F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"_p{p}").alias("value")) for p in percentiles])
    return found.select(*keys, F.inline(named))


def rmse(proxy: Column, forecast: Column) -> Column:
    error = proxy - forecast
    return F.sqrt(F.avg(error * error))


def qlike(proxy: Column, forecast: Column) -> Column:
    bad = F.raise_error(F.lit("qlike requires strictly positive forecasts")).cast("double")
    return F.avg(F.when(forecast <= 0, bad).otherwise(F.ln(forecast) + proxy / forecast))


def kupiec(counts: DataFrame, n: str = "n_obs", x: str = "n_exceedances", confidence: str = "confidence") -> DataFrame:
    """Proportion-of-failures test for rows holding counts; adds rates, LR statistic, p-value and rejection at 5 %."""
    n_obs, n_bad, p = F.col(n).cast("double"), F.col(x).cast("double"), F.lit(1.0) - F.col(confidence)
    observed = n_bad / n_obs

    def log_likelihood(rate: Column) -> Column:
        # A term with zero weight drops out, which covers no exceedances and only exceedances.
        good = F.when(n_bad == n_obs, F.lit(0.0)).otherwise((n_obs - n_bad) * F.ln(1.0 - rate))
        bad = F.when(n_bad == 0, F.lit(0.0)).otherwise(n_bad * F.ln(rate))
        return good + bad

    statistic = F.greatest(F.lit(-2.0) * (log_likelihood(p) - log_likelihood(observed)), F.lit(0.0))
    return (
        counts.withColumn("exceedance_rate", observed)
        .withColumn("expected_rate", p)
        .withColumn("lr_statistic", statistic)
        .withColumn("p_value", chi2_sf_1(F.col("lr_statistic")))
        .withColumn("reject_at_5pct", F.col("lr_statistic") > CHI2_1_AT_5PCT)
    )


def es_backtest(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Realised against predicted loss on exceedance days, from rows (keys, r, es_loss, exceed)."""
    hit = F.col("exceed")
    agg = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(hit.cast("bigint")).alias("n_exceedances"),
        (-F.avg(F.when(hit, F.col("r")))).alias("realized_es"),
        F.avg(F.when(hit, F.col("es_loss"))).alias("_hit_es"),
        F.avg("es_loss").alias("_all_es"),
    )
    predicted = F.coalesce("_hit_es", "_all_es")
    return agg.withColumn("predicted_es", predicted).withColumn(
        "es_ratio", F.when(F.col("predicted_es") != 0, F.col("realized_es") / F.col("predicted_es"))
    ).drop("_hit_es", "_all_es")


def series_summary(returns: DataFrame) -> DataFrame:
    mean, std = F.avg("r"), F.stddev_samp("r")
    return returns.groupBy("asset").agg(
        F.count("r").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        mean.alias("mean"), std.alias("std"),
        (mean * 365).alias("annual_drift"), (std * math.sqrt(365)).alias("annual_vol"),
    )


def sample_moments(returns: DataFrame) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis (Spark's own are the population ones)."""
    agg = returns.groupBy("asset").agg(
        F.count("r").cast("double").alias("_n"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2")
    )
    n = F.col("_n")
    return agg.select(
        "asset",
        (F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )


def jarque_bera(returns: DataFrame) -> DataFrame:
    agg = returns.groupBy("asset").agg(F.count("r").alias("_n"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    statistic = F.col("_n") / 6.0 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4.0)
    return agg.select("asset", statistic.alias("jb"), chi2_sf_2(statistic).alias("p_value"))


def acf(df: DataFrame, x: str, lags: int = 40) -> DataFrame:
    """Biased autocorrelations at 1..lags per asset: one window pass and one aggregate, no self-join."""
    whole, by_idx = W.partitionBy("asset"), W.partitionBy("asset").orderBy("idx")
    centred = df.select("asset", "idx", (F.col(x) - F.avg(x).over(whole)).alias("_c"))
    paired = centred.select("asset", "_c", *[F.lead("_c", k).over(by_idx).alias(f"_c{k}") for k in range(1, lags + 1)])
    sums = paired.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_c") * F.col("_c")).alias("_s0"),
        *[F.coalesce(F.sum(F.col("_c") * F.col(f"_c{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)],
    )
    named = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_s{k}") / F.col("_s0")).alias("acf")) for k in range(1, lags + 1)])
    return sums.select("asset", "n", F.inline(named))


def ljung_box(df: DataFrame, x: str, lags: Sequence[int] = (10, 20)) -> DataFrame:
    rho = acf(df, x, max(lags))
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    sums = rho.groupBy("asset", "n").agg(*[F.sum(F.when(F.col("lag") <= m, term)).alias(f"_q{m}") for m in lags])
    statistic = lambda m: F.col("n") * (F.col("n") + 2) * F.col(f"_q{m}")
    named = F.array(*[
        F.struct(F.lit(m).alias("lags"), statistic(m).alias("statistic"), chi2_sf_even(statistic(m), m).alias("p_value"))
        for m in lags
    ])
    return sums.select("asset", F.inline(named))


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Equal-width density histogram per asset, every bin included, with the fitted normal density at each bin centre.

    A constant series gets a range of 1 around its value; its normal density is null, as its deviation is zero.
    """
    known = df.where(F.col(x).isNotNull())
    low, high = F.min(x), F.max(x)
    flat = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    shape = known.groupBy("asset").agg(
        (low - flat).alias("lo"), ((high + flat - (low - flat)) / float(bins)).alias("width"),
        F.avg(x).alias("_mean"), F.nullif(F.stddev_samp(x), F.lit(0.0)).alias("_std"), F.count(F.lit(1)).alias("n"),
    )
    position = F.least(F.floor((F.col(x) - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counted = known.join(shape, "asset").groupBy("asset", position.alias("bin")).agg(F.count(F.lit(1)).alias("_rows"))
    every = shape.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = F.coalesce("_rows", F.lit(0))
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    return every.join(counted, ["asset", "bin"], "left").select(
        "asset", "bin", rows.alias("rows"),
        (rows / (F.col("n") * F.col("width"))).alias("density"),
        normal_pdf(centre, F.col("_mean"), F.col("_std")).alias("normal_density"),
    )


def qq_normal(df: DataFrame, x: str) -> DataFrame:
    """Ordered values against normal quantiles of Filliben's order-statistic medians."""
    n = F.count(F.lit(1)).over(W.partitionBy("asset")).cast("double")
    ranked = df.select(
        "asset", F.col(x).alias("sample"), n.alias("_n"),
        F.row_number().over(W.partitionBy("asset").orderBy(x, "idx")).alias("position"),
    )
    ends = F.pow(F.lit(0.5), 1.0 / F.col("_n"))
    median = (
        F.when(F.col("position") == F.col("_n"), ends)
        .when(F.col("position") == 1, 1.0 - ends)
        .otherwise((F.col("position") - 0.3175) / (F.col("_n") + 0.365))
    )
    return ranked.select("asset", "position", normal_quantile(median).alias("theoretical"), "sample")
