"""Risk results, stress losses, collateral and quotes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.joins import spread_lookup
from tidemark.functions.scalars import to_fixed_point
from tidemark.operators import scenarios as S
from tidemark.operators.prices import simple_return, var_to_vol
from tidemark.operators.series import historical_worst_case
from tidemark.operators.stats import tail_measures

VOL_SHOCKS = (2.0, 3.0)
GAP_DOWNS = (0.30, 0.50)
LONGER_HORIZON = 2.0
LOSS = "decimal(14,12)"
NOTIONAL = "decimal(20,8)"
QUOTE_VALIDITY = "INTERVAL 5 MINUTE"


def losses_by_method(
    returns: DataFrame, model: DataFrame, horizons: Sequence[int], methods: Sequence[str], n_scenarios: int, seed: int
) -> DataFrame:
    """(asset, horizon_days, method, x): simple horizon returns of the asked methods."""
    makers = {
        S.HISTORICAL: lambda: S.scenarios_historical(returns, horizons),
        S.FILTERED_HISTORICAL: lambda: S.scenarios_fhs(model, horizons, n_scenarios, seed),
        S.GBM: lambda: S.scenarios_gbm(model, horizons, n_scenarios, seed),
    }
    parts = [
        makers[m]().select("asset", "horizon_days", F.lit(m).alias("method"), simple_return(F.col("log_return")).alias("x"))
        for m in methods
    ]
    return reduce(DataFrame.unionByName, parts)


def risk_results(
    returns: DataFrame, model: DataFrame, horizons: Sequence[int], confidences: Sequence[float], *,
    methods: Sequence[str] = (S.HISTORICAL, S.FILTERED_HISTORICAL, S.GBM),
    n_scenarios: int = S.DEFAULT_SCENARIOS, seed: int = S.DEFAULT_SEED,
) -> DataFrame:
    """One row per asset, horizon, method and confidence, with the percentile vector.

    The forecast volatility is the latest filtered one, not a one-step forecast.
    """
    losses = losses_by_method(returns, model, horizons, methods, n_scenarios, seed)
    measured = tail_measures(losses, ["asset", "horizon_days", "method"], "x", confidences)
    vol = model.select("asset", var_to_vol(F.col("latest_variance")).alias("forecast_volatility_annualized"))
    return measured.join(vol, "asset")


def extended_horizons(horizons: Sequence[int], multiplier: float = LONGER_HORIZON) -> dict[int, int]:
    """The delayed-settlement horizon of each horizon: at least one day longer."""
    return {h: max(h + 1, round(h * multiplier)) for h in horizons}


def stress_vol_shock(
    model: DataFrame, horizons: Sequence[int], confidence: float, multipliers: Sequence[float] = VOL_SHOCKS,
    n_scenarios: int = S.DEFAULT_SCENARIOS, seed: int = S.DEFAULT_SEED,
) -> DataFrame:
    """Expected Shortfall of a driftless GBM at a multiple of the current volatility."""
    draws = S.normal_draws(model, n_scenarios, seed, "stress")
    grid = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.lit(float(m)).alias("multiplier"), F.lit(1 + i).alias("ord"))
        for h in horizons for i, m in enumerate(multipliers)
    ])
    spread = draws.select("asset", "latest_variance", "z", F.inline(grid))
    shocked = F.sqrt(F.col("latest_variance") * 365) * F.col("multiplier")
    moves = spread.withColumn("x", simple_return(S.gbm_log_return(F.lit(0.0), shocked, F.col("horizon_days"), F.col("z"))))
    tails = tail_measures(moves, ["asset", "horizon_days", "multiplier", "ord"], "x", [confidence])
    return tails.select(
        "asset", "horizon_days", "ord", F.concat(F.lit("vol_shock_"), _short(F.col("multiplier")), F.lit("x")).alias("name"),
        F.col("expected_shortfall").alias("loss_fraction"),
    )


def _short(number: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def stress_gap_down(model: DataFrame, horizons: Sequence[int], shocks: Sequence[float] = GAP_DOWNS, first_ord: int = 3) -> DataFrame:
    for s in shocks:
        if not 0 < s < 1:
            raise ValueError(f"shock_fraction must be in (0, 1), got {s}")
    grid = F.array(*[
        F.struct(
            F.lit(h).alias("horizon_days"), F.lit(first_ord + i).alias("ord"), F.lit(f"gap_down_shock_{s:.0%}").alias("name"),
            F.lit(float(s)).alias("loss_fraction"),
        )
        for h in horizons for i, s in enumerate(shocks)
    ])
    return model.select("asset", F.inline(grid))


def stress_extended_horizon(fhs_tails: DataFrame, horizons: Sequence[int], ord_: int = 5) -> DataFrame:
    """Filtered-historical ES at the delayed horizon, read off ``fhs_tails`` (asset, horizon_days, expected_shortfall)."""
    longer = extended_horizons(horizons)
    wanted = F.array(*[F.struct(F.lit(h).alias("base"), F.lit(e).alias("longer")) for h, e in longer.items()])
    matched = fhs_tails.select(
        "asset", F.col("horizon_days").alias("_h"), F.col("expected_shortfall").alias("loss_fraction"), F.inline(wanted)
    ).where(F.col("_h") == F.col("longer"))
    return matched.select(
        "asset", F.col("base").alias("horizon_days"), F.lit(ord_).alias("ord"),
        F.concat(F.lit("extended_horizon_"), F.col("longer").cast("string"), F.lit("d")).alias("name"), "loss_fraction",
    )


def stress_summary(
    returns: DataFrame, model: DataFrame, fhs_tails: DataFrame, horizons: Sequence[int], confidence: float = 0.99,
    n_scenarios: int = S.DEFAULT_SCENARIOS, seed: int = S.DEFAULT_SEED,
) -> DataFrame:
    """All stress scenarios per (asset, horizon): ord, name, loss_fraction."""
    worst = historical_worst_case(returns, horizons).select(
        "asset", "horizon_days", F.lit(0).alias("ord"),
        F.concat(F.lit("historical_worst_case_"), F.col("horizon_days").cast("string"), F.lit("d")).alias("name"), "loss_fraction",
    )
    parts = [
        worst,
        stress_vol_shock(model, horizons, confidence, VOL_SHOCKS, n_scenarios, seed),
        stress_gap_down(model, horizons),
        stress_extended_horizon(fhs_tails, horizons),
    ]
    return reduce(DataFrame.unionByName, parts)


def worst_stress(summary: DataFrame) -> DataFrame:
    """The largest loss per (asset, horizon), the first listed on ties."""
    best = summary.groupBy("asset", "horizon_days").agg(
        F.max_by(F.struct("name", "loss_fraction"), F.struct("loss_fraction", (-F.col("ord")).alias("o"))).alias("_w")
    )
    return best.select(
        "asset", "horizon_days", F.col("_w.name").alias("worst_stress_scenario"), F.col("_w.loss_fraction").alias("stress_loss")
    )


@dataclass(frozen=True)
class CollateralPolicy:
    """Multipliers and the clamp of the collateral ratio, as decimal texts."""

    es_buffer_multiplier: str = "1.00"
    stress_buffer_multiplier: str = "1.00"
    min_collateral_ratio: str = "1.00"
    max_collateral_ratio: str = "5.00"


def loss_decimal(x: Column) -> Column:
    """A loss fraction as DECIMAL(14,12), rounded up: rounding may never lower the collateral."""
    return F.ceil(x.cast("decimal(30,15)"), 12).cast(LOSS)


def collateral_decision(df: DataFrame, policy: CollateralPolicy = CollateralPolicy()) -> DataFrame:
    """Adds the decision to rows with ``notional``, ``es_loss`` and ``stress_loss``.

    notional * (1 + larger weighted loss), clamped, rounded up at 18 places. DECIMAL(20,8) times DECIMAL(15,12)
    is DECIMAL(36,20), so nothing is lost before that rounding.
    """
    number = lambda text: F.lit(text).cast("decimal(4,2)")
    notional = F.when(
        F.col("notional") <= 0, F.raise_error(F.concat(F.lit("notional must be positive, got "), F.col("notional").cast("string"))).cast(NOTIONAL)
    ).otherwise(F.col("notional").cast(NOTIONAL))
    weighted_es = F.ceil(F.col("es_loss").cast(LOSS) * number(policy.es_buffer_multiplier), 12).cast(LOSS)
    weighted_stress = F.ceil(F.col("stress_loss").cast(LOSS) * number(policy.stress_buffer_multiplier), 12).cast(LOSS)
    # decimal(14,12) keeps one digit before the point free for multipliers; the sum with 1 needs decimal(15,12).
    ratio = (F.lit(1).cast("decimal(1,0)") + F.col("loss_basis")).cast("decimal(15,12)")
    low, high = number(policy.min_collateral_ratio), number(policy.max_collateral_ratio)
    clamped = F.least(F.greatest(F.col("_ratio"), low.cast("decimal(15,12)")), high.cast("decimal(15,12)"))
    return (
        df.withColumn("notional", notional)
        .withColumn("_es", weighted_es)
        .withColumn("_stress", weighted_stress)
        .withColumn("loss_basis", F.greatest("_es", "_stress"))
        .withColumn("loss_basis_source", F.when(F.col("_es") >= F.col("_stress"), "expected_shortfall").otherwise("stress"))
        .withColumn("_ratio", ratio)
        .withColumn("floored", F.col("_ratio") < low)
        .withColumn("capped", F.col("_ratio") > high)
        .withColumn("collateral_ratio", clamped)
        .withColumn("required_collateral", F.ceil(F.col("notional") * F.col("collateral_ratio"), 18).cast("decimal(38,18)"))
        .withColumn("collateral_buffer", (F.col("required_collateral") - F.col("notional")).cast("decimal(38,18)"))
        .drop("_es", "_stress", "_ratio")
    )


def risk_snapshot(
    returns: DataFrame, model: DataFrame, horizons: Sequence[int], confidence: float = 0.99, *,
    policy: CollateralPolicy = CollateralPolicy(), n_scenarios: int = S.DEFAULT_SCENARIOS, seed: int = S.DEFAULT_SEED,
) -> DataFrame:
    """VaR, ES, stress and collateral per unit for every asset and horizon.

    The base horizons and the delayed ones come from one simulation.
    """
    stops = sorted(set(horizons) | set(extended_horizons(horizons).values()))
    fhs = losses_by_method(returns, model, stops, [S.FILTERED_HISTORICAL], n_scenarios, seed)
    tails = tail_measures(fhs, ["asset", "horizon_days"], "x", [confidence])
    worst = worst_stress(stress_summary(returns, model, tails, horizons, confidence, n_scenarios, seed))
    vol = model.select("asset", var_to_vol(F.col("latest_variance")).alias("forecast_volatility_annualized"))
    base = tails.where(F.col("horizon_days").isin(list(horizons))).select("asset", "horizon_days", "value_at_risk", "expected_shortfall")
    joined = base.join(worst, ["asset", "horizon_days"]).join(vol, "asset")
    priced = joined.select(
        "*", F.lit(1).cast(NOTIONAL).alias("notional"), loss_decimal(F.col("expected_shortfall")).alias("es_loss"),
    ).withColumn("stress_loss", loss_decimal(F.col("stress_loss")))
    return collateral_decision(priced, policy).withColumn("confidence", F.lit(confidence)).drop("notional", "collateral_buffer", "floored", "capped").withColumnRenamed(
        "required_collateral", "required_collateral_per_unit"
    )


def exposure_usd(df: DataFrame) -> DataFrame:
    """Adds notional times spot."""
    return df.withColumn("exposure_usd", (F.col("notional").cast(NOTIONAL) * F.col("spot_price_usd").cast("decimal(16,6)")).cast("decimal(38,14)"))


def spot_prices(prices: DataFrame) -> DataFrame:
    return prices.groupBy("asset").agg(F.max_by("close", "day").cast("decimal(16,6)").alias("spot_price_usd"))


def price_quotes(requests: DataFrame, snapshot: DataFrame, spots: DataFrame, policy: CollateralPolicy = CollateralPolicy()) -> DataFrame:
    """Request rows (request_id, asset, notional, horizon_days, created_at) to priced quotes.

    There are only a few (asset, horizon) keys for any number of requests, so the lookup is spread over copies.
    """
    terms = snapshot.select(
        "asset", "horizon_days", "confidence", "value_at_risk", "expected_shortfall", "es_loss", "stress_loss",
        "forecast_volatility_annualized",
    ).join(spots, "asset")
    matched = spread_lookup(requests, terms, ["asset", "horizon_days"], "request_id", how="inner")
    decided = collateral_decision(matched, policy)
    created = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    identity = F.concat_ws("|", "asset", F.col("horizon_days").cast("string"), created, F.col("request_id").cast("string"))
    return decided.select(
        F.concat(F.lit("0x"), F.sha2(identity, 256)).alias("quote_id"),
        "request_id", "asset", "notional", "horizon_days",
        (F.col("horizon_days") * 86400).alias("settlement_horizon_seconds"),
        "spot_price_usd", "confidence", "forecast_volatility_annualized", "value_at_risk", "expected_shortfall", "es_loss", "stress_loss",
        "loss_basis_source", "collateral_ratio", "collateral_buffer", "required_collateral",
        F.col("created_at").alias("quote_created_at"),
        (F.col("created_at") + F.expr(QUOTE_VALIDITY)).alias("quote_expiration"),
    )


def unpriced_requests(requests: DataFrame, snapshot: DataFrame, spots: DataFrame) -> DataFrame:
    """The requests that ``price_quotes`` cannot price, with ``reason``: the asset has no spot price, or no terms for the horizon."""
    terms = snapshot.select("asset", "horizon_days").distinct().withColumn("_terms", F.lit(True))
    priced = spots.select("asset").distinct().withColumn("_spot", F.lit(True))
    asked = spread_lookup(spread_lookup(requests, terms, ["asset", "horizon_days"], "request_id"), priced, ["asset"], "request_id")
    reason = F.when(F.col("_spot").isNull(), "no spot price").when(F.col("_terms").isNull(), "no terms for the horizon")
    return asked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*requests.columns, "reason")


def to_onchain_fields(quotes: DataFrame, decimals: int = 18) -> DataFrame:
    """Integer fields of a quote: notional half-up, collateral rounded up, expiry in epoch seconds."""
    return quotes.select(
        "quote_id",
        to_fixed_point(F.col("notional"), decimals).alias("notional_units"),
        to_fixed_point(F.col("required_collateral"), decimals, "ceil").alias("required_collateral_units"),
        F.col("quote_expiration").cast("timestamp").cast("bigint").alias("quote_expiration"),
        F.col("settlement_horizon_seconds").alias("settlement_horizon"),
    )


def _canonical(value: Column, kind: T.DataType, path: str) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError(f"raw float in a canonical snapshot at {path}; use a decimal")
    if isinstance(kind, T.DecimalType):
        return to_fixed_point(value).cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp").cast("bigint")
    if isinstance(kind, T.StructType):
        return F.struct(*[
            _canonical(value[f.name], f.dataType, f"{path}.{f.name}").alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)
        ])
    if isinstance(kind, T.MapType):
        sorted_entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(
            sorted_entries, lambda e: F.struct(e["key"].alias("key"), _canonical(e["value"], kind.valueType, path).alias("value"))
        ))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda e: _canonical(e, kind.elementType, path))
    return value


def snapshot_hash(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``snapshot_json`` (sorted keys, decimals as 18-place integers, times as epoch seconds) and its sha-256.

    A float among the fields is refused when the plan is built.
    """
    parts = [_canonical(F.col(name), df.schema[name].dataType, name).alias(name) for name in sorted(fields)]
    text = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return df.withColumn("snapshot_json", text).withColumn("snapshot_hash", F.concat(F.lit("0x"), F.sha2("snapshot_json", 256)))
