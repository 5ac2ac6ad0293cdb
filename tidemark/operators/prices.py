"""Price tables: normalising, range reads, gap planning, upserts, returns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PERIODS_PER_YEAR = 365
OHLCV = ("open", "high", "low", "close", "volume")


def normalize_candles(raw: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Raw candles (asset, time in epoch seconds, OHLCV) to daily rows; the first arrival of a repeated time is kept.

    An aggregate, not a ranking: copies of one time collapse on the map side.
    """
    first = F.min(F.struct(*arrival, *OHLCV))
    kept = raw.groupBy("asset", "time").agg(first.alias("_first"))
    return kept.select(
        "asset",
        F.to_date(F.timestamp_seconds("time")).alias("day"),
        *[F.col("_first")[c].cast("double").alias(c) for c in OHLCV],
    )


def in_range(prices: DataFrame, asset: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of one asset with start <= day <= end. The filters reach the scan."""
    return prices.where((F.col("asset") == asset) & F.col("day").between(F.lit(start), F.lit(end)))


def plan_missing_ranges(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """Which date ranges of ``requests`` (asset, start_day, end_day, refresh) the price table does not hold yet.

    A head gap up to the first stored day, a tail gap from the day after the last one; everything when nothing is
    stored or a refresh is forced.
    """
    held = prices.groupBy("asset").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    joined = requests.join(held, "asset", "left")
    whole = F.col("first_day").isNull() | F.col("refresh")
    gap = lambda kind, start, end: F.struct(F.lit(kind).alias("gap"), start.alias("from_day"), end.alias("to_day"))
    start, end = F.col("start_day"), F.col("end_day")
    day_after = F.date_add("last_day", 1)
    gaps = F.filter(
        F.array(
            F.when(whole, gap("whole", start, end)),
            F.when(~whole & (start < F.col("first_day")), gap("head", start, F.col("first_day"))),
            F.when(~whole & (end > day_after), gap("tail", day_after, end)),
        ),
        lambda g: g.isNotNull() & (g["from_day"] < g["to_day"]),
    )
    return joined.select("asset", F.inline(gaps))


def upsert_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both; a repeated (asset, day) keeps the row of ``new``; within one side the highest ``ingest_seq`` wins."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c not in ("asset", "day", "ingest_seq")]
    last = both.groupBy("asset", "day").agg(F.max(F.struct("_side", "ingest_seq", *rest)).alias("_last"))
    return last.select("asset", "day", *[F.col("_last")[c].alias(c) for c in rest], F.col("_last.ingest_seq").alias("ingest_seq"))


def log_returns(prices: DataFrame, price_col: str = "close") -> DataFrame:
    """(asset, day, idx, r): ln of successive price ratios, numbered from 0.

    Days without a price (null or NaN) are left out before anything is counted. A price <= 0 is an error.
    """
    by_day = W.partitionBy("asset").orderBy("day")
    price = F.col(price_col)
    safe = F.when(price <= 0, F.raise_error(F.lit("log_returns requires strictly positive prices"))).otherwise(F.ln(price))
    known = prices.where(price.isNotNull() & ~F.isnan(price.cast("double")))
    logged = known.select("asset", "day", safe.alias("_ln"))
    stepped = logged.select(
        "asset", "day",
        (F.col("_ln") - F.lag("_ln").over(by_day)).alias("r"),
        (F.row_number().over(by_day) - 2).cast("bigint").alias("idx"),
    )
    return stepped.where(F.col("r").isNotNull()).select("asset", "day", "idx", "r")


def as_of(df: DataFrame, date: dt.date) -> DataFrame:
    """Only what was known on ``date``; apply it before anything is fitted."""
    return df.where(F.col("day") <= F.lit(date))


def tail_n(returns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of every asset, re-indexed from 0 (the old index stays as ``full_idx``)."""
    last = W.partitionBy("asset").orderBy(F.desc("idx"))
    ranked = returns.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= n)
    length = F.count(F.lit(1)).over(W.partitionBy("asset"))
    return (
        ranked.withColumn("full_idx", F.col("idx"))
        .withColumn("idx", (length - F.col("_rank")).cast("bigint"))
        .drop("_rank")
    )


def oos_start(returns: DataFrame, oos_fraction: float = 0.3, fitting_window: int = 750, realized_window: int = 30) -> DataFrame:
    """(asset, n, oos_start, splittable): where the out-of-sample part begins."""
    n = F.col("n")
    cut = F.floor(n * F.lit(1 - oos_fraction)).cast("bigint")
    return (
        returns.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("oos_start", F.greatest(cut, F.lit(fitting_window), F.lit(realized_window)).cast("bigint"))
        .withColumn("splittable", F.col("oos_start") < n - 20)
    )


def with_oos(
    returns: DataFrame, oos_fraction: float = 0.3, fitting_window: int = 750, realized_window: int = 30, *, strict: bool = True
) -> DataFrame:
    """``returns`` plus ``n`` and ``oos_start``, on the partitioning the series already has (no join).

    ``strict`` raises when an asset has fewer than 21 out-of-sample rows; otherwise such assets are left out.
    """
    counted = returns.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("asset")))
    cut = F.floor(F.col("n") * F.lit(1 - oos_fraction)).cast("bigint")
    placed = counted.withColumn("oos_start", F.greatest(cut, F.lit(fitting_window), F.lit(realized_window)).cast("bigint"))
    enough = F.col("oos_start") < F.col("n") - 20
    if not strict:
        return placed.where(enough)
    return placed.withColumn(
        "oos_start",
        F.when(enough, F.col("oos_start")).otherwise(
            F.raise_error(F.concat(F.lit("not enough data for an out-of-sample period: "), F.col("asset"))).cast("bigint")
        ),
    )


def simple_return(log_return: Column) -> Column:
    return F.expm1(log_return)


def annualize_vol(vol: Column) -> Column:
    return vol * F.sqrt(F.lit(float(PERIODS_PER_YEAR)))


def var_to_vol(variance: Column) -> Column:
    return F.sqrt(F.greatest(variance, F.lit(0.0)) * PERIODS_PER_YEAR)
