"""Data-quality checks on price tables; errors block an asset, warnings do not.

Rows are first reduced to (asset, day), so an asset holding a large share of all rows is spread over its days
and copies collapse on the map side. Arrival order is checked in slices of the arrival sequence that are
stitched together at their edges, so no asset is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.prices import OHLCV

MAX_ABS_LOG_RETURN = 0.5
ARRIVAL_SLICE = 1 << 16
REQUIRED_COLUMNS = OHLCV


def missing_columns(prices: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in prices.columns]


def arrival_inversions(prices: DataFrame) -> DataFrame:
    """(asset, n_inversions): rows whose day is before the day of the row that arrived just before."""
    sliced = prices.select("asset", "day", "ingest_seq", F.floor(F.col("ingest_seq") / ARRIVAL_SLICE).alias("_slice"))
    arrival = W.partitionBy("asset", "_slice").orderBy("ingest_seq")
    steps = sliced.withColumn("_back", (F.col("day") < F.lag("day").over(arrival)).cast("bigint"))
    edges = steps.groupBy("asset", "_slice").agg(
        F.coalesce(F.sum("_back"), F.lit(0)).alias("_inside"),
        F.min_by("day", "ingest_seq").alias("_first"),
        F.max_by("day", "ingest_seq").alias("_last"),
    )
    across = (F.col("_first") < F.lag("_last").over(W.partitionBy("asset").orderBy("_slice"))).cast("bigint")
    return (
        edges.withColumn("_across", F.coalesce(across, F.lit(0)))
        .groupBy("asset").agg(F.sum(F.col("_inside") + F.col("_across")).alias("n_inversions"))
    )


def quality_counts(prices: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per asset with every check as a number; ``requested`` adds assets that have no rows at all."""
    absent = missing_columns(prices)
    if absent:
        raise ValueError(f"missing columns: {absent}")
    null = {c: (F.col(c).isNull() | F.isnan(c)).cast("bigint") for c in OHLCV}
    low_price = F.least(*[F.when(F.isnan(c), None).otherwise(F.col(c)) for c in OHLCV[:4]])
    per_day = prices.groupBy("asset", "day").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(null[c]).alias(f"null_{c}") for c in OHLCV],
        F.min(low_price).alias("low_price"),
        F.min("volume").alias("low_volume"),
        F.sum((F.col("high") < F.col("low")).cast("bigint")).alias("crossed"),
    )
    per_asset = per_day.groupBy("asset").agg(
        F.sum("rows").alias("n_rows"),
        F.sum(F.col("rows") - 1).alias("n_duplicates"),
        *[F.sum(f"null_{c}").alias(f"n_null_{c}") for c in OHLCV],
        F.coalesce(F.min("low_price") <= 0, F.lit(False)).alias("non_positive"),
        F.coalesce(F.min("low_volume") < 0, F.lit(False)).alias("negative_volume"),
        F.coalesce(F.sum("crossed"), F.lit(0)).alias("n_crossed"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"),
    ).join(arrival_inversions(prices), "asset")
    if requested is not None:
        per_asset = requested.select("asset").distinct().join(per_asset, "asset", "left")
    n_rows = F.coalesce(F.col("n_rows"), F.lit(0))
    any_null = sum((F.col(f"n_null_{c}") for c in OHLCV), F.lit(0)) > 0
    early = (
        (F.col("n_duplicates") > 0).cast("int") + (F.col("n_inversions") > 0).cast("int") + any_null.cast("int")
        + F.col("non_positive").cast("int") + F.col("negative_volume").cast("int")
    )
    late = F.when(early == 0, (F.col("n_crossed") > 0).cast("int")).otherwise(0)
    expected = F.datediff("last_day", "first_day") + 1
    return per_asset.select(
        "asset",
        n_rows.alias("n_rows"),
        "n_duplicates", "n_inversions", *[f"n_null_{c}" for c in OHLCV], "non_positive", "negative_volume",
        F.when(early == 0, F.col("n_crossed")).alias("n_high_below_low"),
        F.when((F.col("n_inversions") == 0) & (n_rows > 1), (expected - F.col("n_days")).cast("bigint")).alias("n_missing_dates"),
        F.when(n_rows == 0, F.lit(1)).otherwise(early + late).cast("bigint").alias("n_errors"),
        "first_day", "last_day",
    )


def calendar_gaps(prices: DataFrame) -> DataFrame:
    """(asset, day) of every calendar day between an asset's first and last day that has no row."""
    days = prices.select("asset", "day").distinct()
    span = days.groupBy("asset").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = span.select("asset", F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(days, ["asset", "day"], "left_anti")


def extreme_moves(prices: DataFrame, counts: DataFrame, limit: float = MAX_ABS_LOG_RETURN) -> DataFrame:
    """(asset, n_extreme, first_days): days with a log return beyond ``limit``, for assets without errors.

    Assets without errors have one row per day, so the per-asset window is bounded by the calendar.
    """
    valid = prices.join(counts.where("n_errors = 0").select("asset"), "asset", "left_semi")
    by_day = W.partitionBy("asset").orderBy("day")
    moved = valid.select("asset", "day", F.abs(F.ln("close") - F.lag(F.ln("close")).over(by_day)).alias("move"))
    return (
        moved.where(F.col("move") > limit).groupBy("asset")
        .agg(
            F.count(F.lit(1)).alias("n_extreme"),
            F.slice(F.array_sort(F.collect_list("day")), 1, 5).alias("first_days"),
        )
    )


def data_quality(prices: DataFrame, requested: DataFrame | None = None, limit: float = MAX_ABS_LOG_RETURN) -> DataFrame:
    """(asset, n_rows, errors, warnings, is_valid). Message texts are part of the report format."""
    absent = missing_columns(prices)
    if absent:
        base = prices.groupBy("asset").agg(F.count(F.lit(1)).alias("n_rows"))
        return base.select(
            "asset", "n_rows", F.array(F.lit(f"missing columns: {absent}")).alias("errors"),
            F.array().cast("array<string>").alias("warnings"), F.lit(False).alias("is_valid"),
        )
    counts = quality_counts(prices, requested)
    moves = extreme_moves(prices, counts, limit)
    text = lambda condition, *parts: F.when(
        condition, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    )
    nulls = F.array_compact(F.array(*[F.when(F.col(f"n_null_{c}") > 0, F.lit(f"'{c}'")) for c in OHLCV]))
    empty = F.col("n_rows") == 0
    errors = F.array_compact(F.array(
        text(empty, "data is empty"),
        text(F.col("n_duplicates") > 0, F.col("n_duplicates"), " duplicate timestamp(s) in index"),
        text(F.col("n_inversions") > 0, "index is not sorted ascending"),
        text(F.size(nulls) > 0, "NaN values present in columns: [", F.array_join(nulls, ", "), "]"),
        text(F.col("non_positive"), "non-positive price(s) found in OHLC columns"),
        text(F.col("negative_volume"), "negative volume(s) found"),
        text(F.col("n_high_below_low") > 0, F.col("n_high_below_low"), " row(s) where high < low"),
    ))
    days = F.array_join(F.transform("first_days", lambda d: d.cast("string")), ", ")
    warnings = F.array_compact(F.array(
        text(
            F.col("n_missing_dates") > 0, F.col("n_missing_dates"), " missing date(s) in expected D calendar between ",
            F.col("first_day"), " and ", F.col("last_day"),
        ),
        text(
            F.col("n_extreme") > 0, F.col("n_extreme"), f" day(s) with |log return| > {limit}: ", days,
            F.when(F.col("n_extreme") > 5, "...").otherwise(""),
        ),
    ))
    return counts.join(moves, "asset", "left").select(
        "asset", "n_rows", errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("is_valid")
    )


def valid_only(prices: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of the assets without errors: the gate in front of every model."""
    return prices.join(counts.where("n_errors = 0").select("asset"), "asset", "left_semi")


def require_valid(report: DataFrame) -> DataFrame:
    """The report itself, raising on the first invalid asset."""
    message = F.concat(F.lit("data quality check failed for "), F.col("asset"), F.lit(": "), F.array_join("errors", "; "))
    return report.withColumn(
        "is_valid", F.when(F.col("is_valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )
