"""Model state as an append-only table with a latest-row view and a history view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MODEL_STATE_SCHEMA = T.StructType([
    T.StructField("asset", T.StringType(), False),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("training_window_start", T.DateType()),
    T.StructField("training_window_end", T.DateType()),
    T.StructField("n_obs_fit", T.LongType()),
    T.StructField("fitted_params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("fit_diagnostics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("fit_timestamp", T.TimestampType()),
    T.StructField("latest_conditional_variance", T.DoubleType()),
    T.StructField("latest_observation_day", T.DateType()),
    T.StructField("latest_squared_residual", T.DoubleType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("is_fit", T.BooleanType()),
    T.StructField("observed_at", T.TimestampType()),
])
_IDENTITY = ("asset", "model_name")


def from_fit(fits: DataFrame, state: DataFrame, model_version: str = "garch_1_1-v1") -> DataFrame:
    """State rows of a fit: ``fits`` from ``fit_garch`` joined with ``fit_state`` of the same windows."""
    as_map = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    kept = fits.select("asset", *[c for c in fits.columns if c not in state.columns])
    at = F.col("latest_day").cast("timestamp")
    return state.join(kept, "asset").select(
        "asset", F.lit("garch_1_1").alias("model_name"), F.lit(model_version).alias("model_version"),
        "training_window_start", F.col("latest_day").alias("training_window_end"), "n_obs_fit",
        as_map("omega", "alpha", "beta", "mu").alias("fitted_params"),
        as_map("log_likelihood", "aic", "bic", "converged").alias("fit_diagnostics"),
        at.alias("fit_timestamp"),
        F.col("latest_variance").alias("latest_conditional_variance"),
        F.col("latest_day").alias("latest_observation_day"),
        F.col("latest_eps2").alias("latest_squared_residual"),
        F.create_map(F.lit("dist"), F.lit("normal")).alias("config"),
        F.lit(True).alias("is_fit"), at.alias("observed_at"),
    )


def append_state(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("model_name").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_STATE_SCHEMA).parquet(path)


def latest_state(states: DataFrame) -> DataFrame:
    """The most recently observed row per (asset, model); a partial aggregate, no ranking."""
    rest = [c for c in states.columns if c not in _IDENTITY]
    orderable = [c for c in rest if not isinstance(states.schema[c].dataType, T.MapType)]
    carried = F.struct(*rest)
    order = F.struct("observed_at", *[c for c in orderable if c != "observed_at"])
    return states.groupBy(*_IDENTITY).agg(F.max_by(carried, order).alias("_last")).select(*_IDENTITY, "_last.*")


def state_history(states: DataFrame) -> DataFrame:
    """Rows written by a fit; updates only move the latest row."""
    return states.where("is_fit")
