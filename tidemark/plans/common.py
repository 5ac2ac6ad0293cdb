"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.prices import log_returns
from tidemark.session import configure
from tidemark.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 8


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to 8 places: the last bits of ln, exp and sums differ between engines."""
    return df.select(*[
        F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
        for c in df.schema.fields
    ])


def query(fn: Query) -> Query:
    """A registered query: session settings first, doubles rounded last."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return rounded(fn(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def returns_of(spark: SparkSession, sf_dir: str, asset=None) -> DataFrame:
    return log_returns(fixtures.prices(spark, sf_dir, asset))
