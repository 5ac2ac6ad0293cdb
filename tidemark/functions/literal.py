"""Short literal tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few fixed rows as a local relation: its size is known when the plan is made, so joins broadcast it."""
    fields = StructType.fromDDL(schema)
    return spark.createDataFrame(pd.DataFrame(list(rows), columns=fields.names), fields)
