"""Joins against small or skewed sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SPREAD = 16


def spread_work(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition few but expensive rows over all cores.

    A partition count stated here is kept at run time; without it, rows that are small in bytes would be merged into
    one task however long each takes.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def spread_lookup(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: str, *, how: str = "left", spread: int = SPREAD) -> DataFrame:
    """Join a big side to a small table on few, hot keys.

    ``small`` is repeated ``spread`` times and ``big`` picks one copy by a hash of ``spread_by``, so a key holding
    a third of all rows is divided over ``spread`` tasks. Nothing is force-broadcast: at run time the planner
    broadcasts ``small`` when its measured size allows it.
    """
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    salted = big.withColumn("_copy", F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("int"))
    return salted.join(copies, [*on, "_copy"], how).drop("_copy")
