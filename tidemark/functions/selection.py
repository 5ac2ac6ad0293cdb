"""Exact order statistics of groups of any size, without gathering or sorting a group.

Values are counted per bucket of their group's range, a mergeable count of at most ``BUCKETS + 3`` numbers per group. The
running counts tell which bucket holds a wanted rank. A bucket with few values is read off; one that is still large is cut
into buckets again, on its own values alone, until it is small or all its values are equal. So tasks hold counters and at
most ``SMALL`` values per wanted rank, however many values a group has and however unevenly they lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.joins import spread_lookup
from tidemark.sources.stored import stored

BUCKETS = 1_024
SMALL = 4_096


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def _bucket(x: Column, low: Column, high: Column, buckets: int) -> Column:
    """The bucket of ``x`` between ``low`` and ``high``, rising with ``x``; infinities and NaN (largest) have their own.

    Halves keep the width finite. Rounding is monotone, so a larger value is never in a lower bucket.
    """
    place = F.least(F.floor((x / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0)) * buckets), F.lit(buckets - 1))
    return (
        F.when(F.isnan(x), buckets + 1).when(x == float("inf"), buckets).when(x == float("-inf"), -1)
        .otherwise(F.coalesce(place, F.lit(0))).cast("int")
    )


def ranked_values(values: DataFrame, stats: DataFrame, keys: Sequence[str], ranks: Column, buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """``(keys, _rank, _value)``: the value at each wanted zero-based rank.

    ``values`` (keys, _x; no null) and ``stats`` (keys, n_scenarios, _low, _high of the finite values) are written tables; ``ranks``
    is an array column over ``stats``.
    """
    keys = list(keys)
    wanted = stats.select(*keys, F.explode(F.array_distinct(ranks)).alias("_rank")).where("_rank >= 0")
    least, most = stats.agg(F.min("n_scenarios"), F.max("n_scenarios")).first()
    found = []
    if least is None or least <= small:
        # Groups that are small as a whole.
        whole = stats.where(F.col("n_scenarios") <= small).select(*keys)
        lists = spread_lookup(values, whole, keys, "_x", how="inner").groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
        found.append(wanted.join(lists, keys).select(*keys, "_rank", F.get("_xs", F.col("_rank").cast("int")).alias("_value")))
        if most is None or most <= small:
            return found[0]
    large = stats.where(F.col("n_scenarios") > small)
    parts = large.select(*keys, F.lit("").alias("_part"), F.lit(0).cast("bigint").alias("_before"), "_low", "_high")
    rows = values.withColumn("_part", F.lit(""))
    cell = [*keys, "_part", "_bucket"]
    while True:
        bounds = parts.select(*keys, "_part", "_low", "_high")
        placed = spread_lookup(rows, bounds, [*keys, "_part"], "_x", how="inner").withColumn(
            "_bucket", _bucket(F.col("_x"), F.col("_low"), F.col("_high"), buckets)
        ).select(*keys, "_part", "_bucket", "_x")
        x = F.col("_x")
        counted = placed.groupBy(*cell).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"),
            F.min(F.when(_finite(x), x)).alias("_low"), F.max(F.when(_finite(x), x)).alias("_high"),
        )
        counted = stored(counted, "buckets").join(parts.select(*keys, "_part", "_before"), [*keys, "_part"])
        earlier = W.partitionBy(*keys, "_part").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        hits = stored(counted.join(wanted, keys).where(inside), "hits")
        equal = F.col("_least").eqNullSafe(F.col("_most"))
        found.append(hits.where(equal).select(*keys, "_rank", F.col("_least").alias("_value")))
        few = hits.where(~equal & (F.col("_n") <= small))
        lists = spread_lookup(placed, few.select(*cell).distinct(), cell, "_x", how="inner").groupBy(*cell).agg(
            F.array_sort(F.collect_list("_x")).alias("_xs")
        )
        found.append(few.join(lists, cell).select(*keys, "_rank", F.get("_xs", (F.col("_rank") - F.col("_before")).cast("int")).alias("_value")))
        many = hits.where(~equal & (F.col("_n") > small))
        if many.isEmpty():
            return reduce(DataFrame.unionByName, found)
        inner = F.concat_ws("/", "_part", F.col("_bucket").cast("string")).alias("_part")
        again = many.select(*cell).distinct()
        rows = spread_lookup(placed, again, cell, "_x", how="inner").select(*keys, inner, "_x")
        parts = many.select(*keys, inner, "_before", "_low", "_high").distinct()
        # Every round reads only the values of the buckets still open.
        rows, parts = stored(rows, "open"), stored(parts, "parts")


def quantiles(
    df: DataFrame, keys: Sequence[str], x: str, levels: Mapping[str, float], carry: Sequence[str] = (), buckets: int = BUCKETS, small: int = SMALL
) -> tuple[DataFrame, DataFrame]:
    """The values as a written table (keys, _x) and, per group, ``n_scenarios``, ``carry`` and a column for every level:
    the exact quantile with linear interpolation, null for a group without values. ``carry`` is constant within a group.
    """
    keys = list(keys)
    raw = stored(df.select(*keys, *carry, F.col(x).cast("double").alias("_x")), "values")
    finite = F.when(_finite(F.col("_x")), F.col("_x"))
    stats = raw.groupBy(*keys).agg(
        F.count("_x").alias("n_scenarios"), F.min(finite).alias("_low"), F.max(finite).alias("_high"), *[F.first(c).alias(c) for c in carry]
    )
    stats = stored(stats, "groups")
    values = raw.select(*keys, "_x").where(F.col("_x").isNotNull())

    def position(p: float) -> Column:
        return (F.col("n_scenarios") - 1) * F.lit(p)

    ends = F.array(*[end(position(p)).cast("bigint") for p in levels.values() for end in (F.floor, F.ceil)])
    at_ranks = ranked_values(values, stats, keys, ends, buckets, small)
    maps = at_ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    joined = stats.join(maps, keys, "left")

    def quantile(p: float) -> Column:
        low = F.col("_at")[F.floor(position(p)).cast("bigint")]
        high = F.col("_at")[F.ceil(position(p)).cast("bigint")]
        between = low + (high - low) * (position(p) - F.floor(position(p)))
        return F.when(low.eqNullSafe(high), low).otherwise(between)

    return values, joined.select(*keys, "n_scenarios", *carry, *[quantile(p).alias(name) for name, p in levels.items()])
