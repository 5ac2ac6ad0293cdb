"""Previous value in a long order, without ordering a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_previous(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Append ``out``: ``value`` of the row before in ``order`` within ``keys`` (null for the first).

    ``bucket`` must rise with ``order`` (a day of a timestamp, a slice of a sequence). Rows are ordered per
    (keys, bucket) only; a bucket's first row takes the last value of the bucket before it, found on one summary
    row per bucket. No row is joined. A key holding a large share of all rows is therefore spread over its buckets.
    """
    keys, order = list(keys), list(order)
    marked = df.withColumn("_bucket", bucket)
    ends = marked.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias(value))
    # The last value of a bucket becomes a row in front of the key's next bucket.
    ahead = F.lead("_bucket").over(W.partitionBy(*keys).orderBy("_bucket"))
    carried = ends.withColumn("_bucket", ahead).where(F.col("_bucket").isNotNull()).withColumn("_own", F.lit(1))
    both = marked.withColumn("_own", F.lit(2)).unionByName(carried, allowMissingColumns=True)
    inside = W.partitionBy(*keys, "_bucket").orderBy("_own", *order)
    return both.withColumn(out, F.lag(value).over(inside)).where(F.col("_own") == 2).drop("_bucket", "_own")
