"""First-order recursions ``v[t] = a[t] * v[t-1] + b[t]`` as a chunked scan.

A composition of such steps is again one such step, so a series is cut into chunks, each chunk is reduced to
one ``(A, F)`` pair, the pairs give every chunk its carry-in, and the chunks are expanded independently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

CHUNK_ROWS = 64


def affine_scan(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    a: str,
    b: str,
    out: str,
    *,
    prev: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
    levels: int = 1,
) -> DataFrame:
    """Append ``out`` (and ``prev``, the value one step earlier) to ``df``.

    ``idx`` counts 0, 1, 2, ... within ``keys`` and the value before index 0 is 0, so a seed goes into ``b`` at
    index 0. With ``levels=1`` the carry-ins of one key are folded in one task, over 1/64 of its rows: enough for
    daily series, which the calendar bounds. For longer series raise ``levels``: every level divides what is
    folded by 64 again, and the chunks of one key are then spread over the cluster.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in (idx, a, b)]
    number = f"_chunk{levels}"
    chunked = df.withColumn(number, F.floor(F.col(idx) / F.lit(chunk_rows)).cast("bigint"))
    if levels > 1:
        chunked = chunked.repartition(*keys, number)
    packed = chunked.groupBy(*keys, number).agg(
        F.array_sort(F.collect_list(F.struct(idx, a, b, *rest))).alias("_items")
    )
    reduced = packed.withColumn(
        "_step",
        F.aggregate(
            "_items",
            F.struct(F.lit(1.0).alias("A"), F.lit(0.0).alias("F")),
            lambda acc, x: F.struct((acc["A"] * x[a]).alias("A"), (acc["F"] * x[a] + x[b]).alias("F")),
        ),
    )
    if levels > 1:
        summary = reduced.select(*keys, number, F.col("_step.A").alias("_A"), F.col("_step.F").alias("_F"), "_items")
        carried = affine_scan(
            summary, keys, number, "_A", "_F", "_end", prev="_carry", chunk_rows=chunk_rows, levels=levels - 1
        )
    else:
        before = W.partitionBy(*keys).orderBy(number).rowsBetween(W.unboundedPreceding, -1)
        carried = reduced.withColumn(
            "_carry",
            F.aggregate(F.collect_list("_step").over(before), F.lit(0.0), lambda s, x: s * x["A"] + x["F"]),
        )
    valued = carried.withColumn(
        "_values",
        F.aggregate(
            "_items",
            F.struct(F.col("_carry").alias("v"), F.array().cast("array<double>").alias("vs")),
            lambda acc, x: F.struct(
                (acc["v"] * x[a] + x[b]).alias("v"),
                F.concat(acc["vs"], F.array(acc["v"] * x[a] + x[b])).alias("vs"),
            ),
            lambda acc: acc["vs"],
        ),
    )
    rows = valued.select(*keys, "_carry", "_values", F.posexplode("_items").alias("_pos", "_item"))
    result = [F.element_at("_values", F.col("_pos") + 1).alias(out)]
    if prev:
        result.append(F.when(F.col("_pos") == 0, F.col("_carry")).otherwise(F.get("_values", F.col("_pos") - 1)).alias(prev))
    names = [c for c in df.columns if c not in keys]
    return rows.select(*keys, *[F.col("_item")[c].alias(c) for c in names], *result)
