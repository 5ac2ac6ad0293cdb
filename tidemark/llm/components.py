"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import attach, settle


def _contract(links: DataFrame, both_ways: bool) -> DataFrame:
    """Point the neighbours of every node at the least node around it.

    With ``both_ways`` the larger neighbours of each node are moved (large star), else each node and its smaller
    neighbours (small star). The least neighbour is a combinable aggregate; it comes back to the links through
    ``attach``, so a hub with very many links is not gathered anywhere.
    """
    seen = links
    if both_ways:
        seen = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    seen = seen.select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = seen.groupBy("node").agg(F.min("other").alias("_min"), F.count("*").alias("_n"))
    least = settle(least.select("node", F.least("node", "_min").alias("least"), "_n"), "least")
    joined = attach(seen, least, "node", "_n")
    if both_ways:
        moved = joined.where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))
    else:
        moved = joined.select(F.col("other").alias("high"), F.col("least").alias("low")).unionByName(
            least.select(F.col("node").alias("high"), F.col("least").alias("low"))
        )
    return moved.where("high <> low").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another; component is its least reachable node.

    Links may repeat, run either way or join a node to itself (such a node appears only if it has another link); null
    ends are ignored. Rounds grow with the logarithm of the longest chain; each round's table is written and read back.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = settle(now.select(high.alias("high"), low.alias("low")).distinct(), "links")
    mark = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if sign == mark or not sign[0]:
            return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
                now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        mark = sign
        now = settle(_contract(settle(_contract(now, True), "large"), False), "small")
