"""Streaming queries: the same inputs delivered in parts, each part run to completion from the stored progress."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.joins import spread_lookup
from tidemark.operators import garch as G, ledger as L, series as SE
from tidemark.plans.common import Query, query, returns_of
from tidemark.sources import fixtures as X
from tidemark.sources.stored import shared_dir, stored
from tidemark.streaming import reorg as SR, volatility as SV

PARTS = 3
DEPTH = 5
REORG_FROM = 990


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def _deliver(spark: SparkSession, df: DataFrame, part, folder: str, start, order=range(PARTS)) -> None:
    """Write ``df`` part by part (``part`` = 0..PARTS-1) and run the stream after each: every run but the first is a restart.

    ``df`` is read once for each part. The files of a delivery are deleted by the run after the one that took them in.
    """
    source = f"{folder}/source"
    if not df.where(part.isNull() | ~part.isin(*range(PARTS))).isEmpty():
        raise ValueError("every row must belong to one of the deliveries")
    for i in order:
        df.where(part == i).write.mode("append").option("compression", "zstd").parquet(source)
        stream = spark.readStream.schema(df.schema).option("cleanSource", "delete").parquet(source)
        start(stream).awaitTermination()


def _append(folder: str):
    return lambda out: (
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )


def _by_position() -> Column:
    return F.least(F.floor(F.col("idx") / 900), F.lit(PARTS - 1))


def stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online EWMA over three deliveries; equals the batch recursion with the same seed."""
    returns = stored(returns_of(spark, sf_dir).withColumn("seed", F.var_samp("r").over(W.partitionBy("asset"))), "returns")
    folder = _folder(spark, "ewma")
    sink = _append(folder)
    _deliver(spark, returns, _by_position(), folder, lambda s: sink(SV.ewma_stream(s)))
    return spark.read.schema("asset string, day date, ewma_variance double").parquet(f"{folder}/out")


def stream_garch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online updates of the state after 750 returns; the whole history is delivered, stale days are ignored."""
    returns = stored(returns_of(spark, sf_dir), "returns")
    state = stored(G.fit_state(SE.garch_variance_path(returns.where("idx < 750").join(X.garch_params(spark), "asset"))), "state")
    folder = _folder(spark, "garch")
    sink = _append(folder)
    _deliver(spark, returns, _by_position(), folder, lambda s: sink(SV.garch_stream(s, state)))
    return spark.read.schema("asset string, day date, sigma2 double, eps2 double, n_updates bigint, refit_due boolean").parquet(f"{folder}/out")


def _by_block() -> Column:
    """Consecutive block ranges, the first open below and the last open above."""
    return F.greatest(F.least(F.floor(F.col("block_number") / 500), F.lit(PARTS - 1)), F.lit(0))


def _by_transaction() -> Column:
    """Every delivery holds blocks of all heights."""
    return F.pmod(F.crc32("tx_hash"), F.lit(PARTS))


def _intake(spark: SparkSession, observed: DataFrame, part: Column, canonical, order=range(PARTS)) -> SR.Ledger:
    """All of ``observed`` taken in, in deliveries; ``canonical`` tells the chain as it is in each delivery."""
    folder = _folder(spark, "intake")
    ledger = SR.Ledger(spark, f"{folder}/ledger", observed.schema, DEPTH)
    chains = iter([canonical(i) for i in range(PARTS)])

    def start(stream: DataFrame):
        chain = next(chains)
        return SR.ledger_stream(stream, ledger, f"{folder}/checkpoint", lambda: chain)

    _deliver(spark, observed, part, folder, start, order)
    return ledger


def _settled_intake(spark: SparkSession, sf_dir: str, part: Column, order=range(PARTS)) -> SR.Ledger:
    observed = X.observations(spark, sf_dir)
    canonical = stored(X.canonical_blocks(observed), "canonical")
    return _intake(spark, observed, part, lambda _: canonical, order)


def stream_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows held after streaming intake, the newest blocks first; equals the batch resolution of all observations."""
    return _settled_intake(spark, sf_dir, _by_block(), (2, 0, 1)).view().drop("confirmation_state", "is_orphaned")


def stream_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows streaming intake confirmed, orphaned or left waiting, per contract; equals the batch rule."""
    view = _settled_intake(spark, sf_dir, _by_transaction()).view()
    return view.groupBy("contract_address", "confirmation_state", "is_orphaned").agg(F.count(F.lit(1)).alias("n_events"))


def stream_reorg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and frontiers after the chain left blocks taken in before: the last delivery finds other blocks from
    ``REORG_FROM`` to the end of the delivery before, rewinds and orphans what came in earlier above the rewind."""
    observed = X.observations(spark, sf_dir)
    observed = observed.withColumn("block_hash", X.block_hash(F.col("block_number"), F.lit("a")))
    before = stored(X.canonical_blocks(observed), "canonical")
    fork = F.when(F.col("block_number").between(REORG_FROM, 999), "c").otherwise("a")
    after = stored(before.withColumn("block_hash", X.block_hash(F.col("block_number"), fork)), "canonical")
    ledger = _intake(spark, observed, _by_block(), lambda i: after if i == PARTS - 1 else before)
    frontier = ledger.frontier(ledger.last_batch()).select(
        *L.CONTRACT, "reorg", "orphan_from_block", "last_scanned_block", "last_confirmed_block"
    )
    view = ledger.view().select(*L.IDENTITY, "contract_address", "block_number", "confirmation_state", "is_orphaned")
    return spread_lookup(view, frontier, L.CONTRACT, "tx_hash")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every cycle of the intake took in, read, wrote and checked."""
    ledger = _settled_intake(spark, sf_dir, _by_block())
    return ledger.cycles().select("batch_id", "identities", "rows_written", "ranges_written", "ranges_checked", "reorgs")


QUERIES: dict[str, Query] = {
    fn.__name__: query(fn)
    for fn in (stream_ewma, stream_garch_update, stream_observe, stream_confirm, stream_reorg, stream_progress)
}
