"""Event intake as a stream: idempotent observation, confirmation gate, re-organisations, restart.

Every micro-batch writes one new version, named by its batch id, of the rows it touched:

* ``rows/batch=N/done=false`` all rows still waiting after batch N, bounded by the confirmation depth,
* ``rows/batch=N/done=true``  the rows batch N confirmed or orphaned.

Batch N reads versions up to N-1 and overwrites N, so a batch repeated after a failure ends in the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tidemark.functions.ordered import with_previous
from tidemark.operators import ledger as L

_STATE = ("confirmation_state", "is_orphaned")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``; empty where nothing is written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _open_rows(spark: SparkSession, folder: str, batch_id: int, schema: StructType) -> DataFrame:
    return _read(spark, f"{folder}/rows/batch={batch_id}/done=false", schema)


def _closed_rows(spark: SparkSession, folder: str, upto: int, schema: StructType, only: DataFrame | None = None) -> DataFrame:
    """The latest version of the rows closed in batches 0..upto, optionally only of the identities in ``only``."""
    names = [f.name for f in schema.fields]
    rest = [n for n in names if n not in L.IDENTITY]
    versioned = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("done", BooleanType())])
    versions = _read(spark, f"{folder}/rows", versioned).where((F.col("batch") <= upto) & F.col("done"))
    if only is not None:
        versions = versions.join(only, list(L.IDENTITY), "left_semi")
    last = versions.groupBy(*L.IDENTITY).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*L.IDENTITY, *[F.col("_r")[c].alias(c) for c in rest]).select(*names)


def resolve_batch(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Apply a batch of observations to held rows: same hash ignored, another hash replaces and resets the row."""
    columns = batch.columns
    fresh = L.as_observed(batch).withColumn("_seq", F.lit(1))
    both = held.select(*columns, *_STATE).withColumn("_seq", F.lit(0)).unionByName(fresh).distinct()
    bucket = F.when(F.col("_seq") == 0, F.lit("0001-01-01").cast("date")).otherwise(F.to_date("observed_at"))
    order = ("_seq", *L.ARRIVAL)
    stepped = with_previous(both, L.IDENTITY, bucket, order, "block_hash", "_held")
    accepted = stepped.where(F.col("_held").isNull() | (F.col("_held") != F.col("block_hash")))
    rest = [c for c in columns if c not in L.IDENTITY]
    last = accepted.groupBy(*L.IDENTITY).agg(F.max_by(F.struct(*rest, *_STATE), F.struct(*order)).alias("_r"))
    return last.select(*L.IDENTITY, *[F.col("_r")[c].alias(c) for c in (*rest, *_STATE)]).select(*columns, *_STATE)


def process_batch(batch: DataFrame, batch_id: int, folder: str, canonical: DataFrame, depth: int) -> None:
    """One cycle: observe, check against the canonical chain, confirm or orphan, write the new versions."""
    spark = batch.sparkSession
    schema = L.as_observed(batch).schema
    keys = list(L.IDENTITY)
    opened = _open_rows(spark, folder, batch_id - 1, schema)
    seen = batch.select(*keys).distinct()
    # A row opened again after it was closed lives in the open table only.
    closed = _closed_rows(spark, folder, batch_id - 1, schema, seen).join(opened.select(*keys), keys, "left_anti")
    # The resolved rows are read three times below, so they are written once.
    resolved = f"{folder}/resolved/batch={batch_id}"
    resolve_batch(opened.unionByName(closed), batch).write.mode("overwrite").parquet(resolved)
    rows = spark.read.schema(schema).parquet(resolved)
    bad = L.first_mismatch(rows, canonical, depth).where(F.col("first_bad").isNotNull()).drop("head_block")
    if not bad.isEmpty():
        # Orphaning reaches rows closed earlier at or above the mismatch, so those take part too.
        older = _closed_rows(spark, folder, batch_id - 1, schema).join(rows.select(*keys), keys, "left_anti")
        marked = older.join(bad, list(L.CONTRACT)).where(F.col("block_number") >= F.col("first_bad")).drop("first_bad")
        rows = rows.unionByName(marked.select(*rows.columns))
    final = L.confirm_blocks(rows, canonical, depth).select(*schema.names)
    done = (F.col("confirmation_state") == "confirmed") | F.col("is_orphaned")
    final.withColumn("done", done).write.mode("overwrite").partitionBy("done").parquet(f"{folder}/rows/batch={batch_id}")


def ledger_view(spark: SparkSession, folder: str, batch_id: int, schema: StructType) -> DataFrame:
    """All rows after batch ``batch_id``: open ones, and closed ones that were not opened again."""
    opened = _open_rows(spark, folder, batch_id, schema)
    closed = _closed_rows(spark, folder, batch_id, schema)
    return opened.unionByName(closed.join(opened.select(*L.IDENTITY), list(L.IDENTITY), "left_anti"))


def last_batch(spark: SparkSession, folder: str) -> int:
    """The id of the newest version written."""
    return spark.read.parquet(f"{folder}/rows").agg(F.max("batch")).first()[0]


def intake_stream(
    logs: DataFrame, folder: str, checkpoint: str, canonical: Callable[[], DataFrame], depth: int
) -> StreamingQuery:
    """Run all available files through ``process_batch``; progress and restart come from ``checkpoint``.

    ``canonical`` is read anew in every cycle, as the chain moves on between cycles.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, folder, canonical(), depth)

    return (
        logs.observe("intake", F.count(F.lit(1)).alias("rows"), F.max("block_number").alias("last_block"))
        .writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def reorg_stream(
    spark: SparkSession, folder: str, batch_id: int, schema: StructType, checkpoints: DataFrame, canonical: DataFrame, depth: int, start_block: int
) -> DataFrame:
    """Late data as a re-organisation: rewind stale frontiers and orphan the rows above them."""
    frontier = L.reconcile_frontier(checkpoints, canonical, depth, start_block)
    return L.orphan_from(ledger_view(spark, folder, batch_id, schema), frontier)


def progress_metrics(query: StreamingQuery) -> list[dict]:
    """One record per micro-batch: batch id, input rows, duration and the observed counters."""
    records = []
    for progress in query.recentProgress:
        observed = {name: row.asDict() for name, row in (progress.observedMetrics or {}).items()}
        records.append({
            "batch_id": progress.batchId, "input_rows": progress.numInputRows,
            "duration_ms": dict(progress.durationMs).get("triggerExecution"), "observed": observed,
        })
    return records
