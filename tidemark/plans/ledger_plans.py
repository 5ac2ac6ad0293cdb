"""Queries on the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import ledger as L
from tidemark.plans.common import Query, query
from tidemark.sources import fixtures as X, tables
from tidemark.sources.stored import stored

DEPTH = 5
START_BLOCK = 0


def logs_scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_range(X.observations(spark, sf_dir), 1, "c1", 1500, 1600)


def decode_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = L.signature_table(spark, X.topics_of(tuple(L.EVENT_FIELDS)))
    decoded = L.decode_logs(X.raw_logs(X.deals(spark, sf_dir)), signatures)
    field = lambda n: F.col("decoded")[n].alias(n)
    return decoded.select(
        "chain_id", "contract_address", "block_number", "tx_hash", "log_index", "event_name", "deal_id",
        *[field(n) for n in (
            "quoteId", "depositor", "counterparty", "settlementAsset", "notional", "collateralLocked", "settlementDeadline",
            "modelVersion", "riskSnapshotHash", "payout", "platformFee", "depositorRefund", "amount",
        )],
    )


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events with their fields as JSON text; some lack a field or hold a malformed one."""
    key = F.col("deal_id")
    events = X.lifecycle(X.deals(spark, sf_dir), ("depositor", "counterparty"))
    address = lambda c: F.concat(F.lit("0x00000000"), F.md5(c))
    fields = F.struct(
        key.cast("string").alias("dealId"),
        F.concat(F.lit("0x"), F.sha2("quote_id", 256)).alias("quoteId"),
        F.when(key % 31 == 0, F.lit("0x12")).otherwise(address("depositor")).alias("depositor"),
        address("counterparty").alias("counterparty"), address("quote_id").alias("settlementAsset"),
        F.when(key % 23 == 0, "1.5").when(key % 19 != 0, F.lit("1000")).alias("notional"),
        F.lit("2000").alias("collateralLocked"), F.lit("99").alias("settlementDeadline"), F.lit("v1").alias("modelVersion"),
        F.when(key % 47 == 0, F.lit("0xzz")).otherwise(F.concat(F.lit("0x"), F.sha2(F.lit("s"), 256))).alias("riskSnapshotHash"),
        F.when(key % 29 != 0, "5").alias("payout"), F.lit("1").alias("platformFee"), F.lit("2").alias("depositorRefund"),
        F.when(key % 37 == 0, "abc").otherwise("7").alias("amount"),
    )
    return events.select("deal_id", "event_name", "log_index", F.to_json(fields).alias("decoded_json"))


def event_decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = L.event_fields(stored_events(spark, sf_dir).withColumnRenamed("deal_id", "source_deal"))
    rejects = L.invalid_events(L.with_deal_id(events))
    return rejects.select("source_deal", "deal_id", "event_name", "log_index", "reason")


def observation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.observation_outcomes(X.observations(spark, sf_dir))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.observation_current(L.observation_outcomes(X.observations(spark, sf_dir)))


def observation_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir)


def split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = X.observations(spark, sf_dir).groupBy(*L.CONTRACT).agg(
        F.min("block_number").alias("from_block"), F.max("block_number").alias("to_block")
    )
    return L.split_range(spans, 100, 4)


def _checkpoints(observed: DataFrame) -> DataFrame:
    """c0 agrees with the chain, c1 holds a stale hash, c2 has no hash yet."""
    digit = F.substring("contract_address", 2, 1).cast("int")
    spans = observed.groupBy(*L.CONTRACT).agg(F.max("block_number").alias("_top"))
    block = F.col("_top") - digit * 3
    fork = F.when(digit == 0, "a").otherwise("b")
    return spans.select(
        *L.CONTRACT, block.alias("last_scanned_block"),
        F.when(digit == 2, F.lit("")).otherwise(X.block_hash(block, fork)).alias("last_scanned_block_hash"),
        (block - 2).alias("last_confirmed_block"),
    )


def reorg_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = X.observations(spark, sf_dir)
    return L.reconcile_frontier(_checkpoints(observed), X.canonical_blocks(observed), DEPTH, START_BLOCK)


def _confirmation_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Resolved events, oracle rotations already confirmed, and the canonical chain."""
    events = L.as_observed(stored(_current(spark, sf_dir), "current"))
    events = events.withColumn("confirmation_state", F.when(F.col("log_index") == 4, "confirmed").otherwise("observed"))
    return events, stored(X.canonical_blocks(X.observations(spark, sf_dir)), "canonical")


def _confirm(events: DataFrame, canonical: DataFrame) -> DataFrame:
    mismatch = stored(L.first_mismatch(events, canonical, DEPTH), "mismatch")
    return L.confirm_blocks(events, canonical, DEPTH, mismatch)


def pending_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, canonical = _confirmation_input(spark, sf_dir)
    return L.pending_blocks(events, canonical, DEPTH).orderBy(*L.CONTRACT, "block_number")


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirm(*_confirmation_input(spark, sf_dir))


def confirm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed(spark, sf_dir).select(
        *L.IDENTITY, "contract_address", "block_number", "event_name", "confirmation_state", "is_orphaned", "was_confirmed"
    )


def event_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.event_state_counts(_confirmed(spark, sf_dir))


def derive_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events of all deals but every 13th, merged with pending rows of all but every 7th."""
    deals, key = X.deals(spark, sf_dir), F.col("deal_id")
    events = X.lifecycle(deals.where("deal_id % 13 <> 0"), ("depositor", "counterparty", "settlement_asset", "horizon_days")).select(
        "*", F.datediff(F.to_date("event_ts"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("block_number"),
        F.concat(F.lit("0x"), F.md5(F.concat(F.lit("tx"), key.cast("string"), F.col("event_name")))).alias("tx_hash"),
        (F.col("notional") * 2).cast("decimal(20,8)").alias("required_collateral"), F.lit("garch_1_1-v1").alias("model_version"),
        F.concat(F.lit("0x"), F.md5(F.concat(F.lit("snap"), key.cast("string")))).alias("risk_snapshot_hash"),
        (F.col("event_ts") + F.make_dt_interval(days=F.col("horizon_days"))).alias("settlement_deadline"),
    )
    pending = deals.where("deal_id % 7 <> 0").select(
        "quote_id", "depositor", (F.col("notional") + 1).cast("decimal(20,8)").alias("notional"), F.lit("pending").alias("status")
    )
    facts = [
        "depositor", "counterparty", "settlement_asset", "notional", "required_collateral", "model_version", "risk_snapshot_hash",
        "settlement_deadline", "block_number", "tx_hash",
    ]
    return L.derive_deals(X.per_contract(events), pending, ["block_number", "log_index"], facts, ["block_number", "tx_hash"])


def config_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = F.create_map(
        F.lit("newOracle"), F.concat(F.lit("o"), F.col("ord1").cast("string")),
        F.lit("newFeeBps"), (F.col("ord2") % 1000).cast("string"),
        F.lit("newWallet"), F.concat(F.lit("w"), F.col("ord1").cast("string")),
    )
    return L.config_state(_current(spark, sf_dir).withColumn("decoded", decoded))


def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (contract, arrival day) wrote its frontier once."""
    writes = X.observations(spark, sf_dir).groupBy(*L.CONTRACT, F.col("observed_at").alias("updated_at")).agg(
        F.max("block_number").alias("last_scanned_block"), F.min("block_hash").alias("last_scanned_block_hash")
    )
    return L.latest_checkpoint(writes)


def ingest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = X.observations(spark, sf_dir)
    # Marked before it is written: the rows held now are read off instead of being sought again.
    outcomes = stored(L.mark_current(L.observation_outcomes(observed)), "outcomes")
    canonical = stored(X.canonical_blocks(observed), "canonical")
    confirmed = _confirm(L.as_observed(L.current_rows(outcomes)), canonical)
    return L.ingest_health(outcomes, confirmed, canonical, DEPTH)


def health_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One health snapshot per order, with stale, failing, lagging and missing ones among them."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    snapshots = X.table(spark, sf_dir, "orders").select(
        key.alias("snapshot_id"),
        F.when(key % 11 != 0, at).alias("last_successful_rpc_call"),
        F.when(key % 7 == 0, F.concat(F.lit("e"), key.cast("string"))).alias("last_error"),
        (F.col("o_custkey") % 40).alias("confirmed_lag_blocks"),
        F.when(key % 13 != 0, F.lit(DEPTH)).alias("confirmation_depth"),
        (at + F.make_dt_interval(secs=(key % 120).cast("decimal(18,6)"))).alias("now"),
    )
    return L.classify_health(snapshots).select("snapshot_id", "health", "detail")


QUERIES: dict[str, Query] = {
    fn.__name__: query(fn)
    for fn in (
        logs_scan_range, decode_logs, event_decode_rejects, observation_outcomes, observation_current, split_range, reorg_rewind,
        pending_blocks, confirm_blocks, event_state_counts, derive_deals, config_state, checkpoint_latest, ingest_health, health_class,
    )
}
