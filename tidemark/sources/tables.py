"""Explicit schemas, readers and writers of the stored tables. Nothing is inferred."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PRICE_SCHEMA = "asset string, day date, open double, high double, low double, close double, volume double, ingest_seq bigint"
LOG_SCHEMA = (
    "chain_id int, contract_address string, block_number bigint, block_hash string, tx_hash string, tx_index int, "
    "log_index int, event_name string, deal_id bigint, observed_at timestamp, ord1 bigint, ord2 bigint"
)
DEAL_SCHEMA = (
    "deal_id bigint, quote_id string, chain_id int, contract_address string, depositor string, counterparty string, "
    "settlement_asset string, notional string, required_collateral string, status string, payment_status string, created_at timestamp"
)
QUOTE_SCHEMA = (
    "quote_id string, chain_id int, verifying_contract string, depositor string, counterparty string, settlement_asset string, "
    "notional_wei string, settlement_horizon bigint, model_version string, risk_snapshot_hash string, signature string, "
    "issued_at timestamp, quote_expiration timestamp"
)
SCHEMAS = {"prices": PRICE_SCHEMA, "logs": LOG_SCHEMA, "deals": DEAL_SCHEMA, "risk_quotes": QUOTE_SCHEMA}
PARTITIONS = {"prices": ["asset"], "logs": ["chain_id", "contract_address"], "deals": [], "risk_quotes": []}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write_table(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """Parquet under the table's partition columns; ``overwrite`` replaces only the partitions present in ``df``."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    keys = PARTITIONS[name]
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def load_prices(spark: SparkSession, path: str, asset: str, start: dt.date, end: dt.date) -> DataFrame:
    """Price rows of one asset, both ends inclusive: partition pruning on asset, row-group pruning on day."""
    stored = read_table(spark, path, "prices")
    return stored.where((F.col("asset") == asset) & F.col("day").between(F.lit(start), F.lit(end)))


def scan_range(logs: DataFrame, chain_id: int, contract: str, from_block: int, to_block: int) -> DataFrame:
    """Logs of one contract over an inclusive block range."""
    return logs.where(
        (F.col("chain_id") == chain_id) & (F.col("contract_address") == contract) & F.col("block_number").between(from_block, to_block)
    )


def read_logs(spark: SparkSession, path: str, schema: str | T.StructType = LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_logs(spark: SparkSession, path: str, schema: str | T.StructType = LOG_SCHEMA, files_per_trigger: int = 1) -> DataFrame:
    """The same table as a stream; progress lives in the query's checkpoint, so a restart resumes where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """Drop-in for ``read_table`` where the tables live in a database (needs its driver on the classpath)."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
