"""Inputs derived from the given tables: price series, ledger observations, deals, quotes and ticks.

``FIXTURES.md`` states each as SQL. A daily series holds one row per calendar day and asset, so everything that
runs per asset afterwards is bounded by the calendar (36,525 rows a century), however large ``lineitem`` is; the
scan of ``lineitem`` itself is one hash-partitioned aggregate with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.literal import literal_table

HORIZONS = (1, 7, 14, 30)

# Parameters of the oracle-checked recursions. R is near-integrated on purpose.
GARCH_PARAMS = [
    ("A", 2e-4, 8e-2, 85e-2, 0.0),
    ("N", 5e-4, 1e-1, 55e-2, 1e-4),
    ("R", 1e-5, 2e-2, 979e-3, 0.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_return_flag() -> Column:
    return F.col("l_returnflag")


def by_flag_status_line() -> Column:
    """Widened key: 42 series instead of 3."""
    return F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))


def _damped(px: Column) -> Column:
    return F.round(F.lit(1000.0) * F.pow(px / 1000.0, F.lit(0.1)), 6)


def prices(spark: SparkSession, sf_dir: str, asset: Column | None = None) -> DataFrame:
    """(asset, day, open, high, low, close, volume, ingest_seq), one row per asset and day."""
    asset = by_return_flag() if asset is None else asset
    trades = table(spark, sf_dir, "lineitem").select(
        asset.alias("asset"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("ext"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    daily = trades.groupBy("asset", "day").agg(
        F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px"))["px"].alias("first_px"),
        F.max("px").alias("hi"),
        F.min("px").alias("lo"),
        (F.sum("ext").cast("double") / F.sum("qty").cast("double")).alias("vwap"),
        F.sum("qty").cast("double").alias("volume"),
    )
    return daily.select(
        "asset", "day",
        _damped(F.col("first_px")).alias("open"),
        _damped(F.col("hi")).alias("high"),
        _damped(F.col("lo")).alias("low"),
        _damped(F.col("vwap")).alias("close"),
        "volume",
        F.row_number().over(W.partitionBy("asset").orderBy("day")).cast("bigint").alias("ingest_seq"),
    )


def prices_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted faults: N gets gaps and spikes; R duplicates, a bad close, a negative volume, an order inversion."""
    base = prices(spark, sf_dir)
    n, r, seq = F.col("asset") == "N", F.col("asset") == "R", F.col("ingest_seq")
    kept = base.where(~(n & (seq % 97 == 0))).select(
        "asset", "day", "open", "high", "low",
        F.when(n & (seq % 400 == 7), F.col("close") * 2).when(r & (seq == 50), F.lit(-1.0)).otherwise(F.col("close")).alias("close"),
        F.when(r & (seq == 60), -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.when(r & (seq == 70), F.lit(1000000).cast("bigint")).otherwise(seq).alias("ingest_seq"),
    )
    copies = base.where(r & (seq % 89 == 0)).withColumn("ingest_seq", seq + 2000000)
    return kept.unionByName(copies)


def garch_params(spark: SparkSession) -> DataFrame:
    return literal_table(spark, GARCH_PARAMS, "asset string, omega double, alpha double, beta double, mu double")


def horizons(spark: SparkSession, days: tuple[int, ...] = HORIZONS) -> DataFrame:
    return literal_table(spark, [(d,) for d in days], "horizon_days int")


# Chain 2 started later, so its block numbers lag those of chain 1 on the same day.
CHAIN_2_LAG = 200


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts c0 and c1 on chain 1, c2 on chain 2, whose hashes and head are its own."""
    chain = F.when(F.col("l_orderkey") % 3 == 2, 2).otherwise(1)
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    line = table(spark, sf_dir, "lineitem").withColumn("chain_id", chain).withColumn(
        "block_number", day - F.when(F.col("chain_id") == 2, CHAIN_2_LAG).otherwise(0)
    )
    block, number = F.col("block_number"), F.col("l_linenumber")
    fork = F.when((block % 17 == 0) & (F.col("l_linestatus") == "F"), "b").otherwise("a")
    return line.select(
        "chain_id",
        F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")).alias("contract_address"),
        "block_number",
        block_hash(block, fork).alias("block_hash"),
        _hex_md5(F.concat(F.lit("tx"), F.col("l_orderkey").cast("string"))).alias("tx_hash"),
        (F.col("l_orderkey") % 64).cast("int").alias("tx_index"),
        number.alias("log_index"),
        F.when(number == 1, "RiskEscrowCreated").when(number == 2, "RiskEscrowSettled")
        .when(number == 3, "RiskEscrowRefunded").when(number == 4, "RiskOracleUpdated")
        .when(number == 5, "PlatformFeeUpdated").when(number == 6, "PlatformWalletUpdated")
        .otherwise("Unknown").alias("event_name"),
        F.when(number <= 3, F.col("l_orderkey")).alias("deal_id"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_partkey").alias("ord1"),
        F.col("l_suppkey").alias("ord2"),
    )


def canonical_blocks(observed: DataFrame) -> DataFrame:
    return observed.select("chain_id", "block_number").distinct().withColumn("block_hash", block_hash(F.col("block_number"), F.lit("a")))


def block_hash(block: Column, fork: Column) -> Column:
    return _hex_md5(F.concat(block.cast("string"), fork, F.col("chain_id").cast("string")))


def per_contract(df: DataFrame) -> DataFrame:
    """Deals placed on contracts c0..c2, ids counted per contract: the same id names a deal of each."""
    key = F.col("deal_id")
    return df.withColumn("chain_id", F.when(key % 3 == 2, 2).otherwise(1)).withColumn(
        "contract_address", F.concat(F.lit("c"), (key % 3).cast("string"))
    ).withColumn("deal_id", F.floor(key / 3))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, priority, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        key.alias("deal_id"),
        _hex_md5(F.concat(F.lit("q"), key.cast("string"))).alias("quote_id"),
        F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("depositor"),
        F.concat(F.lit("s"), (key % 100).cast("string")).alias("counterparty"),
        F.when(key % 4 == 0, "erc20").alias("settlement_asset"),
        F.col("o_totalprice").cast("decimal(20,8)").alias("notional"),
        F.when(priority == "1-URGENT", 1).when(priority == "2-HIGH", 7).when(priority == "3-MEDIUM", 14).otherwise(30).alias("horizon_days"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "F", "settled").when(status == "P", "refunded").otherwise("active").alias("status"),
    )


def lifecycle(all_deals: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per lifecycle event; a tenth of the settled deals get a second terminal event that must lose.

    ``keep`` names further deal columns to carry.
    """
    event = lambda name, days, index: F.struct(
        F.lit(name).alias("event_name"),
        (F.col("created_at") + F.expr(f"INTERVAL {days} DAY")).alias("event_ts"),
        F.lit(index).alias("log_index"),
    )
    settled = F.col("status") == "settled"
    events = F.filter(
        F.array(
            event("RiskEscrowCreated", 0, 0),
            F.when(settled, event("RiskEscrowSettled", 3, 1)),
            F.when(F.col("status") == "refunded", event("RiskEscrowRefunded", 40, 1)),
            F.when(settled & (F.col("deal_id") % 10 == 0), event("RiskEscrowRefunded", 50, 2)),
        ),
        lambda e: e.isNotNull(),
    )
    return all_deals.select("deal_id", "quote_id", "notional", *keep, F.inline(events)).select(
        "deal_id", "quote_id", "event_name", "event_ts", "log_index", "notional", *keep
    )


def _wei_text(notional: Column, tail: str | Column) -> Column:
    tail = F.lit(tail) if isinstance(tail, str) else tail
    return F.concat((notional * 100).cast("decimal(38,0)").cast("string"), tail)


def risk_quotes(all_deals: DataFrame) -> DataFrame:
    key = F.col("deal_id")
    return all_deals.select(
        "quote_id",
        F.lit(1).alias("chain_id"),
        F.concat(F.lit("c"), (key % 3).cast("string")).alias("verifying_contract"),
        "depositor", "counterparty", "settlement_asset",
        _wei_text(F.col("notional"), "0000000000000000").alias("notional_wei"),
        (F.col("horizon_days") * 86400).alias("settlement_horizon"),
        F.lit("garch_1_1-v1").alias("model_version"),
        _hex_md5(F.concat(F.lit("snap"), key.cast("string"))).alias("risk_snapshot_hash"),
        _hex_md5(F.concat(F.lit("sig"), F.col("quote_id"))).alias("signature"),
        F.col("created_at").alias("issued_at"),
        (F.col("created_at") + F.expr("INTERVAL 5 MINUTE")).alias("quote_expiration"),
    )


ZERO_ADDRESS = "0x" + "0" * 40


def _signed_terms() -> list[Column]:
    """The signed fields of a quote that do not take part in pricing."""
    return [
        F.coalesce("settlement_asset", F.lit(ZERO_ADDRESS)).alias("settlement_asset"),
        _wei_text(F.col("notional") * 2, "0000000000000000").alias("required_collateral"),
        F.unix_seconds((F.col("created_at") + F.expr("INTERVAL 5 MINUTE")).cast("timestamp")).alias("quote_expiration"),
    ]


def issued_quotes(all_deals: DataFrame) -> DataFrame:
    """The quotes a server issued, with all signed fields; every 50th is not among them."""
    issued = all_deals.where(F.col("deal_id") % 50 != 3)
    signed = issued.select("quote_id", *_signed_terms())
    quotes = risk_quotes(issued).withColumnRenamed("quote_expiration", "expires_at").drop("settlement_asset")
    return quotes.join(signed, "quote_id")


def submissions(all_deals: DataFrame) -> DataFrame:
    """What clients hand in, with planted defects in every signed field."""
    key = F.col("deal_id")
    asset, collateral, expiration = _signed_terms()
    bad = lambda n, rest, column, wrong: F.when(key % n == rest, wrong).otherwise(column)
    return all_deals.select(
        "quote_id", "depositor",
        bad(41, 0, F.col("counterparty"), F.col("depositor")).alias("counterparty"),
        bad(43, 1, asset, F.lit("0xtoken")).alias("settlement_asset"),
        _wei_text(
            F.col("notional"), F.when(key % 37 == 0, "0000000000000001").otherwise("0000000000000000")
        ).alias("notional_wei"),
        bad(47, 1, collateral, F.lit("1")).alias("required_collateral"),
        bad(53, 1, expiration, expiration + 60).alias("quote_expiration"),
        bad(59, 1, F.col("horizon_days") * 86400, F.lit(2 * 86400)).alias("settlement_horizon"),
        bad(61, 1, F.lit("garch_1_1-v1"), F.when(key % 2 == 0, "garch_1_1-v2")).alias("model_version"),
        bad(67, 1, _hex_md5(F.concat(F.lit("snap"), key.cast("string"))), F.lit("0x00")).alias("risk_snapshot_hash"),
        F.when(key % 71 != 1, F.when(key % 29 == 0, "bad").otherwise(_hex_md5(F.concat(F.lit("sig"), F.col("quote_id"))))).alias("signature"),
        (
            F.col("created_at")
            + F.when(key % 23 == 0, F.expr("INTERVAL 6 MINUTE")).otherwise(F.expr("INTERVAL 1 MINUTE"))
        ).alias("submitted_at"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").cast("double").alias("price"), "props"
    )


def topics_of(events: tuple[str, ...]) -> dict[str, str]:
    """Stand-in topic0 per event name (the real ones need a hash Spark does not have)."""
    import hashlib

    return {name: "0x" + hashlib.sha256(name.encode()).hexdigest() for name in events}


def raw_logs(all_deals: DataFrame) -> DataFrame:
    """Undecoded logs of the lifecycle: 32-byte topics and data words. Every ninth deal adds a log of another event."""
    from tidemark.functions.uint256 import hex_word

    events = lifecycle(all_deals, ("depositor", "counterparty", "settlement_asset"))
    key, name = F.col("deal_id"), F.col("event_name")
    address = lambda c: F.lpad(F.md5(F.col(c)), 64, "0")
    bytes32 = lambda c: F.rpad(c, 64, "0")
    units = (F.col("notional") * 100).cast("decimal(20,0)").cast("decimal(38,0)") * F.lit(10**16).cast("decimal(17,0)")
    amount, double = hex_word(units), hex_word(units * 2)
    small = lambda c: F.lower(F.lpad(F.hex(c), 64, "0"))
    topic = F.concat(F.lit("0x"), F.sha2(name, 256))
    prefixed = lambda *words: F.array(topic, *[F.concat(F.lit("0x"), w) for w in words])
    deal = small(key)
    version = "garch_1_1-v1"
    asset = F.when(F.col("settlement_asset").isNull(), F.lit("0" * 64)).otherwise(address("settlement_asset"))
    created_data = F.concat(
        address("counterparty"), asset, amount, double, small(F.unix_timestamp("event_ts") + 604800), small(F.lit(224)),
        bytes32(F.md5(F.concat(F.lit("snap"), key.cast("string")))), small(F.lit(len(version))), bytes32(F.lit(version.encode().hex())),
    )
    payout = F.when(key % 10 == 0, F.lit("f" * 64)).otherwise(amount)
    settled, created = name == "RiskEscrowSettled", name == "RiskEscrowCreated"
    place = [
        F.lit(1).alias("chain_id"), F.concat(F.lit("c"), (key % 3).cast("string")).alias("contract_address"),
        F.datediff(F.to_date("event_ts"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("block_number"),
        _hex_md5(F.concat(F.lit("tx"), key.cast("string"))).alias("tx_hash"),
    ]
    logs = events.select(
        *place, "log_index",
        F.when(created, prefixed(deal, bytes32(F.substring("quote_id", 3, 32)), address("depositor")))
        .when(settled, prefixed(deal, address("counterparty"))).otherwise(prefixed(deal, address("depositor"))).alias("topics"),
        F.concat(F.lit("0x"), F.when(created, created_data).when(settled, F.concat(payout, small(key % 1000), amount)).otherwise(double)).alias("data"),
    )
    other = events.where((key % 9 == 0) & created).select(
        *place, F.lit(9).alias("log_index"), F.array(F.concat(F.lit("0x"), F.sha2(F.lit("Transfer"), 256))).alias("topics"), F.lit("0x").alias("data")
    )
    return logs.unionByName(other)


def _hex_md5(text: Column) -> Column:
    return F.concat(F.lit("0x"), F.md5(text))
