"""Queries on deals, quotes, settlement and the scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import scalars as K
from tidemark.operators import deals as D
from tidemark.plans.common import Query, query
from tidemark.sources import fixtures as X

DEPLOYMENTS = ((1, "c0"), (1, "c1"))


def _every(n: int, rest: int = 0) -> Column:
    return F.col("deal_id") % n == rest


def _contract() -> Column:
    return F.concat(F.lit("c"), (F.col("deal_id") % 3).cast("string"))


def quote_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per deal with planted defects in every field."""
    digit = F.col("deal_id") % 10
    text = (
        F.when(digit == 0, "1e3").when(digit == 1, "abc").when(digit == 2, "-5").when(digit == 3, "").when(digit == 5, "0")
        .when(digit != 4, F.col("notional").cast("string"))
    )
    requests = X.deals(spark, sf_dir).select(
        F.col("deal_id").alias("request_id"), text.alias("notional_text"),
        F.when(_every(37), "XRP").otherwise(F.lit("A")).alias("asset"),
        F.when(_every(31), 2).otherwise(F.col("horizon_days")).alias("horizon_days"),
        F.when(_every(41), 0.9).when(_every(2), 0.95).otherwise(0.99).alias("confidence"),
    )
    return D.validate_requests(requests, ["A", "N", "R"])


def settlement_asset_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.when(_every(4), F.concat(F.lit("0xABCDEF00"), F.md5(F.col("depositor")))).otherwise(F.lit(K.ZERO_ADDRESS))
    rows = X.deals(spark, sf_dir).select("deal_id", K.normalize_asset(address).alias("settlement_asset"))
    return rows.withColumn("label", K.asset_label(F.col("settlement_asset")))


def allowed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON list per supplier: a full entry, one with defaults, one with a bad address, one without a symbol."""
    key = F.col("s_suppkey")
    address = lambda tag: F.concat(F.lit("0xAA000000"), F.md5(F.concat(F.lit(tag), key.cast("string"))))
    entry = lambda a, s, label, d: F.struct(a.alias("address"), s.alias("symbol"), label.alias("label"), d.alias("decimals"))
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")
    symbol = F.concat(F.lit("T"), key.cast("string"))
    config = F.to_json(F.array(
        entry(address("a"), symbol, F.col("s_name"), F.lit(6)), entry(address("b"), symbol, none, no_number),
        entry(F.lit("0x12"), symbol, none, no_number), entry(address("d"), none, none, no_number),
    ))
    configs = X.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("owner"), F.when(key % 10 == 3, "not json").otherwise(config).alias("config")
    )
    return D.allowed_assets(configs)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals with their on-chain place; every 13th is not on a chain yet."""
    off = _every(13)
    return X.deals(spark, sf_dir).withColumn("chain_id", F.when(~off, 1)).withColumn("contract_address", F.when(~off, _contract()))


def deal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup per deal; every 19th id is malformed, every 23rd unknown."""
    key = F.col("deal_id")
    keys = X.deals(spark, sf_dir).select(
        F.lit(1).alias("chain_id"), _contract().alias("contract_address"),
        F.when(_every(19), F.concat(F.lit("x"), key.cast("string"))).when(_every(23), (key + 10**12).cast("string"))
        .otherwise(key.cast("string")).alias("deal_id_text"),
    )
    return D.deal_lookup(keys, _placed(spark, sf_dir))


def _lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("deal_id"), F.col("event_ts")
    return X.lifecycle(X.deals(spark, sf_dir)).select(
        F.lit(1).alias("chain_id"), _contract().alias("contract_address"), "deal_id", "quote_id", "event_name", "log_index",
        F.datediff(F.to_date(at), F.lit("1995-01-01").cast("date")).cast("bigint").alias("block_number"),
        F.concat(F.lit("0x"), F.md5(F.concat(F.lit("tx"), key.cast("string"), F.col("event_name")))).alias("tx_hash"),
        at.alias("observed_at"),
        F.when(at < F.lit("2001-01-01").cast("timestamp_ntz"), "confirmed").otherwise("observed").alias("confirmation_state"),
        (_every(17) & (F.col("log_index") > 0)).alias("is_orphaned"),
    )


def deal_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.deal_timeline(_lifecycle_events(spark, sf_dir))


_RECENT = ("deal_id", "quote_id", "depositor", "counterparty", "notional", "status", "created_at")


def escrows_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.escrows_recent(D.in_scope(_placed(spark, sf_dir), 1, "c1")).select(*_RECENT)


def escrows_recent_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.escrows_recent(D.in_scope(_placed(spark, sf_dir), 1, "c1"), 25, "S7").select(*_RECENT)


def quotes_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the quotes are stored; all are issued again, the missing half twice."""
    quotes = X.risk_quotes(X.deals(spark, sf_dir)).select("quote_id", "depositor", "notional_wei", "issued_at")
    stored_half = quotes.where(F.substring("quote_id", 3, 1) < "8")
    later = quotes.withColumn("issued_at", F.col("issued_at") + F.expr("INTERVAL 1 MINUTE"))
    twice = later.unionByName(later.withColumn("issued_at", F.col("issued_at") + F.expr("INTERVAL 1 HOUR")))
    return D.insert_ignore(stored_half, twice, "quote_id", ["issued_at"])


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = X.deals(spark, sf_dir)
    submitted = X.submissions(deals).withColumn(
        "depositor", F.when(F.substring("quote_id", 3, 2) == "0f", F.lit("")).otherwise(F.col("depositor"))
    )
    used = deals.where((F.col("status") == "settled") & _every(5))
    return D.audit_submissions(submitted, X.issued_quotes(deals), used, DEPLOYMENTS)


def quote_submission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("quote_id", "submitted_at", "reject_reason")


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted submissions, every quote starting with 0..7 handed in twice."""
    accepted = _audited(spark, sf_dir).where(F.col("reject_reason").isNull()).drop("reject_reason").withColumn(
        "settlement_asset", F.when(F.substring("quote_id", 4, 1) < "8", F.lit("0xtoken"))
    )
    again = accepted.where(F.substring("quote_id", 3, 1) < "8").withColumn("submitted_at", F.col("submitted_at") + F.expr("INTERVAL 30 SECOND"))
    return D.create_pending(accepted.unionByName(again), ["submitted_at"])


def pending_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir).withColumn("payment_from", F.col("payment.from_address")).drop("payment")


def payment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment row of every pending deal."""
    return D.payment_records(_pending(spark, sf_dir))


def tx_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = X.deals(spark, sf_dir)
    tx = F.concat(F.lit("0x"), F.md5(F.concat(F.lit("tx"), F.col("deal_id").cast("string"))))
    claims = deals.select(F.col("deal_id").alias("escrow_id"), F.when(~_every(43), F.col("quote_id")).alias("quote_id"), tx.alias("tx_hash"))
    receipts = deals.where(~_every(17)).select(
        tx.alias("tx_hash"), F.when(_every(31), "reverted").otherwise("success").alias("status"), F.upper(_contract()).alias("to_address")
    )
    created = deals.select(tx.alias("tx_hash"), F.when(_every(47), F.lit("other")).otherwise(F.col("quote_id")).alias("quote_id"), "deal_id")
    return D.verify_transactions(claims, receipts, created, [c for _, c in DEPLOYMENTS])


def deal_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = X.deals(spark, sf_dir)
    snap = F.upper(F.md5(F.concat(F.lit("snap"), (F.col("deal_id") + F.when(_every(5), 1).otherwise(0)).cast("string"))))
    rows = deals.select(
        "deal_id", "quote_id", "notional", (F.col("notional") * F.lit(1.5).cast("decimal(2,1)")).cast("decimal(20,8)").alias("required_collateral"),
        F.when(~_every(7), F.concat(F.lit("0X"), snap)).alias("risk_snapshot_hash"),
    )
    return D.deal_detail(rows, X.risk_quotes(deals)).withColumn("buffer", F.col("buffer").cast("decimal(20,8)")).drop("risk_snapshot_hash")


def deal_display_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = X.deals(spark, sf_dir).select(
        "deal_id",
        F.when(_every(7), "pending").when(_every(11), "cancelled").when(_every(5), "active").otherwise(F.col("status")).alias("status"),
        _every(2).alias("has_submitted_tx"),
    )
    return D.display_status(X.per_contract(deals), X.per_contract(_lifecycle_events(spark, sf_dir)))


def _unit_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = K.to_fixed_point(F.col("notional")).cast(D.UNITS)
    return X.deals(spark, sf_dir).select(
        "deal_id", units.alias("notional_units"), (units + F.col("deal_id").cast("decimal(20,0)")).cast(D.UNITS).alias("collateral_units"),
        (F.col("deal_id") % 1000).alias("fee_bps"),
    )


def settlement_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.settlement_amounts(_unit_deals(spark, sf_dir))


def _with_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deals(spark, sf_dir).withColumn("collateral", (F.col("notional") * 2).cast("decimal(20,8)"))


def total_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.total_locked(_with_collateral(spark, sf_dir))


def asset_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = _with_collateral(spark, sf_dir)
    balances = deals.groupBy("settlement_asset").agg(F.sum("notional").cast("decimal(38,8)").alias("balance"))
    return D.asset_surplus(balances, D.total_locked(deals))


def deal_rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = X.deals(spark, sf_dir)
    horizon = F.when(_every(59), 100).when(_every(61), 8000000).otherwise(F.col("horizon_days") * 86400)
    rows = deals.select(
        "deal_id", "depositor", F.when(_every(67), "thief").otherwise(F.col("depositor")).alias("caller"),
        F.when(_every(71), "").when(_every(73), F.col("depositor")).otherwise(F.col("counterparty")).alias("counterparty"),
        F.when(_every(79), F.lit(0).cast("decimal(20,8)")).otherwise(F.col("notional")).alias("notional"),
        F.when(_every(83), F.lit(1).cast("decimal(20,8)")).otherwise((F.col("notional") * 2).cast("decimal(20,8)")).alias("required_collateral"),
        horizon.alias("settlement_horizon"),
        F.when(_every(89), F.lit("0xreused")).otherwise(F.col("quote_id")).alias("quote_id"), "created_at",
        (F.col("created_at") + F.when(_every(97), F.expr("INTERVAL -1 MINUTE")).otherwise(F.expr("INTERVAL 5 MINUTE"))).alias("quote_expiration"),
    )
    return D.audit_deals(rows).select("deal_id", F.array_join("violations", "; ").alias("violations"))


NOW = "2000-01-01 12:00:00"


def deal_refundable(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = X.deals(spark, sf_dir).withColumn("settlement_horizon", F.col("horizon_days") * 86400)
    flagged = D.refundable(deals, F.lit(NOW).cast("timestamp_ntz"))
    return flagged.select("deal_id", "settlement_deadline", "settleable", "refundable")


def settlement_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal events with a wrong payout every 29th and a wrong refund every 31st."""
    units = _unit_deals(spark, sf_dir)
    amounts = D.settlement_amounts(units).select("deal_id", "payout", "platform_fee", "depositor_refund", "collateral_units")
    ends = X.lifecycle(X.deals(spark, sf_dir)).where("event_name <> 'RiskEscrowCreated'").select("deal_id", "event_name")
    off = lambda n: F.when(_every(n), 1).otherwise(0)
    terminal = ends.join(amounts, "deal_id").select(
        "deal_id", "event_name", (F.col("payout") + off(29)).alias("payout"), "platform_fee", "depositor_refund",
        (F.col("collateral_units") - off(31)).alias("amount"),
    )
    diffs = D.reconcile_settlements(X.per_contract(terminal), X.per_contract(units))
    return diffs.select("chain_id", "contract_address", "deal_id", "event_name", *[F.col(c).cast("bigint").alias(c) for c in ("payout_diff", "fee_diff", "refund_diff")])


def risk_vs_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = X.deals(spark, sf_dir)
    quotes = X.risk_quotes(deals).withColumn("horizon_days", F.floor(F.col("settlement_horizon") / 86400).cast("int"))
    terminal = X.lifecycle(deals).where("event_name <> 'RiskEscrowCreated'")
    return D.risk_vs_outcome(quotes, X.per_contract(deals), X.per_contract(terminal))


def legacy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    bookings = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("client_wallet_address"),
        F.col("o_custkey").alias("provider_id"), F.col("o_totalprice").cast("decimal(20,2)").alias("total_amount"),
        (F.col("o_orderkey") % 9).alias("duration_hours"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"),
    )
    providers = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("provider_id"), F.col("c_name").alias("wallet_address"))
    return D.migrate_legacy(bookings, providers)


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sets and keys over deals with planted bad states, payment states and repeated rows."""
    deals = _placed(spark, sf_dir).withColumn("status", F.when(_every(53), "confirmed").otherwise(F.col("status"))).withColumn(
        "payment_status", F.when(_every(59), "refund").otherwise(F.lit("succeeded"))
    )
    rows = deals.unionByName(deals.where(_every(97)))
    events = _lifecycle_events(spark, sf_dir).withColumn(
        "confirmation_state", F.when(_every(61), "final").otherwise(F.col("confirmation_state"))
    )
    parts = [
        D.closed_set_violations(rows, "status", D.DEAL_STATUSES),
        D.closed_set_violations(rows, "payment_status", D.PAYMENT_STATUSES),
        D.closed_set_violations(events, "confirmation_state", D.CONFIRMATION_STATES),
        D.uniqueness_violations(rows, ["quote_id"]),
        D.uniqueness_violations(rows, ["chain_id", "contract_address", "deal_id"]),
        D.uniqueness_violations(events, ["tx_hash", "log_index"]),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def scalar_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount expressions over all submissions."""
    units = K.base_units(F.col("notional_wei"))
    rows = X.submissions(X.deals(spark, sf_dir)).withColumn("amount", K.from_fixed_point(units))
    # Kept as columns: written into every expression below, the amount would make code too long to compile.
    rows = rows.withColumn("text", F.col("amount").cast("string")).withColumn(
        "third", K.div_fixed(F.col("amount"), F.lit(3).cast("decimal(2,0)"), 2, "ceil")
    )
    amount, text, plain = F.col("amount"), F.col("text"), F.col("amount").cast("decimal(20,8)")
    return rows.select(
        "quote_id",
        amount.cast("decimal(38,18)").alias("amount"),
        K.to_fixed_point(amount).alias("units"),
        K.to_fixed_point(F.col("third"), 2).alias("third_up_cents"),
        K.parse_decimal(text, 1, "floor").cast("decimal(20,1)").alias("tenths_down"),
        K.parse_decimal(text, 1, "half_up").cast("decimal(20,1)").alias("tenths_half_up"),
        K.parse_decimal(text, 1, "ceil").cast("decimal(20,1)").alias("tenths_up"),
        K.mul_fixed(plain, F.lit("1.075").cast("decimal(4,3)"), 2, "ceil").cast("decimal(22,2)").alias("marked_up"),
        K.is_base_units(F.col("notional_wei")).alias("is_units"),
        K.coerce_integer(F.col("signature")).alias("signature_number"),
        K.coerce_integer(F.col("settlement_horizon").cast("string")).alias("horizon_number"),
        K.horizon_seconds(F.floor(F.col("settlement_horizon") / 86400)).cast("bigint").alias("horizon_seconds"),
    )


def scalar_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report texts over all deals."""
    key = F.col("deal_id")
    seconds = key * 37 % 400000
    now = F.lit(NOW).cast("timestamp_ntz")
    fraction = ((key % 10007) / F.lit(10000)).cast("decimal(10,4)")
    left = K.seconds_remaining(F.col("created_at"), now)
    document = F.to_json(F.struct("counterparty", "depositor"))
    return X.deals(spark, sf_dir).select(
        "deal_id",
        K.format_fixed(F.col("notional"), 2, 2).alias("grouped"),
        K.format_fixed(F.col("notional"), 0, 6, False).alias("plain"),
        K.format_fraction(fraction).alias("percent"),
        K.format_amount(F.col("notional"), "ETH").alias("token_text"),
        K.format_usd(K.to_usd(F.col("notional"), F.lit("2").cast("decimal(4,2)"))).alias("usd_text"),
        K.format_utc(F.col("created_at")).alias("utc_text"),
        K.format_duration(seconds).alias("duration_text"),
        left.alias("seconds_left"), (left <= 0).alias("expired"),
        K.short_hex(F.col("quote_id")).alias("short_quote"),
        K.same_address(F.col("quote_id"), F.upper("quote_id")).alias("same"),
        K.conf_key(F.lit(0.99)).alias("conf_key"),
        F.from_json(document, "map<string,string>")["depositor"].alias("decoded_depositor"),
    )


QUERIES: dict[str, Query] = {
    fn.__name__: query(fn)
    for fn in (
        quote_request_validation, settlement_asset_normalize, allowed_assets, deal_lookup, deal_timeline, escrows_recent,
        escrows_recent_party, quotes_insert_ignore, quote_submission_audit, pending_deals, payment_records, tx_verification, deal_detail,
        deal_display_status, settlement_amounts, total_locked, asset_surplus, deal_rule_audit, deal_refundable,
        settlement_reconciliation, risk_vs_outcome, legacy_migration, constraint_violations, scalar_fixed_point, scalar_format,
    )
}
