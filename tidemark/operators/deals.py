"""Deals, quotes and settlement: intake, audits, lookups, accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import asset_label, format_fixed, format_utc, from_fixed_point, short_hex
from tidemark.operators.ledger import DEAL

# Allowed sets and bounds.
SUPPORTED_HORIZONS = (1, 7, 14, 30)
SUPPORTED_CONFIDENCES = (0.95, 0.99)
DEAL_STATUSES = ("pending", "active", "settled", "refunded", "cancelled")
PAYMENT_STATUSES = ("unpaid", "pending", "processing", "confirming", "succeeded", "failed", "refunded", "cancelled")
CONFIRMATION_STATES = ("observed", "confirmed")
CONFIRMED_STATUSES = ("active", "settled", "refunded")
MIN_HORIZON_SECONDS = 3600
MAX_HORIZON_SECONDS = 90 * 86400
BPS = 10_000
EVENT_TITLES = {
    "RiskEscrowCreated": "Escrow created",
    "RiskEscrowSettled": "Escrow settled",
    "RiskEscrowRefunded": "Escrow refunded",
    "RiskOracleUpdated": "Risk oracle rotated",
    "PlatformFeeUpdated": "Platform fee updated",
    "PlatformWalletUpdated": "Platform wallet updated",
}


def _first_reason(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


def _said(condition: Column, text: str | Column) -> Column:
    return F.when(condition, F.lit(text) if isinstance(text, str) else text)


# --- intake ---------------------------------------------------------------------------------------------------


def validate_requests(requests: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Adds ``reject_reason`` (null = accepted) to quote requests with a text notional.

    Notional is any text that reads as a decimal number, exponents included, and is above zero.
    """
    text = F.trim("notional_text")
    is_number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    # Read off the text, so that no size or scale is out of reach.
    positive = text.rlike(r"^[+]?[0-9.]*[1-9]")
    reason = _first_reason(
        _said(F.col("notional_text").isNull() | (F.col("notional_text") == ""), "missing notional"),
        _said(~is_number, "notional is not a valid decimal string"),
        _said(~positive, "notional must be positive"),
        _said(~F.coalesce(F.col("asset").isin(*assets), F.lit(False)), "unsupported asset"),
        _said(~F.coalesce(F.col("horizon_days").isin(*SUPPORTED_HORIZONS), F.lit(False)), "unsupported horizon"),
        _said(~F.coalesce(F.col("confidence").isin(*SUPPORTED_CONFIDENCES), F.lit(False)), "unsupported confidence"),
    )
    return requests.withColumn("reject_reason", reason)


def allowed_assets(configs: DataFrame, json_col: str = "config") -> DataFrame:
    """Well-formed entries of JSON asset lists, with label and decimals defaulted; unreadable lists give nothing."""
    from tidemark.functions.scalars import ADDRESS_TEXT

    schema = "array<struct<address:string,symbol:string,label:string,decimals:int>>"
    rest = [c for c in configs.columns if c != json_col]
    entries = configs.select(*rest, F.inline(F.from_json(json_col, schema)))
    kept = entries.where(F.col("address").rlike(ADDRESS_TEXT) & F.col("symbol").isNotNull())
    return kept.select(
        *rest, F.lower("address").alias("address"), "symbol",
        F.coalesce("label", "symbol").alias("label"), F.coalesce("decimals", F.lit(18)).alias("decimals"),
    )


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``existing`` plus the first new row of every key it does not hold."""
    rest = [c for c in existing.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    fresh = first.join(existing.select(key), key, "left_anti").select(key, *[F.col("_r")[c].alias(c) for c in rest])
    return existing.select(key, *rest).unionByName(fresh)


# The ten signed fields of a quote by their column, in the order in which they are signed.
SIGNED_FIELDS = {
    "quote_id": "quoteId",
    "depositor": "depositor",
    "counterparty": "counterparty",
    "settlement_asset": "settlementAsset",
    "notional_wei": "notional",
    "required_collateral": "requiredCollateral",
    "quote_expiration": "quoteExpiration",
    "settlement_horizon": "settlementHorizon",
    "model_version": "modelVersion",
    "risk_snapshot_hash": "riskSnapshotHash",
}


def audit_submissions(submitted: DataFrame, issued: DataFrame, used: DataFrame, deployments: Sequence[tuple[int, str]]) -> DataFrame:
    """Adds ``reject_reason`` to submitted quotes: the first rule they break against what was issued.

    A signature, all ten signed fields present, known quote, field by field equality as text, signature, chain and
    contract, expiry (at ``submitted_at``, by the issued quote's ``expires_at``), single use. ``used`` holds the quote ids
    already taken by a deal.
    """
    held = issued.select("quote_id", *[F.col(c).alias(f"_i_{c}") for c in issued.columns if c != "quote_id"])
    taken = used.select("quote_id").distinct().withColumn("_used", F.lit(True))
    joined = submitted.join(held, "quote_id", "left").join(taken, "quote_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    incomplete = [_said(text(f) == "", f"Incomplete RiskQuote: missing {name}") for f, name in SIGNED_FIELDS.items()]
    different = [
        _said(text(f) != text(f"_i_{f}"), f'Quote field "{name}" does not match the quote this server issued')
        for f, name in SIGNED_FIELDS.items() if f != "quote_id"
    ]
    place = F.lit(False)
    for chain, contract in deployments:
        place = place | ((F.col("_i_chain_id") == chain) & (F.lower("_i_verifying_contract") == contract.lower()))
    reason = _first_reason(
        _said(text("signature") == "", "Missing required fields: quote, signature"),
        *incomplete,
        _said(F.col("_i_signature").isNull(), "Unknown quote: no matching quote was issued by this server"),
        *different,
        _said(~F.col("signature").eqNullSafe(F.col("_i_signature")), "Signature does not match the issued quote"),
        _said(~place, "This quote was issued for a different chain or contract"),
        _said(F.col("submitted_at") >= F.col("_i_expires_at"), "Quote has expired; request a new one"),
        _said(F.col("_used"), "This quote has already been used to create an escrow"),
    )
    return joined.withColumn("reject_reason", reason).drop("_used", *[c for c in held.columns if c != "quote_id"])


def create_pending(accepted: DataFrame, order: Sequence[str]) -> DataFrame:
    """One pending deal row per accepted quote, with its payment row and the number of rejected repeats.

    The earliest submission of a quote wins; repeats get "An escrow for this quote already exists".
    """
    rest = [c for c in accepted.columns if c != "quote_id"]
    first = accepted.groupBy("quote_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), (F.count(F.lit(1)) - 1).alias("n_rejected_repeats")
    )
    rows = first.select("quote_id", "n_rejected_repeats", *[F.col("_r")[c].alias(c) for c in rest])
    amount = from_fixed_point(F.col("notional_wei").cast("decimal(38,0)"))
    return rows.select(
        "quote_id", "depositor", "counterparty",
        format_fixed(amount, 2, 2, False).alias("amount"),
        F.lit("pending").alias("status"), F.lit("pending").alias("payment_status"),
        asset_label(F.col("settlement_asset")).alias("crypto_currency"),
        F.col("notional_wei").alias("notional"), "settlement_asset",
        F.col("settlement_horizon").alias("settlement_horizon_seconds"),
        F.struct(
            F.lit("crypto").alias("payment_method"), F.lit("USD").alias("currency"), F.lit("pending").alias("status"),
            F.col("depositor").alias("from_address"), F.col("counterparty").alias("to_address"),
        ).alias("payment"),
        "n_rejected_repeats",
    )


def payment_records(pending: DataFrame) -> DataFrame:
    return pending.select(F.col("quote_id").alias("escrow_id"), "amount", "crypto_currency", "payment.*")


def verify_transactions(claims: DataFrame, receipts: DataFrame, created: DataFrame, deployments: Sequence[str]) -> DataFrame:
    """Adds ``on_chain_deal_id`` or ``reject_reason`` to claims (escrow_id, quote_id, tx_hash).

    ``receipts`` (tx_hash, status, to_address), ``created`` (tx_hash, quote_id, deal_id). One transaction may hold many
    events, so the event is matched on both keys.
    """
    logs = created.groupBy("tx_hash", "quote_id").agg(F.min("deal_id").alias("_deal"))
    mined = receipts.select("tx_hash", F.col("status").alias("_status"), F.lower("to_address").alias("_to"))
    joined = claims.join(mined, "tx_hash", "left").join(logs, ["tx_hash", "quote_id"], "left")
    reason = _first_reason(
        _said(F.col("quote_id").isNull(), "Escrow has no associated quote_id to verify against"),
        _said(F.col("_status").isNull(), "Transaction not found or not yet mined"),
        _said(F.col("_status") != "success", "Transaction reverted on-chain"),
        _said(~F.coalesce(F.col("_to").isin(*[d.lower() for d in deployments]), F.lit(False)), "Transaction does not target this deployment's settlement contract"),
        _said(F.col("_deal").isNull(), "Transaction did not emit a RiskEscrowCreated event for this escrow's quote"),
    )
    return joined.withColumn("reject_reason", reason).withColumn(
        "on_chain_deal_id", F.when(F.col("reject_reason").isNull(), F.col("_deal"))
    ).drop("_status", "_to", "_deal")


# --- lookups and reports --------------------------------------------------------------------------------------


def deal_id_error(text: Column) -> Column:
    return F.when(~text.rlike("^[0-9]+$"), "dealId must be a non-negative integer")


def deal_lookup(keys: DataFrame, deals: DataFrame) -> DataFrame:
    """Deal state for rows (chain_id, contract_address, deal_id_text): bad ids and unknown deals are told apart."""
    asked = keys.withColumn("error", deal_id_error(F.col("deal_id_text"))).withColumn(
        "deal_id", F.when(F.col("error").isNull(), F.col("deal_id_text").try_cast("bigint"))
    )
    found = deals.select("chain_id", "contract_address", "deal_id", "status")
    joined = asked.join(found, ["chain_id", "contract_address", "deal_id"], "left")
    return joined.withColumn(
        "error", F.coalesce("error", F.when(F.col("status").isNull(), "Not indexed yet"))
    ).withColumn("confirmed", F.coalesce(F.col("status").isin(*CONFIRMED_STATUSES), F.lit(False)))


def deal_timeline(events: DataFrame) -> DataFrame:
    """Every deal's events in chain order with title, tone and badge; orphaned rows stay and are tagged.

    A deal lies in one partition and is sorted there; there is no order among deals that do not share one.
    """
    deal = ("chain_id", "contract_address", "deal_id")
    title = F.col("event_name")
    for name, label in EVENT_TITLES.items():
        title = F.when(F.col("event_name") == name, label).otherwise(title)
    orphaned = F.col("is_orphaned")
    return events.select(
        "chain_id", "contract_address", "deal_id", "block_number", "log_index", "tx_hash",
        title.alias("title"), format_utc(F.col("observed_at")).alias("timestamp"),
        F.when(orphaned, "critical").when(F.col("confirmation_state") == "confirmed", "positive").otherwise("info").alias("tone"),
        F.when(orphaned, "orphaned (reorg)").otherwise(F.col("confirmation_state")).alias("badge"),
        F.concat(F.lit("block "), F.col("block_number").cast("string"), F.lit(" · "), short_hex(F.col("tx_hash"))).alias("detail"),
    ).repartition(*deal).sortWithinPartitions(*deal, "block_number", "log_index", "tx_hash")


def in_scope(deals: DataFrame, chain_id: int, contract: str) -> DataFrame:
    """Rows of the active deployment and rows not on any chain yet."""
    return deals.where(F.col("chain_id").isNull() | ((F.col("chain_id") == chain_id) & (F.col("contract_address") == contract)))


def escrows_recent(deals: DataFrame, n: int = 25, party: str | None = None) -> DataFrame:
    """The newest deals, optionally of one party on either side (case-insensitive)."""
    if party is not None:
        who = party.lower()
        deals = deals.where((F.lower("depositor") == who) | (F.lower("counterparty") == who))
    return deals.orderBy(F.desc("created_at"), F.desc("deal_id")).limit(n)


def deal_detail(deals: DataFrame, quotes: DataFrame) -> DataFrame:
    """Deal beside its quote: buffer over notional and whether the snapshot hashes agree (null when unknown)."""
    issued = quotes.select("quote_id", F.col("model_version"), F.col("risk_snapshot_hash").alias("_issued_hash"))
    joined = deals.join(issued, "quote_id", "left")
    return joined.withColumn("buffer", F.col("required_collateral") - F.col("notional")).withColumn(
        "hashes_match", F.lower("risk_snapshot_hash") == F.lower("_issued_hash")
    ).drop("_issued_hash")


def display_status(deals: DataFrame, events: DataFrame) -> DataFrame:
    """Label, tone and confirmation of each deal from its stored status and its latest non-orphaned lifecycle event.

    Deal ids repeat across contracts, so both sides are keyed by (chain_id, contract_address, deal_id).
    """
    place = F.struct("block_number", "log_index", "tx_hash")
    latest = events.where(~F.col("is_orphaned")).groupBy(*DEAL).agg(
        F.max_by(F.struct("event_name", "confirmation_state"), place).alias("_e")
    )
    joined = deals.join(latest, list(DEAL), "left")
    seen = lambda name: (F.col("_e.event_name") == name) & (F.col("_e.confirmation_state") == "observed")
    status = F.col("status")
    look = lambda label, tone, sure: F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"), F.lit(sure).alias("confirmed"))
    shown = (
        F.when(status == "settled", look("Settled", "positive", True))
        .when(status == "refunded", look("Refunded", "neutral", True))
        .when(status == "cancelled", look("Cancelled", "neutral", True))
        .when((status == "active") & seen("RiskEscrowSettled"), look("Active — settlement observed", "info", False))
        .when((status == "active") & seen("RiskEscrowRefunded"), look("Active — refund observed", "info", False))
        .when(status == "active", look("Active", "positive", True))
        .when(seen("RiskEscrowCreated"), look("Observed — awaiting confirmation", "info", False))
        .when(F.col("has_submitted_tx"), look("Submitted — not yet observed", "warning", False))
        .otherwise(look("Pending", "neutral", False))
    )
    return joined.withColumn("_s", shown).select(*deals.columns, "_s.*")


# --- accounting -----------------------------------------------------------------------------------------------

UNITS = "decimal(30,0)"


def settlement_amounts(deals: DataFrame) -> DataFrame:
    """Integer settlement of rows (notional_units, collateral_units, fee_bps): fee, payout, depositor refund.

    Base units up to 10^30 keep the product with the fee rate inside 38 digits.
    """
    scaled = F.col("notional_units").cast(UNITS) * F.col("fee_bps").cast("decimal(5,0)")
    fee = ((scaled - scaled % F.lit(BPS).cast("decimal(5,0)")) / F.lit(BPS).cast("decimal(5,0)")).cast(UNITS)
    return (
        deals.withColumn("platform_fee", fee)
        .withColumn("payout", (F.col("notional_units") - F.col("platform_fee")).cast(UNITS))
        .withColumn("depositor_refund", (F.col("collateral_units") - F.col("notional_units")).cast(UNITS))
    )


def total_locked(deals: DataFrame) -> DataFrame:
    """Collateral of active deals per settlement asset (null = native)."""
    locked = F.when(F.col("status") == "active", F.col("collateral"))
    return deals.groupBy("settlement_asset").agg(F.coalesce(F.sum(locked), F.lit(0)).cast("decimal(38,8)").alias("locked"))


def asset_surplus(balances: DataFrame, locked: DataFrame) -> DataFrame:
    """max(balance - locked, 0) per asset; an asset with nothing locked is all surplus."""
    known = locked.select(F.col("settlement_asset").alias("_a"), "locked")
    joined = balances.join(known, F.col("settlement_asset").eqNullSafe(F.col("_a")), "left").drop("_a")
    gap = F.col("balance") - F.coalesce("locked", F.lit(0))
    return joined.withColumn("surplus", F.greatest(gap, F.lit(0)).cast("decimal(38,8)"))


def audit_deals(deals: DataFrame) -> DataFrame:
    """Every creation rule a deal breaks, as an array; quote re-use is counted over the whole table."""
    uses = deals.groupBy("quote_id").agg(F.count(F.lit(1)).alias("_uses"))
    joined = deals.join(uses, "quote_id")
    no_party = F.col("counterparty").isNull() | (F.col("counterparty") == "")
    horizon = F.col("settlement_horizon")
    broken = F.array_compact(F.array(
        _said(~F.col("caller").eqNullSafe(F.col("depositor")), "Caller is not the quoted depositor"),
        _said(no_party, "Invalid counterparty"),
        _said(F.col("counterparty") == F.col("depositor"), "Depositor cannot equal counterparty"),
        _said(F.col("notional") <= 0, "Notional must be greater than 0"),
        _said(F.col("required_collateral") < F.col("notional"), "Collateral must cover notional"),
        _said((horizon < MIN_HORIZON_SECONDS) | (horizon > MAX_HORIZON_SECONDS), "Settlement horizon out of bounds"),
        _said(F.col("_uses") > 1, "Risk quote already used"),
        _said(F.col("created_at") > F.col("quote_expiration"), "Risk quote expired"),
    ))
    return joined.withColumn("violations", broken).drop("_uses")


def refundable(deals: DataFrame, now: Column) -> DataFrame:
    """Deadline, settleable and refundable flags at ``now``."""
    deadline = F.col("created_at") + F.make_dt_interval(secs=F.col("settlement_horizon").cast("decimal(18,6)"))
    active = F.col("status") == "active"
    return (
        deals.withColumn("settlement_deadline", deadline)
        .withColumn("settleable", active)
        .withColumn("refundable", active & (now > F.col("settlement_deadline")))
    )


def reconcile_settlements(terminal: DataFrame, deals: DataFrame) -> DataFrame:
    """Terminal events (deal key, event_name, payout, platform_fee, depositor_refund, amount) against recomputed amounts."""
    expected = settlement_amounts(deals).select(
        *DEAL, "collateral_units", F.col("payout").alias("_payout"), F.col("platform_fee").alias("_fee"),
        F.col("depositor_refund").alias("_refund"),
    )
    joined = terminal.join(expected, list(DEAL))
    settled = F.col("event_name") == "RiskEscrowSettled"
    return joined.select(
        *DEAL, "event_name",
        F.when(settled, F.col("payout") - F.col("_payout")).alias("payout_diff"),
        F.when(settled, F.col("platform_fee") - F.col("_fee")).alias("fee_diff"),
        F.when(settled, F.col("depositor_refund") - F.col("_refund")).otherwise(F.col("amount") - F.col("collateral_units")).alias("refund_diff"),
    )


def risk_vs_outcome(quotes: DataFrame, deals: DataFrame, terminal: DataFrame) -> DataFrame:
    """Quoted terms against what happened, per outcome and horizon."""
    ended = terminal.groupBy(*DEAL).agg(F.min_by("event_name", F.struct("event_ts", "log_index")).alias("_end"))
    joined = quotes.select("quote_id", "horizon_days").join(deals.select("quote_id", *DEAL, "notional"), "quote_id").join(ended, list(DEAL), "left")
    outcome = F.when(F.col("_end") == "RiskEscrowSettled", "settled").when(F.col("_end") == "RiskEscrowRefunded", "refunded").otherwise("open")
    return joined.groupBy(outcome.alias("outcome"), "horizon_days").agg(
        F.count(F.lit(1)).alias("n_deals"), F.sum("notional").cast("decimal(38,8)").alias("notional")
    )


def migrate_legacy(bookings: DataFrame, providers: DataFrame) -> DataFrame:
    """Legacy bookings joined to their provider, hours turned into minutes."""
    wallets = providers.select("provider_id", F.col("wallet_address").alias("counterparty_wallet_address"))
    return bookings.join(wallets, "provider_id").select(
        "id", F.col("client_wallet_address").alias("depositor_wallet_address"), "counterparty_wallet_address",
        F.col("total_amount").alias("amount"), (F.col("duration_hours") * 60).alias("duration_minutes"), "status", "created_at",
    )


def closed_set_violations(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return bad.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(f"{column} not allowed").alias("rule"), "value", "n_rows"
    )


def uniqueness_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; rows with a null part do not count."""
    counted = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return counted.select(
        F.lit(f"{','.join(columns)} not unique").alias("rule"),
        F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("value"), "n_rows",
    )


