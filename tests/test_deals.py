from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as K
from tidemark.operators import deals as D

LIFE = "chain_id int, contract_address string, deal_id bigint, event_name string, confirmation_state string, is_orphaned boolean, block_number bigint, log_index int, tx_hash string"


@pytest.mark.parametrize(
    "status, submitted, events, label",
    [
        ("settled", False, [], "Settled"), ("refunded", False, [], "Refunded"), ("cancelled", True, [], "Cancelled"),
        ("active", True, [], "Active"),
        ("active", True, [("RiskEscrowSettled", "observed", False, 5, 0)], "Active — settlement observed"),
        ("active", True, [("RiskEscrowRefunded", "observed", False, 5, 0)], "Active — refund observed"),
        ("active", True, [("RiskEscrowSettled", "observed", True, 5, 0)], "Active"),
        ("active", True, [("RiskEscrowSettled", "confirmed", False, 5, 0)], "Active"),
        ("pending", True, [("RiskEscrowCreated", "observed", False, 5, 0)], "Observed — awaiting confirmation"),
        ("pending", True, [("RiskEscrowCreated", "observed", True, 5, 0)], "Submitted — not yet observed"),
        ("pending", False, [], "Pending"),
        ("active", True, [("RiskEscrowRefunded", "observed", False, 5, 1), ("RiskEscrowSettled", "observed", False, 5, 2)], "Active — settlement observed"),
    ],
)
def test_display_status(frame, status, submitted, events, label):
    deals = frame([(1, "c", 1, status, submitted)], "chain_id int, contract_address string, deal_id bigint, status string, has_submitted_tx boolean")
    other = [(1, "d", 1, "RiskEscrowSettled", "observed", False, 9, 0, "t")]
    out = D.display_status(deals, frame([(1, "c", 1, *e, "t") for e in events] + other, LIFE)).first()
    assert out["label"] == label


def test_settlement_amounts_round_the_fee_down(frame):
    rows = [(Decimal(10**16 + 1), Decimal(12 * 10**15), 500), (Decimal(3), Decimal(3), 9999)]
    out = D.settlement_amounts(frame(rows, "notional_units decimal(30,0), collateral_units decimal(30,0), fee_bps int")).collect()
    assert [int(r["platform_fee"]) for r in out] == [(10**16 + 1) * 500 // 10000, 2]
    assert all(r["payout"] + r["platform_fee"] == r["notional_units"] for r in out)


def test_creation_rules(frame):
    at = dt.datetime(2024, 1, 1)
    ok = ("a", "a", "b", Decimal(1), Decimal(2), 3600, "q1", at, at)
    schema = "caller string, depositor string, counterparty string, notional decimal(20,8), required_collateral decimal(20,8), settlement_horizon int, quote_id string, created_at timestamp, quote_expiration timestamp"
    bad = ("x", "a", "a", Decimal(0), Decimal(-1), 3599, "q2", at + dt.timedelta(seconds=1), at)
    out = {r["quote_id"]: r["violations"] for r in D.audit_deals(frame([ok, bad], schema)).collect()}
    assert out["q1"] == [] and len(out["q2"]) == 6
    twice = D.audit_deals(frame([ok, ok], schema)).collect()
    assert all(r["violations"] == ["Risk quote already used"] for r in twice)


def test_refundable_only_after_the_deadline(frame):
    at = dt.datetime(2024, 1, 1)
    deals = frame([(at, 3600, "active"), (at, 3600, "settled")], "created_at timestamp, settlement_horizon int, status string")
    flags = lambda hours: [(r["settleable"], r["refundable"]) for r in D.refundable(deals, F.lit(at + dt.timedelta(hours=hours))).collect()]
    assert flags(1) == [(True, False), (False, False)]
    assert flags(2) == [(True, True), (False, False)]


def test_surplus_never_negative_and_matches_the_native_asset(frame):
    balances = frame([(None, Decimal(5)), ("t", Decimal(5)), ("u", Decimal(5))], "settlement_asset string, balance decimal(20,8)")
    locked = frame([(None, Decimal(3)), ("t", Decimal(9))], "settlement_asset string, locked decimal(38,8)")
    assert {r["settlement_asset"]: int(r["surplus"]) for r in D.asset_surplus(balances, locked).collect()} == {None: 2, "t": 0, "u": 5}


def test_insert_ignore_keeps_the_stored_row(frame):
    schema = "quote_id string, v int, at int"
    out = D.insert_ignore(frame([("a", 1, 0)], schema), frame([("a", 2, 1), ("b", 4, 9), ("b", 3, 2)], schema), "quote_id", ["at"])
    assert sorted((r["quote_id"], r["v"]) for r in out.collect()) == [("a", 1), ("b", 3)]


def test_scope_includes_rows_without_a_chain(frame):
    rows = [(None, None), (1, "c"), (1, "d"), (2, "c")]
    assert D.in_scope(frame(rows, "chain_id int, contract_address string"), 1, "c").count() == 2


@pytest.mark.parametrize("text, ok", [("10.5", True), ("1e5", True), (".5", True), ("0", False), ("-1", False), ("abc", False), ("", False), (None, False), ("NaN", False), ("1" + "0" * 20, True), ("1e-19", True), ("-1e30", False), ("0.0e9", False)])
def test_notional_text(frame, text, ok):
    row = D.validate_requests(frame([(text, "A", 7, 0.99)], "notional_text string, asset string, horizon_days int, confidence double"), ["A"]).first()
    assert (row["reject_reason"] is None) == ok


def one(frame, column, **values):
    names = list(values)
    kinds = {str: "string", int: "bigint", Decimal: "decimal(38,18)", dt.datetime: "timestamp"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())
    return frame([tuple(values[n] for n in names)], schema).select(column.alias("o")).first()["o"]


@pytest.mark.parametrize(
    "text, decimals, mode, want",
    [("10.5", 18, "floor", "10.5"), ("1.239", 2, "floor", "1.23"), ("1.231", 2, "ceil", "1.24"), ("1.230", 2, "ceil", "1.23"), ("1.235", 2, "half_up", "1.24"),
     ("1.2349", 2, "half_up", "1.23"), ("-1.239", 2, "floor", "-1.23"), (" 7 ", 2, "floor", "7"), ("0." + "0" * 20 + "1", 18, "ceil", "0.000000000000000001")],
)
def test_parse_decimal(frame, text, decimals, mode, want):
    assert one(frame, K.parse_decimal(F.col("t"), decimals, mode), t=text) == Decimal(want)


@pytest.mark.parametrize("text", ["1e5", "NaN", "1.", ".5", "", "1,000"])
def test_parse_decimal_refuses(frame, text):
    with pytest.raises(Exception, match="not a valid decimal string"):
        one(frame, K.parse_decimal(F.col("t"), 2), t=text)


def test_base_units_refuse_a_point(frame):
    assert one(frame, K.base_units(F.col("t")), t=" 12 ") == 12
    with pytest.raises(Exception, match="not a valid integer base-units"):
        one(frame, K.base_units(F.col("t")), t="1.5")


@pytest.mark.parametrize("units", [0, 1, -1, 10**18, -15 * 10**17, 123456789012345678901234567])
def test_fixed_point_round_trip(frame, units):
    df = frame([(Decimal(units),)], "u decimal(38,0)")
    amount = K.from_fixed_point(F.col("u"))
    row = df.select(amount.alias("a"), K.to_fixed_point(amount).alias("u")).first()
    assert row["a"] == Decimal(units).scaleb(-18) and int(row["u"]) == units


@pytest.mark.parametrize("mode, want", [("floor", "3.33"), ("ceil", "3.34"), ("half_up", "3.33")])
def test_div_fixed(frame, mode, want):
    assert one(frame, K.div_fixed(F.col("a"), F.lit(3).cast("decimal(2,0)"), 2, mode), a=Decimal(10)) == Decimal(want)


def test_div_by_zero_is_an_error(frame):
    with pytest.raises(Exception, match="(?i)divi"):
        one(frame, K.div_fixed(F.col("a"), F.lit(0).cast("decimal(2,0)"), 2), a=Decimal(10))


@pytest.mark.parametrize(
    "value, low, high, grouping, want",
    [("1234567.891", 2, 2, True, "1,234,567.89"), ("0.995", 2, 2, True, "1.00"), ("5", 0, 6, True, "5"), ("5.10", 0, 6, True, "5.1"), ("5.10", 2, 6, True, "5.10"),
     ("1234.5", 0, 0, True, "1,235"), ("1234.5", 1, 3, False, "1234.5"), ("-0.001", 0, 2, True, "0"), ("-1.5", 0, 2, True, "-1.5"), ("1000", 0, 2, True, "1,000")],
)
def test_format_fixed(frame, value, low, high, grouping, want):
    assert one(frame, K.format_fixed(F.col("a"), low, high, grouping), a=Decimal(value)) == want


@pytest.mark.parametrize("seconds, want", [(0, "0s"), (59, "59s"), (60, "1m"), (3600, "1h 0m"), (102720, "1d 4h 32m"), (86400, "1d 0h 0m"), (-90, "-1m")])
def test_format_duration(frame, seconds, want):
    # Units between the largest and the minutes are always shown.
    assert one(frame, K.format_duration(F.col("s")), s=seconds) == want


def test_other_texts(frame):
    assert one(frame, K.format_fraction(F.col("a")), a=Decimal("0.1834")) == "18.34%"
    assert one(frame, K.format_amount(F.col("a"), "ETH"), a=Decimal("15.1832714")) == "15.183271 ETH"
    assert one(frame, K.format_utc(F.col("t")), t=dt.datetime(2026, 10, 3, 14, 5, 32)) == "2026-10-03 14:05 UTC"
    assert one(frame, K.short_hex(F.col("h")), h="0x" + "ab" * 32) == "0xababab…ababab"
    assert one(frame, K.short_hex(F.col("h")), h="0x12") == "0x12"
    low, high = "0x" + "ab" * 20, "0x" + "AB" * 20
    assert one(frame, K.same_address(F.col("a"), F.col("b")), a=low, b=high) is True
    assert one(frame, K.same_address(F.col("a"), F.col("b")), a="x", b="x") is False
    assert one(frame, K.conf_key(F.lit(0.99)), a="x") == "0.9900"
    now = dt.datetime(2024, 1, 1)
    assert one(frame, K.seconds_remaining(F.col("e"), F.lit(now)), e=now - dt.timedelta(milliseconds=1)) == -1


def test_integers_of_any_length_stay_whole(frame):
    wide = "1234567890" * 5
    cases = {wide: wide, f" -00{wide} ": f"-{wide}", "0": "0", "-000": "0", "007": "7", "1.0": None, "0x1f": None, "": None, "-": None}
    rows = frame([(text,) for text in cases] + [(None,)], "text string")
    got = {r["text"]: r["n"] for r in rows.withColumn("n", K.coerce_integer(F.col("text"))).collect()}
    assert got == {**cases, None: None}


def test_a_timeline_keeps_each_deal_together_and_in_chain_order(spark):
    events = spark.range(0, 600).select(
        F.lit(1).alias("chain_id"), F.lit("c").alias("contract_address"), (F.col("id") % 60).alias("deal_id"),
        (F.lit(1000) - F.col("id")).alias("block_number"), F.lit(0).alias("log_index"), F.concat(F.lit("0x"), F.hex("id")).alias("tx_hash"),
        F.lit("RiskEscrowCreated").alias("event_name"), F.lit("2020-01-01").cast("timestamp_ntz").alias("observed_at"),
        F.lit("observed").alias("confirmation_state"), (F.col("id") % 7 == 0).alias("is_orphaned"),
    )
    rows = D.deal_timeline(events.repartition(11)).select("*", F.spark_partition_id().alias("part")).collect()
    places, blocks = {}, {}
    for r in rows:
        places.setdefault(r.deal_id, set()).add(r.part)
        blocks.setdefault(r.deal_id, []).append(r.block_number)
    assert len(rows) == 600 and all(len(p) == 1 for p in places.values())
    assert all(b == sorted(b) and len(b) == 10 for b in blocks.values())
