from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import with_previous
from tidemark.functions.uint256 import decimal_text, hex_word
from tidemark.operators import ledger as L

OBS = (
    "chain_id int, contract_address string, block_number bigint, block_hash string, tx_hash string, tx_index int, log_index int, "
    "event_name string, deal_id bigint, observed_at timestamp, ord1 bigint, ord2 bigint"
)
T0 = dt.datetime(2024, 1, 1)


CANONICAL = "chain_id int, block_number bigint, block_hash string"


def seen(block, block_hash, tx="t1", log=0, at=0, contract="c", event="RiskEscrowCreated", order=0, chain=1):
    return (chain, contract, block, block_hash, tx, 0, log, event, 7, T0 + dt.timedelta(hours=at), order, 0)


def outcomes(frame, rows):
    out = L.observation_outcomes(frame(rows, OBS))
    return out, [(r["outcome"], r["n_observations"]) for r in out.orderBy("observed_at", "ord1", F.desc("n_observations")).collect()]


def test_same_block_is_ignored_and_another_block_replaces(frame):
    out, got = outcomes(frame, [seen(5, "a", at=0), seen(5, "a", at=30), seen(6, "b", at=60), seen(6, "b", at=61), seen(5, "a", at=90)])
    assert [o for o, _ in got] == ["inserted", "duplicate_ignored", "updated_reorg", "duplicate_ignored", "updated_reorg"]
    held = L.observation_current(out).collect()
    assert len(held) == 1 and (held[0]["block_number"], held[0]["block_hash"]) == (5, "a")


def test_exact_copies_are_reported_with_their_number(frame):
    _, got = outcomes(frame, [seen(5, "a")] * 1000)
    assert sorted(got) == [("duplicate_ignored", 999), ("inserted", 1)]


def test_identity_is_chain_transaction_and_log(frame):
    _, got = outcomes(frame, [seen(5, "a"), seen(5, "a", log=1), seen(5, "a", tx="t2")])
    assert [o for o, _ in got] == ["inserted"] * 3


def held_by_identity(df):
    return sorted(map(str, df.collect()))


def test_busy_identities_have_the_same_outcomes(frame):
    rows = [seen(b, h, tx=tx, at=at, order=b) for tx in ("t1", "t2", None) for at, b, h in (
        (0, 1, "a"), (0, 1, "a"), (30, 1, "a"), (40, 2, "b"), (41, 3, None), (41, 3, None), (90, 1, "a"), (95, 1, "a"),
    )] + [seen(4, "a", tx="t3")]
    usual, busy = L.observation_outcomes(frame(rows, OBS)), L.observation_outcomes(frame(rows, OBS), 2)
    assert held_by_identity(usual) == held_by_identity(busy)
    assert sum(r["n_observations"] for r in busy.collect()) == len(rows)
    assert held_by_identity(L.observation_current(usual)) == held_by_identity(L.observation_current(busy))


def shuffles(df):
    """The exchanges of the plan that run-time re-planning starts from."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_observations_travel_once(frame):
    out = L.observation_outcomes(frame([seen(5, "a"), seen(6, "b", tx="t2")], OBS))
    assert shuffles(out) == 1
    assert shuffles(L.observation_current(out)) == 1
    assert shuffles(L.mark_current(out)) == 1


def test_a_written_mismatch_is_met_without_a_shuffle(spark, frame, tmp_path):
    frame([seen(b, "h" if b != 4 else "x", tx=f"t{b}", at=b) for b in range(9)], OBS).write.parquet(str(tmp_path / "rows"))
    events = L.as_observed(spark.read.parquet(str(tmp_path / "rows")))
    canonical = frame([(1, b, "h") for b in range(9)], CANONICAL)
    mismatch = L.first_mismatch(events, canonical, 2)
    mismatch.write.parquet(str(tmp_path / "mismatch"))
    written = L.confirm_blocks(events, canonical, 2, spark.read.parquet(str(tmp_path / "mismatch")))
    assert shuffles(written) == 0
    assert held_by_identity(written) == held_by_identity(L.confirm_blocks(events, canonical, 2))


def test_previous_value_across_buckets(frame):
    rows = [("k", i, f"v{i}") for i in range(50)] + [("z", 3, "only")]
    df = frame(rows, "k string, i int, v string")
    out = with_previous(df, ["k"], F.floor(F.col("i") / 7), ["i"], "v", "before")
    got = {(r["k"], r["i"]): r["before"] for r in out.collect()}
    assert got[("z", 3)] is None and got[("k", 0)] is None
    assert all(got[("k", i)] == f"v{i - 1}" for i in range(1, 50))


@pytest.mark.parametrize("last, depth, start, target", [(100, 5, 0, 95), (100, 0, 0, 99), (10, 5, 8, 8), (3, 5, 0, 0)])
def test_rewind_target(frame, last, depth, start, target):
    checkpoints = frame([(1, "c", last, "stale", last)], "chain_id int, contract_address string, last_scanned_block bigint, last_scanned_block_hash string, last_confirmed_block bigint")
    canonical = frame([(1, last, "real"), (1, target, "at"), (2, last, "stale")], CANONICAL)
    row = L.reconcile_frontier(checkpoints, canonical, depth, start).first()
    assert row["reorg"] and row["last_scanned_block"] == target and row["last_confirmed_block"] == target
    assert row["last_scanned_block_hash"] == (None if target == 0 else "at")
    same = L.reconcile_frontier(checkpoints.withColumn("last_scanned_block_hash", F.lit("real")), canonical, depth, start).first()
    assert not same["reorg"] and same["last_scanned_block"] == last
    fresh = L.reconcile_frontier(checkpoints.withColumn("last_scanned_block_hash", F.lit("")), canonical, depth, start).first()
    assert not fresh["reorg"]


def confirm(frame, rows, canonical, depth=2):
    events = L.as_observed(frame(rows, OBS))
    out = L.confirm_blocks(events, frame([c if len(c) == 3 else (1, *c) for c in canonical], CANONICAL), depth)
    return {(r["contract_address"], r["block_number"]): (r["confirmation_state"], r["is_orphaned"]) for r in out.collect()}


def test_confirmation_stops_at_the_first_mismatch_of_a_contract(frame):
    rows = [seen(b, "h" if b != 3 else "stale", tx=f"t{b}") for b in range(1, 6)] + [seen(b, "h", tx=f"u{b}", contract="d") for b in (3, 6, 7)]
    got = confirm(frame, rows, [(b, "h") for b in range(1, 9)])
    assert got["c", 1] == got["c", 2] == ("confirmed", False)
    assert got["c", 3] == got["c", 4] == got["c", 5] == ("observed", True)
    assert got["d", 3] == got["d", 6] == ("confirmed", False) and got["d", 7] == ("observed", False)


def test_chains_are_judged_by_their_own_blocks_and_head(frame):
    rows = [seen(b, "h", tx=f"t{b}") for b in (1, 7)] + [seen(b, "g", tx=f"u{b}", contract="d", chain=2) for b in (1, 3)]
    got = confirm(frame, rows, [(1, b, "h") for b in range(1, 10)] + [(2, b, "g") for b in range(1, 5)])
    assert got == {
        ("c", 1): ("confirmed", False), ("c", 7): ("confirmed", False), ("d", 1): ("confirmed", False), ("d", 3): ("observed", False)
    }


def test_orphaning_reaches_confirmed_rows_and_says_so(frame):
    events = L.as_observed(frame([seen(3, "stale", tx="a"), seen(4, "h", tx="b")], OBS)).withColumn(
        "confirmation_state", F.when(F.col("tx_hash") == "b", "confirmed").otherwise("observed")
    )
    out = L.confirm_blocks(events, frame([(1, b, "h") for b in range(1, 9)], CANONICAL), 2)
    row = out.where("tx_hash = 'b'").first()
    assert row["is_orphaned"] and row["was_confirmed"]


def test_ranges(frame):
    out = L.split_range(frame([(1, "c", 10, 27), (1, "d", 5, 4)], "chain_id int, contract_address string, from_block bigint, to_block bigint"), 5, 3)
    assert sorted((r["chunk_from"], r["chunk_to"]) for r in out.collect()) == [(10, 14), (15, 19), (20, 24)]


EVENTS = "chain_id int, contract_address string, deal_id bigint, quote_id string, event_name string, at int, notional decimal(20,8)"


def derive(frame, events, pending=()):
    rows = lambda table, at: [(*r[:at], Decimal(r[at]), *r[len(r) + at + 1 if at < 0 else at + 1 :]) for r in table]
    out = L.derive_deals(frame([e if len(e) == 7 else (1, "c", *e) for e in rows(events, -1)], EVENTS), frame(rows(pending, 1), "quote_id string, notional decimal(20,8), status string"), ["at"], ["notional"])
    return {r["quote_id"]: (r["status"], r["deal_id"]) for r in out.collect()}


def test_first_terminal_event_after_the_last_created_wins(frame):
    c, s, r = "RiskEscrowCreated", "RiskEscrowSettled", "RiskEscrowRefunded"
    got = derive(frame, [
        (1, "q1", c, 1, 1), (1, "q1", s, 2, 1), (1, "q1", r, 3, 1),
        (2, "q2", c, 1, 1), (2, "q2", r, 2, 1),
        (3, "q3", s, 1, 1), (3, "q3", c, 2, 1),
        (4, "q4", c, 1, 1), (4, "q4", s, 2, 1), (4, "q4", c, 3, 1),
    ], [("q1", 9, "pending"), ("q9", 9, "pending")])
    assert got == {"q1": ("settled", 1), "q2": ("refunded", 2), "q3": ("active", 3), "q4": ("active", 4), "q9": ("pending", None)}


def test_equal_deal_ids_of_two_contracts_stay_apart(frame):
    c, s = "RiskEscrowCreated", "RiskEscrowSettled"
    got = derive(frame, [(1, "c", 1, "q1", c, 1, 1), (1, "d", 1, "q2", c, 1, 1), (2, "c", 1, "q3", c, 1, 1), (1, "c", 1, "q1", s, 2, 1)])
    assert {q: status for q, (status, _) in got.items()} == {"q1": "settled", "q2": "active", "q3": "active"}


def test_config_state_keeps_the_last_value_of_each_field(frame):
    columns = "chain_id int, contract_address string, block_number bigint, tx_index int, log_index int, tx_hash string, event_name string, decoded map<string,string>"
    fee = lambda block, value: (1, "c", block, 0, 0, "t", "PlatformFeeUpdated", {"newFeeBps": value})
    only_fee = L.config_state(frame([fee(1, "500"), fee(5, "750")], columns)).first()
    assert (only_fee["platform_fee_bps"], only_fee["risk_oracle"], only_fee["updated_at_block"]) == ("750", None, 5)
    oracle = L.config_state(frame([(1, "c", 9, 0, 0, "t", "RiskOracleUpdated", {"newOracle": "o"}), fee(5, "750")], columns)).first()
    assert (oracle["risk_oracle"], oracle["platform_fee_bps"], oracle["updated_at_block"]) == ("o", "750", 9)


@pytest.mark.parametrize("value", [0, 1, 2**32, 2**63, 2**64 - 1, 2**64, 10**18 * 2**64, 10**18 * 2**64 + 1, 2**123, 2**124 - 1, 2**124, 10**38, 2**255 + 12345678901234567890, 2**256 - 1])
def test_uint256_text(frame, value):
    assert frame([(f"{value:064x}",)], "w string").select(F.expr(decimal_text("w")).alias("d")).first()["d"] == str(value)


def test_hex_word_round_trip(frame):
    amounts = [0, 1, 2**32, 10**18, 123456789 * 10**18]
    df = frame([(Decimal(a),) for a in amounts], "a decimal(38,0)").select("a", hex_word(F.col("a")).alias("w"))
    assert all(int(r["w"], 16) == int(r["a"]) and len(r["w"]) == 64 for r in df.collect())


def test_field_errors(frame):
    whole = {"previousFeeBps": "1", "newFeeBps": "2"}
    rows = [("PlatformFeeUpdated", whole), ("PlatformFeeUpdated", {"previousFeeBps": "1"}), ("PlatformFeeUpdated", whole | {"newFeeBps": "x"})]
    events = frame(rows, "event_name string, decoded map<string,string>")
    assert [r["reason"] for r in L.invalid_events(events).collect()] == ['missing field "newFeeBps"', 'field "newFeeBps": invalid decimal integer "x"']
    assert L.valid_events(events).count() == 1


@pytest.mark.parametrize(
    "rpc_age, error, lag, depth, health",
    [(5, None, 5, 5, "healthy"), (61, None, 5, 5, "degraded"), (61, "boom", 5, 5, "degraded"), (None, None, 5, 5, "degraded"),
     (5, "old error", 15, 5, "healthy"), (5, None, 16, 5, "lagging"), (5, None, 5, None, "unreachable")],
)
def test_health(frame, rpc_age, error, lag, depth, health):
    rpc = None if rpc_age is None else T0 - dt.timedelta(seconds=rpc_age)
    row = L.classify_health(frame([(rpc, error, lag, depth, T0)], "last_successful_rpc_call timestamp, last_error string, confirmed_lag_blocks bigint, confirmation_depth int, now timestamp")).first()
    assert row["health"] == health
    if error == "boom":
        assert row["detail"] == "Last error: boom"
