from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import RETURNS, garch_returns, series
from tidemark.operators import risk as R, scenarios as S, stats as A

STATE = "asset string, omega double, alpha double, beta double, mu double, latest_variance double, latest_eps2 double, mean_return double, pool array<double>"


def model(frame, pool=(-1.0, 0.0, 1.0), alpha=0.1, beta=0.8, omega=1e-5, variance=4e-4, eps2=1e-4, mu=0.0, mean=0.0):
    return frame([("A", omega, alpha, beta, mu, variance, eps2, mean, list(pool))], STATE)


def test_one_step_draws_come_from_the_pool(frame):
    out = S.scenarios_fhs(model(frame), [1], 3000)
    sigma = np.sqrt(1e-5 + 0.1 * 1e-4 + 0.8 * 4e-4)
    counts = {round(r["log_return"] / sigma, 9) + 0.0: r["count"] for r in out.groupBy("log_return").count().collect()}
    assert set(counts) == {-1.0, 0.0, 1.0}
    assert all(abs(c - 1000) < 150 for c in counts.values())


def test_missing_residual_counts_as_zero(frame):
    a = S.scenarios_fhs(model(frame, eps2=None), [3], 50).orderBy("scenario_id").collect()
    b = S.scenarios_fhs(model(frame, eps2=0.0), [3], 50).orderBy("scenario_id").collect()
    assert a == b


def test_scenarios_do_not_depend_on_partitioning_or_on_other_horizons(frame):
    m = model(frame, pool=np.random.default_rng(1).normal(size=200).tolist())
    key = lambda df: df.where("horizon_days = 5").orderBy("scenario_id").collect()
    first = key(S.scenarios_fhs(m.repartition(1), [5], 600))
    assert first == key(S.scenarios_fhs(m.repartition(17), [1, 5, 9], 600))
    assert first != key(S.scenarios_fhs(m, [5], 600, seed=7))


def test_path_equals_a_plain_loop(frame):
    import hashlib

    def mix(h):
        h ^= h >> 16
        h = h * 0x85EBCA6B % 2**32
        h ^= h >> 13
        h = h * 0xC2B2AE35 % 2**32
        return h ^ (h >> 16)

    pool = np.random.default_rng(2).normal(size=50)
    got = {r["scenario_id"]: r["log_return"] for r in S.scenarios_fhs(model(frame, pool.tolist(), mu=1e-3), [6], 40).collect()}
    key = int(hashlib.md5(b"42#fhs#A").hexdigest()[:8], 16)
    for s in range(40):
        s2, e2, total = 4e-4, 1e-4, 0.0
        for t in range(6):
            word = mix(mix(key ^ s) ^ ((t + 1) * 0x9E3779B9 % 2**32))
            z = pool[int((word + 0.5) / 2**32 * len(pool))]
            s2 = 1e-5 + 0.1 * e2 + 0.8 * s2
            eps = z * np.sqrt(s2)
            e2, total = eps * eps, total + 1e-3 + eps
        assert got[s] == pytest.approx(total, abs=1e-13)


def test_uniforms_are_uniform_and_uncorrelated():
    from tidemark.functions.counter_rng import uniforms

    u = np.array([uniforms(12345, np.arange(20000), t) for t in range(20)])
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    counts = np.histogram(u, bins=100, range=(0, 1))[0]
    assert ((counts - 4000) ** 2 / 4000).sum() < 160  # chi-square with 99 degrees of freedom
    between_steps = np.corrcoef(u)[np.triu_indices(20, 1)]
    assert np.abs(between_steps).max() < 0.04 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01


def test_gbm_moments_and_monotone_tails(frame):
    m = model(frame, mean=0.001)
    out = S.scenarios_gbm(m, [1, 30], 20000)
    row = out.where("horizon_days = 30").agg(F.avg("log_return"), F.stddev_samp("log_return")).first()
    assert row[0] == pytest.approx((0.001 - 4e-4 / 2) * 30, abs=3e-3)
    assert row[1] == pytest.approx(np.sqrt(4e-4 * 30), rel=0.03)
    tails = A.tail_measures(out.withColumn("x", F.expm1("log_return")), ["horizon_days"], "x", [0.95, 0.99])
    es = {(r["horizon_days"], r["confidence"]): r["expected_shortfall"] for r in tails.collect()}
    assert es[1, 0.95] < es[1, 0.99] < es[30, 0.99] and es[30, 0.95] < es[30, 0.99]


def test_arguments_are_checked(frame):
    for bad in (lambda: S.scenarios_fhs(model(frame), [0]), lambda: S.scenarios_fhs(model(frame), [1], 0), lambda: R.stress_gap_down(model(frame), [1], [1.0])):
        with pytest.raises(ValueError):
            bad()


def test_extended_horizon_is_longer_and_rounded_half_even():
    assert R.extended_horizons([1, 7, 14, 30]) == {1: 2, 7: 14, 14: 28, 30: 60}
    assert R.extended_horizons([1, 5], 1.5) == {1: 2, 5: 8} and R.extended_horizons([3], 1.5) == {3: 4}


COLLATERAL = "notional decimal(20,8), es_loss decimal(14,12), stress_loss decimal(14,12)"


def decide(frame, notional, es, stress, policy=R.CollateralPolicy()):
    return R.collateral_decision(frame([(Decimal(notional), Decimal(es), Decimal(stress))], COLLATERAL), policy).first()


def test_collateral_is_the_larger_loss(frame):
    row = decide(frame, "10", "0.2", "0.5")
    assert row["required_collateral"] == Decimal("15") and row["loss_basis_source"] == "stress" and row["collateral_buffer"] == Decimal("5")
    assert decide(frame, "10", "0.5", "0.5")["loss_basis_source"] == "expected_shortfall"


def test_collateral_bounds(frame):
    low = decide(frame, "10", "0", "0", R.CollateralPolicy(min_collateral_ratio="1.20"))
    assert low["required_collateral"] == Decimal("12") and low["floored"] and not low["capped"]
    high = decide(frame, "10", "9", "0")
    assert high["required_collateral"] == Decimal("50") and high["capped"]


def test_collateral_is_rounded_up(frame):
    row = decide(frame, "0.00000001", "0.000000000001", "0")
    assert row["required_collateral"] == Decimal("0.000000010000000001")
    with pytest.raises(Exception, match="notional must be positive"):
        decide(frame, "0", "0", "0")
    losses = frame([(0.1 + 2e-13,), (0.3,)], "x double").select(R.loss_decimal(F.col("x")).alias("d"))
    assert [r["d"] for r in losses.collect()] == [Decimal("0.100000000001"), Decimal("0.300000000000")]


def test_snapshot_agrees_with_its_parts(spark, frame):
    returns = frame(series(garch_returns(900)), RETURNS)
    params = frame([("A", 1.5e-5, 0.08, 0.88, 0.0)], "asset string, omega double, alpha double, beta double, mu double")
    m = S.scenario_model(returns, params, window=750)
    snap = {r["horizon_days"]: r for r in R.risk_snapshot(returns, m, [1, 7], n_scenarios=500).collect()}
    tails = A.tail_measures(R.losses_by_method(returns, m, [1, 7, 14, 2], [S.FILTERED_HISTORICAL], 500, 42), ["asset", "horizon_days"], "x", [0.99])
    summary = R.stress_summary(returns, m, tails, [1, 7], n_scenarios=500)
    worst = {h: max(r["loss_fraction"] for r in summary.where(f"horizon_days = {h}").collect()) for h in (1, 7)}
    for h in (1, 7):
        es = tails.where(f"horizon_days = {h}").first()["expected_shortfall"]
        assert float(snap[h]["loss_basis"]) == pytest.approx(max(es, worst[h]), abs=2e-12)
        assert float(snap[h]["collateral_ratio"]) == pytest.approx(1 + max(es, worst[h]), abs=2e-12)
    assert worst[1] >= 0.5  # the 50 % gap is always among the scenarios


def test_snapshot_hash_refuses_floats_and_ignores_field_order(frame):
    df = frame([(Decimal("1.5"), "A")], "b decimal(20,8), a string")
    one, two = (R.snapshot_hash(df, f).first() for f in (["a", "b"], ["b", "a"]))
    assert one["snapshot_json"] == '{"a":"A","b":"1500000000000000000"}' and one["snapshot_hash"] == two["snapshot_hash"]
    with pytest.raises(TypeError):
        R.snapshot_hash(frame([(1.0,)], "x double"), ["x"])


def test_residual_pool_spans_the_history_unless_told(frame):
    returns = frame(series(garch_returns(800)), RETURNS)
    params = frame([("A", 1.5e-5, 0.08, 0.88, 0.0)], "asset string, omega double, alpha double, beta double, mu double")
    assert len(S.scenario_model(returns, params).first()["pool"]) == 800
    assert len(S.scenario_model(returns, params, residual_pool_window=100).first()["pool"]) == 100


def test_requests_without_price_or_terms_come_out_with_a_reason(frame):
    requests = frame([(1, "A", 7), (2, "A", 9), (3, "B", 7), (4, None, 7), (5, "C", 7), (5, "C", 7)], "request_id int, asset string, horizon_days int")
    snapshot = frame([("A", 7), ("A", 7), ("B", 7)], "asset string, horizon_days int")
    spots = frame([("A", 1.0), ("C", 2.0)], "asset string, spot_price_usd double")
    got = sorted((r.request_id, r.reason) for r in R.unpriced_requests(requests, snapshot, spots).collect())
    no_terms = "no terms for the horizon"
    assert got == [(2, no_terms), (3, "no spot price"), (4, "no spot price"), (5, no_terms), (5, no_terms)]
