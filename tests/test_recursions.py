from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import RETURNS, TRUE_GARCH, garch_loop, garch_returns, series, values
from tidemark.functions.affine import affine_scan
from tidemark.operators import garch as G, series as S
from tidemark.operators.prices import tail_n, with_oos


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 4, 5, 37, 130])
def test_scan_equals_loop(frame, levels, n):
    rng = np.random.default_rng(n)
    a, b = rng.uniform(0, 1, n), rng.normal(size=n)
    rows = [("k", i, float(a[i]), float(b[i])) for i in range(n)] + [("other", 0, 0.5, 2.0)]
    df = frame(rows, "k string, i bigint, a double, b double")
    out = affine_scan(df, ["k"], "i", "a", "b", "v", prev="before", chunk_rows=4, levels=levels)
    expected, v = [], 0.0
    for x, y in zip(a, b):
        v = v * x + y
        expected.append(v)
    got = out.where("k = 'k'")
    np.testing.assert_allclose(values(got, "v", "i"), expected, rtol=1e-12)
    np.testing.assert_allclose(values(got, "before", "i"), [0.0, *expected[:-1]], rtol=1e-12)
    assert out.where("k = 'other'").first()["v"] == 2.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-0.3, 0.3), min_size=2, max_size=40), st.floats(0.01, 0.99))
def test_ewma_equals_loop(frame, r, lam):
    out = values(S.ewma_variance(frame(series(r), RETURNS), lam), "ewma_variance")
    v, expected = float(np.var(r, ddof=1)), []
    for x in r:
        v = lam * v + (1 - lam) * x * x
        expected.append(v)
    np.testing.assert_allclose(out, expected, rtol=1e-9, atol=1e-15)


def test_lambda_is_checked(frame):
    with pytest.raises(ValueError):
        S.ewma_variance(frame(series([0.1]), RETURNS), 1.0)


def with_params(df, omega=1e-5, alpha=0.1, beta=0.85, mu=0.0):
    return df.select("*", F.lit(omega).alias("omega"), F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), F.lit(mu).alias("mu"))


@pytest.mark.parametrize("beta", [0.5, 0.9, 0.9999])
def test_garch_path_equals_loop_also_near_integration(frame, beta):
    r = garch_returns(400)
    alpha = min(0.08, 1 - beta)
    path = values(S.garch_variance_path(with_params(frame(series(r), RETURNS), 1e-6, alpha, beta, 1e-4)), "sigma2")
    assert np.isfinite(path).all()
    np.testing.assert_allclose(path, garch_loop(r, 1e-6, alpha, beta, 1e-4), rtol=1e-10)


def test_paths_do_not_depend_on_partitioning(frame):
    df = with_params(frame(series(garch_returns(300)), RETURNS))
    one = values(S.garch_variance_path(df.repartition(1)), "sigma2")
    many = values(S.garch_variance_path(df.repartition(17), levels=2), "sigma2")
    np.testing.assert_array_equal(np.round(one, 14), np.round(many, 14))


def test_forecasts_do_not_look_ahead(frame):
    r = garch_returns(850)
    changed = r.copy()
    changed[830:] = 5.0
    for build, column in (
        (lambda d: S.rolling_variance_forecast(d, 30), "rolling_forecast"),
        (lambda d: S.ewma_variance_forecast(with_oos(d, fitting_window=600)), "ewma_forecast"),
    ):
        a, b = (values(build(frame(series(x), RETURNS)).where("idx <= 830 and idx > 700"), column) for x in (r, changed))
        np.testing.assert_allclose(a, b, rtol=1e-12)


def test_planted_crash_is_the_worst_case(frame):
    r = np.zeros(100)
    r[50:53] = -0.10
    worst = S.historical_worst_case(frame(series(r), RETURNS), [3]).first()
    assert worst["loss_fraction"] == pytest.approx(1 - np.exp(-0.3))
    assert (worst["window_end"] - worst["window_start"]).days == 2


def test_horizon_windows(frame):
    df = frame(series([0.1, 0.2, 0.3, 0.4]), RETURNS)
    rows = S.historical_horizon_returns(df, [1, 3]).where("horizon_days = 3").orderBy("idx").collect()
    assert [round(x["log_return"], 12) for x in rows] == [0.6, 0.9]
    with pytest.raises(ValueError):
        S.historical_horizon_returns(df, [0])
    with pytest.raises(Exception, match="fewer than 7"):
        S.historical_horizon_returns(df, [7], strict=True).collect()


def test_state_then_updates_equals_one_path(frame):
    r = garch_returns(300)
    df = with_params(frame(series(r), RETURNS), 1e-6, 0.08, 0.9, 0.0)
    state = G.fit_state(S.garch_variance_path(df.where("idx < 200")))
    later = values(G.apply_updates(state, df.select("asset", "day", "idx", "r")), "sigma2", "day")
    seed = float(np.var(r[:200], ddof=1))
    np.testing.assert_allclose(later, garch_loop(r, 1e-6, 0.08, 0.9, 0.0, seed)[200:], rtol=1e-9)


def test_forecast_closed_form_matches_recursion_at_any_persistence(frame):
    for alpha, beta in ((0.1, 0.8), (0.3, 0.7), (0.3, 0.8)):
        state = frame([("A", 1e-5, alpha, beta, 0.0, 4e-4, 1e-4)], "asset string, omega double, alpha double, beta double, mu double, latest_variance double, latest_eps2 double")
        got = values(G.garch_forecast(state, 10), "variance", "step")
        v, expected = 1e-5 + alpha * 1e-4 + beta * 4e-4, []
        for _ in range(10):
            expected.append(v)
            v = 1e-5 + (alpha + beta) * v
        np.testing.assert_allclose(got, expected, rtol=1e-10)
        summary = G.garch_summary(state).first()
        assert (summary["unconditional_variance"] is None) == (alpha + beta >= 1)


def test_fit_recovers_parameters(frame):
    fitted = G.fit_garch(frame(series(garch_returns(3000)), RETURNS)).first()
    assert fitted["converged"]
    assert abs(fitted["alpha"] - TRUE_GARCH["alpha"]) < 0.05
    assert abs(fitted["beta"] - TRUE_GARCH["beta"]) < 0.08
    assert fitted["aic"] == pytest.approx(8 - 2 * fitted["log_likelihood"])
    with pytest.raises(Exception, match="at least 30"):
        G.fit_garch(frame(series(np.ones(10)), RETURNS)).collect()


def test_tail_and_refit_due(frame):
    df = frame(series(np.arange(30)), RETURNS)
    last = tail_n(df, 5).orderBy("idx").collect()
    assert [x["idx"] for x in last] == [0, 1, 2, 3, 4] and last[0]["full_idx"] == 25
    ends = df.where("idx = 8 or idx = 9").select("asset", F.col("day").alias("fit_end"))
    due = {x["n_updates"]: x["refit_due"] for x in G.refit_due(ends, df).collect()}
    assert due == {21: True, 20: False}


def test_too_little_data_is_an_error(frame):
    with pytest.raises(Exception, match="not enough data"):
        with_oos(frame(series(np.ones(760)), RETURNS)).collect()
    assert with_oos(frame(series(np.ones(760)), RETURNS), strict=False).count() == 0
