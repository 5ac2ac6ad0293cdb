from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import RETURNS, START, series
from tidemark.functions import tails as T
from tidemark.operators import prices as P, quality as Q, stats as A
from tidemark.sources import model_state as M, tables

PRICES = tables.PRICE_SCHEMA
DAY = dt.timedelta(days=1)


def candles(n=60, asset="A"):
    rng = np.random.default_rng(1)
    close = 2000 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [(asset, START + i * DAY, float(c), float(c * 1.01), float(c * 0.99), float(c), 10.0, i) for i, c in enumerate(close)]


def report(frame, rows):
    return Q.data_quality(frame(rows, PRICES)).first()


def edit(rows, at, **changes):
    names = ["asset", "day", "open", "high", "low", "close", "volume", "ingest_seq"]
    row = dict(zip(names, rows[at])) | changes
    return rows[:at] + [tuple(row.values())] + rows[at + 1 :]


def test_clean_series_is_valid(frame):
    r = report(frame, candles())
    assert r["is_valid"] and r["errors"] == [] and r["warnings"] == [] and r["n_rows"] == 60


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda r: r + [(*r[5][:7], 99)], "1 duplicate timestamp(s) in index"),
        (lambda r: edit(r, 7, ingest_seq=1000), "index is not sorted ascending"),
        (lambda r: edit(r, 7, close=float("nan")), "NaN values present in columns: ['close']"),
        (lambda r: edit(r, 7, open=None), "NaN values present in columns: ['open']"),
        (lambda r: edit(r, 7, close=-1.0), "non-positive price(s) found in OHLC columns"),
        (lambda r: edit(r, 7, volume=-1.0), "negative volume(s) found"),
        (lambda r: edit(r, 7, high=1.0, low=2.0), "1 row(s) where high < low"),
    ],
)
def test_each_fault_is_an_error(frame, change, message):
    r = report(frame, change(candles()))
    assert message in r["errors"] and not r["is_valid"]
    with pytest.raises(Exception, match="data quality check failed"):
        Q.require_valid(Q.data_quality(frame(change(candles()), PRICES))).collect()


def test_gaps_and_spikes_are_warnings(frame):
    rows = candles()
    gap = report(frame, rows[:20] + rows[21:])
    assert gap["is_valid"] and gap["warnings"][0].startswith("1 missing date(s)")
    spiked = edit(rows, 30, close=rows[30][5] * 5, high=rows[30][5] * 6)
    spike = report(frame, spiked)
    assert spike["is_valid"] and spike["warnings"][0].startswith("2 day(s) with |log return| > 0.5")


def test_absent_asset_and_missing_column(spark, frame):
    requested = frame([("A",), ("Z",)], "asset string")
    rows = {r["asset"]: r for r in Q.data_quality(frame(candles(), PRICES), requested).collect()}
    assert rows["Z"]["errors"] == ["data is empty"] and rows["A"]["is_valid"]
    short = Q.data_quality(frame(candles(), PRICES).drop("volume")).first()
    assert short["errors"] == ["missing columns: ['volume']"] and not short["is_valid"]


def test_inversions_are_counted_across_slices(frame, monkeypatch):
    monkeypatch.setattr(Q, "ARRIVAL_SLICE", 4)
    days = [0, 1, 2, 3, 2, 5, 6, 4, 3, 9]
    rows = [("A", START + d * DAY, 1.0, 1.0, 1.0, 1.0, 1.0, i) for i, d in enumerate(days)]
    assert Q.arrival_inversions(frame(rows, PRICES)).first()["n_inversions"] == sum(b < a for a, b in zip(days, days[1:]))


def test_log_returns_leave_out_days_without_price(frame):
    day = lambda d: dt.date(2020, 1, d)
    rows = [("A", day(1), None), ("A", day(2), 1.0), ("A", day(3), float("nan")), ("A", day(4), 2.0), ("A", day(5), 1.0)]
    got = P.log_returns(frame(rows, "asset string, day date, close double")).orderBy("day").collect()
    assert [(r["day"], r["idx"]) for r in got] == [(day(4), 0), (day(5), 1)]
    assert [round(r["r"], 9) for r in got] == [0.693147181, -0.693147181]


def test_log_returns(frame):
    rows = [("A", START + i * DAY, 1.0, 1.0, 1.0, p, 1.0, i) for i, p in enumerate([100.0, 110.0, 99.0])]
    out = P.log_returns(frame(rows, PRICES)).orderBy("idx").collect()
    assert [x["idx"] for x in out] == [0, 1]
    assert out[0]["r"] == pytest.approx(math.log(1.1)) and out[1]["r"] == pytest.approx(math.log(0.9))
    with pytest.raises(Exception, match="strictly positive"):
        P.log_returns(frame(edit(rows, 1, close=0.0), PRICES)).collect()


def test_candles_keep_the_first_arrival(frame):
    raw = frame([("A", 86400, 2, 9.0, 9.0, 9.0, 9.0, 9.0), ("A", 86400, 1, 5.0, 5.0, 5.0, 5.0, 5.0)], "asset string, time bigint, seq int, open double, high double, low double, close double, volume double")
    out = P.normalize_candles(raw, ["seq"]).collect()
    assert len(out) == 1 and out[0]["close"] == 5.0 and out[0]["day"] == dt.date(1970, 1, 2)


def test_missing_ranges(frame):
    held = frame(candles(10), PRICES)
    ask = lambda a, s, e, refresh=False: (a, START + s * DAY, START + e * DAY, refresh)
    requests = frame([ask("A", -5, 20), ask("A", 0, 10), ask("A", 2, 5, True), ask("B", 0, 3)], "asset string, start_day date, end_day date, refresh boolean")
    got = {(r["asset"], r["gap"], (r["from_day"] - START).days, (r["to_day"] - START).days) for r in P.plan_missing_ranges(held, requests).collect()}
    assert got == {("A", "head", -5, 0), ("A", "tail", 10, 20), ("A", "whole", 2, 5), ("B", "whole", 0, 3)}


def test_upsert_and_partitioned_storage(spark, frame, tmp_path):
    old = frame(candles(10) + candles(10, "B"), PRICES)
    new = frame(edit(candles(10), 3, close=7.0)[3:4], PRICES)
    merged = P.upsert_prices(old, new)
    path = str(tmp_path / "prices")
    tables.write_table(merged, path, "prices", "overwrite")
    tables.write_table(frame(edit(candles(2), 0, close=3.0), PRICES), path, "prices", "overwrite")
    assert tables.read_table(spark, path, "prices").where("asset = 'B'").count() == 10
    scan = tables.load_prices(spark, path, "B", START + 2 * DAY, START + 4 * DAY)
    assert scan.count() == 3
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(day" in plan
    assert merged.where(F.col("day") == F.lit(START + 3 * DAY)).where("asset = 'A'").first()["close"] == 7.0


def test_model_state_round_trip(spark, tmp_path):
    row = lambda day, fit: (
        "A", "garch_1_1", "v1", START, START, 750, {"alpha": 0.1}, {"aic": 1.0}, dt.datetime(2020, 1, 1), 0.5 + day, START + day * DAY, None,
        {"dist": "normal"}, fit, dt.datetime(2020, 1, 1 + day),
    )
    path = str(tmp_path / "states")
    for day, fit in ((0, True), (1, False), (2, False)):
        M.append_state(spark.createDataFrame([row(day, fit)], M.MODEL_STATE_SCHEMA), path)
    states = M.read_state(spark, path)
    latest = M.latest_state(states).collect()
    assert len(latest) == 1 and latest[0]["latest_conditional_variance"] == 2.5 and latest[0]["fitted_params"] == {"alpha": 0.1}
    assert M.state_history(states).count() == 1


def test_var_and_es_match_numpy(frame):
    rng = np.random.default_rng(3)
    x = rng.normal(size=997)
    df = frame([("g", float(v)) for v in x], "k string, x double")
    row = A.tail_measures(df, ["k"], "x", [0.95]).first()
    q = np.quantile(x, 1 - 0.95)
    assert row["value_at_risk"] == pytest.approx(max(-q, 0)) and row["expected_shortfall"] == pytest.approx(-x[x <= q].mean())
    assert row["p25"] == pytest.approx(np.percentile(x, 25))
    gain = A.tail_measures(frame([("g", float(abs(v))) for v in x], "k string, x double"), ["k"], "x", [0.99]).first()
    assert gain["value_at_risk"] == 0 and gain["expected_shortfall"] == 0
    with pytest.raises(ValueError):
        A.value_at_risk(df, ["k"], "x", [1.0])


@pytest.mark.parametrize("n, x, lr, reject", [(1000, 10, 0.0, False), (1000, 100, None, True), (500, 0, 10.0503, True), (10, 10, 92.1034, True)])
def test_kupiec_cases(frame, n, x, lr, reject):
    row = A.kupiec(frame([(n, x, 0.99)], "n_obs bigint, n_exceedances bigint, confidence double")).first()
    assert row["reject_at_5pct"] is reject and math.isfinite(row["lr_statistic"])
    if lr is not None:
        assert row["lr_statistic"] == pytest.approx(lr, abs=1e-3)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(row["lr_statistic"] / 2)), abs=1e-12)


def test_distribution_functions(frame):
    xs = [0.0, 0.1, 1.0, 2.5, 4.0, 6.0, 9.0]
    got = frame([(x,) for x in xs], "x double").select("x", T.erfc(F.col("x")).alias("e"), T.chi2_sf_even(F.col("x"), 4).alias("c"))
    for row in got.collect():
        assert row["e"] == pytest.approx(math.erfc(row["x"]), abs=1e-14)
        assert row["c"] == pytest.approx(math.exp(-row["x"] / 2) * (1 + row["x"] / 2))
    q = frame([(0.001,), (0.5,), (0.975,)], "p double").select(T.normal_quantile(F.col("p")).alias("q"))
    assert [round(r["q"], 6) for r in q.collect()] == [-3.090232, 0.0, 1.959964]


def test_qlike_needs_positive_forecasts(frame):
    df = frame([(1.0, 0.0)], "p double, f double")
    with pytest.raises(Exception, match="strictly positive"):
        df.agg(A.qlike(F.col("p"), F.col("f"))).collect()


def test_acf_of_an_alternating_series(frame):
    df = frame(series([1.0, -1.0] * 50), RETURNS)
    rho = {r["lag"]: r["acf"] for r in A.acf(df, "r", 2).collect()}
    assert rho[1] == pytest.approx(-0.99) and rho[2] == pytest.approx(0.98)


def test_histogram_has_every_bin_and_stands_a_constant_series(frame):
    rows = [("A", 0, 0.0), ("A", 1, 1.0), ("A", 2, 0.99), ("B", 0, 2.0), ("B", 1, 2.0), ("B", 2, None)]
    out = A.histogram(frame(rows, "asset string, idx bigint, r double"), "r", 4).orderBy("asset", "bin").collect()
    assert [(r["asset"], r["bin"], r["rows"]) for r in out] == [
        ("A", 0, 1), ("A", 1, 0), ("A", 2, 0), ("A", 3, 2), ("B", 0, 0), ("B", 1, 0), ("B", 2, 2), ("B", 3, 0)
    ]
    assert out[4]["normal_density"] is None and out[6]["density"] == 4.0
