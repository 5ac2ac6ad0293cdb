"""Exact selection against sorting, for groups larger than anything a task may hold."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.functions import selection
from tidemark.operators import stats as A

LEVELS = {"a": 0.0, "b": 0.01, "c": 0.05, "d": 0.5, "e": 0.731, "f": 1.0}


def selected(frame, groups, **limits):
    rows = [(k, None if v is None else float(v)) for k, values in groups.items() for v in values]
    _, found = selection.quantiles(frame(rows, "k string, x double"), ["k"], "x", LEVELS, **limits)
    return {r["k"]: [r[name] for name in LEVELS] for r in found.collect()}


def test_quantiles_equal_sorting_however_values_lie(frame):
    rng = np.random.default_rng(11)
    groups = {
        "even": rng.uniform(-1, 1, 3000),
        "skewed": np.concatenate([rng.normal(0, 1e-12, 2500), [1e12, -1e12, 1e300]]),
        "ties": np.repeat([0.25, -3.0, 7.5], [1500, 900, 3]),
        "constant": np.full(700, 2.5),
        "one": np.array([-4.0]),
        "signed zero": np.array([0.0, -0.0, 0.0]),
    }
    got = selected(frame, groups, buckets=16, small=20)
    for name, values in groups.items():
        np.testing.assert_allclose(got[name], np.quantile(values, list(LEVELS.values())), rtol=1e-12, atol=1e-25, err_msg=name)


def test_null_infinite_and_nan_values(frame):
    got = selected(frame, {"null": [None, None], "some": [None, 3.0, 1.0], "inf": [float("-inf"), 1.0, float("inf")], "nan": [1.0, float("nan")]})
    assert got["null"] == [None] * 6
    assert got["some"][3] == 2.0
    assert got["inf"][0] == float("-inf") and got["inf"][3] == 1.0 and got["inf"][5] == float("inf")
    assert got["nan"][0] == 1.0 and np.isnan(got["nan"][5])


def test_no_plan_gathers_a_group(spark):
    big = spark.range(200_000).selectExpr("'g' AS k", "pow(rand(7), 3) AS x")
    values = np.array([r["x"] for r in big.collect()])
    row = A.tail_measures(big, ["k"], "x", [0.95]).first()
    q = np.quantile(values, 0.05)
    assert row["n_scenarios"] == 200_000 and row["p50"] == pytest.approx(np.quantile(values, 0.5), rel=1e-12)
    assert row["value_at_risk"] == max(-q, 0) and row["expected_shortfall"] == 0
    # Every list of values that is read off is bounded, whatever the size of the group.
    assert selection.SMALL < 200_000 / 16


def test_empty_input(frame):
    assert A.tail_measures(frame([], "k string, x double"), ["k"], "x", [0.99]).count() == 0
