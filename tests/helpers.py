from __future__ import annotations

import datetime as dt

import numpy as np

START = dt.date(2020, 1, 1)


def series(values, asset="A", start=START):
    return [(asset, start + dt.timedelta(days=i), i, float(v)) for i, v in enumerate(values)]


RETURNS = "asset string, day date, idx bigint, r double"


# What the recovery test must find again, from a series long enough for it.
TRUE_GARCH = {"omega": 4e-5, "alpha": 0.12, "beta": 0.78}


def garch_returns(n):
    """Returns of the process above, taken after a warm-up of 250 steps."""
    draws = np.random.default_rng(20240611).normal(size=n + 250)
    returns, level = np.empty_like(draws), TRUE_GARCH["omega"] / (1 - TRUE_GARCH["alpha"] - TRUE_GARCH["beta"])
    for i, draw in enumerate(draws):
        returns[i] = draw * level**0.5
        level = TRUE_GARCH["omega"] + TRUE_GARCH["alpha"] * returns[i] ** 2 + TRUE_GARCH["beta"] * level
    return returns[250:]


def garch_loop(r, omega, alpha, beta, mu, seed=None):
    eps = np.asarray(r) - mu
    prev = float(np.var(eps, ddof=1)) if seed is None else seed
    before, out = prev, []
    for e in eps:
        prev = omega + alpha * before + beta * prev
        before = e * e
        out.append(prev)
    return np.array(out)


def values(df, column, order="idx"):
    return np.array([row[column] for row in df.orderBy(order).collect()], dtype=float)
