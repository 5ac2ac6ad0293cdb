"""Online volatility: one small state per asset, one step per new return.

A day at or before the last one folded in is ignored, so a replayed file changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.garch import PARAMS, REFIT_FREQUENCY
from tidemark.operators.series import EWMA_LAMBDA, _check_lambda

_EWMA_OUT = "asset string, day date, ewma_variance double"
_EWMA_STATE = "variance double, last_day date"
_GARCH_OUT = "asset string, day date, sigma2 double, eps2 double, n_updates bigint, refit_due boolean"
_GARCH_STATE = "sigma2 double, eps2 double, n_updates bigint, last_day date"


def _fresh_rows(frames: Iterator[pd.DataFrame], last_day) -> pd.DataFrame:
    """The micro-batch's rows of one asset in day order, without stale or repeated days."""
    rows = pd.concat(list(frames)).sort_values("day").drop_duplicates("day", keep="first")
    return rows if last_day is None else rows[rows["day"] > last_day]


def ewma_stream(returns: DataFrame, lam: float = EWMA_LAMBDA) -> DataFrame:
    """Rows (asset, day, r, seed) to the running EWMA variance; ``seed`` starts an asset's recursion."""
    _check_lambda(lam)

    def step(key, frames, state: GroupState):
        variance, last_day = state.get if state.exists else (None, None)
        out = []
        for day, r, seed in _fresh_rows(frames, last_day)[["day", "r", "seed"]].itertuples(index=False):
            variance = lam * (seed if variance is None else variance) + (1 - lam) * r * r
            last_day = day
            out.append((key[0], day, variance))
        if out:
            state.update((variance, last_day))
            yield pd.DataFrame(out, columns=["asset", "day", "ewma_variance"])

    return returns.select("asset", "day", "r", "seed").groupBy("asset").applyInPandasWithState(
        step, _EWMA_OUT, _EWMA_STATE, "append", GroupStateTimeout.NoTimeout
    )


def garch_stream(returns: DataFrame, state_table: DataFrame, refit_frequency: int = REFIT_FREQUENCY) -> DataFrame:
    """Fold new returns into stored GARCH states (asset, parameters, latest_day, latest_variance, latest_eps2).

    The state row is joined to the stream once per row; the running state starts from it. ``refit_due`` turns true
    after ``refit_frequency`` updates.
    """
    start = ["latest_day", "latest_variance", "latest_eps2"]
    joined = returns.select("asset", "day", "r").join(state_table.select("asset", *PARAMS, *start), "asset")

    def step(key, frames, state: GroupState):
        rows = pd.concat(list(frames))
        head = rows.iloc[0]
        eps2_before = 0.0 if pd.isna(head.latest_eps2) else head.latest_eps2
        sigma2, eps2, n, last_day = state.get if state.exists else (head.latest_variance, eps2_before, 0, head.latest_day)
        out = []
        for day, r in _fresh_rows([rows], last_day)[["day", "r"]].itertuples(index=False):
            sigma2 = head.omega + head.alpha * eps2 + head.beta * sigma2
            eps2 = (r - head.mu) ** 2
            n, last_day = n + 1, day
            out.append((key[0], day, sigma2, eps2, n, n >= refit_frequency))
        state.update((float(sigma2), float(eps2), int(n), last_day))
        if out:
            yield pd.DataFrame(out, columns=["asset", "day", "sigma2", "eps2", "n_updates", "refit_due"])

    return joined.groupBy("asset").applyInPandasWithState(step, _GARCH_OUT, _GARCH_STATE, "append", GroupStateTimeout.NoTimeout)


def with_metrics(stream: DataFrame, name: str = "intake") -> DataFrame:
    """Count rows and days of every micro-batch; read them back with ``progress_metrics``."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.max("day").cast("string").alias("last_day"))
