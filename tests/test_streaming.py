from __future__ import annotations

import numpy as np
import pytest

from helpers import RETURNS, garch_returns, series
from tidemark.operators import ledger as L
from tidemark.sources import tables
from tidemark.streaming import ledger as SL, volatility as SV
from test_ledger import OBS, seen

CANONICAL = "chain_id int, block_number bigint, block_hash string"


class Intake:
    """A log folder, a ledger folder and a checkpoint; every ``run`` is a restart of the same query."""

    def __init__(self, spark, folder, canonical, depth=2):
        self.spark, self.depth = spark, depth
        self.source, self.ledger, self.checkpoint = (str(folder / n) for n in ("source", "ledger", "checkpoint"))
        self.canonical = canonical

    def run(self, rows):
        if rows:
            self.spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(self.source)
        stream = tables.stream_logs(self.spark, self.source, OBS, 10)
        query = SL.intake_stream(stream, self.ledger, self.checkpoint, lambda: self.spark.createDataFrame([(1, *c) for c in self.canonical], CANONICAL), self.depth)
        query.awaitTermination()
        self.batch = SL.last_batch(self.spark, self.ledger)
        return query

    def view(self):
        schema = L.as_observed(self.spark.createDataFrame([], OBS)).schema
        rows = SL.ledger_view(self.spark, self.ledger, self.batch, schema).collect()
        assert len({(r["tx_hash"], r["log_index"]) for r in rows}) == len(rows)
        return {r["tx_hash"]: (r["block_number"], r["confirmation_state"], r["is_orphaned"]) for r in rows}


def test_confirmation_waits_for_depth_and_survives_restart(spark, tmp_path):
    intake = Intake(spark, tmp_path, [(b, "h") for b in range(1, 5)])
    intake.run([seen(b, "h", tx=f"t{b}", at=b) for b in (1, 2, 3)])
    assert intake.view() == {"t1": (1, "confirmed", False), "t2": (2, "confirmed", False), "t3": (3, "observed", False)}
    intake.canonical = [(b, "h") for b in range(1, 9)]
    intake.run([seen(6, "h", tx="t6", at=6)])
    assert intake.view() == {
        "t1": (1, "confirmed", False), "t2": (2, "confirmed", False), "t3": (3, "confirmed", False), "t6": (6, "confirmed", False)
    }


def test_replayed_rows_change_nothing(spark, tmp_path):
    intake = Intake(spark, tmp_path, [(b, "h") for b in range(1, 6)])
    rows = [seen(b, "h", tx=f"t{b}", at=b) for b in (1, 2, 4, 5)]
    intake.run(rows)
    before = intake.view()
    intake.run(rows)
    assert intake.view() == before


def test_late_inclusion_in_another_block_resets_and_confirms_again(spark, tmp_path):
    intake = Intake(spark, tmp_path, [(1, "h"), (2, "h"), (3, "h"), (4, "h4")])
    intake.run([seen(1, "h", tx="a", at=1), seen(2, "h", tx="b", at=2)])
    assert intake.view()["a"] == (1, "confirmed", False)
    intake.run([seen(4, "h4", tx="a", at=9)])
    assert intake.view()["a"] == (4, "observed", False)
    intake.canonical = [(b, "h4" if b == 4 else "h") for b in range(1, 9)]
    intake.run([seen(8, "h", tx="c", at=12)])
    assert intake.view() == {"a": (4, "confirmed", False), "b": (2, "confirmed", False), "c": (8, "observed", False)}


def test_mismatch_orphans_and_the_canonical_row_takes_over(spark, tmp_path):
    intake = Intake(spark, tmp_path, [(b, "h") for b in range(1, 9)])
    intake.run([seen(1, "h", tx="a", at=1), seen(2, "stale", tx="b", at=2), seen(3, "h", tx="c", at=3)])
    assert intake.view() == {"a": (1, "confirmed", False), "b": (2, "observed", True), "c": (3, "observed", True)}
    intake.run([seen(2, "h", tx="b", at=10)])
    assert intake.view() == {"a": (1, "confirmed", False), "b": (2, "confirmed", False), "c": (3, "observed", True)}


def test_stream_equals_batch_and_repeating_a_batch_is_harmless(spark, tmp_path):
    rows = [seen(b, "stale" if b == 14 else "h", tx=f"t{b}", at=b, contract=f"c{b % 2}") for b in range(1, 20)]
    canonical = [(b, "h") for b in range(1, 20)]
    intake = Intake(spark, tmp_path, canonical, 3)
    for part in (rows[:7], rows[7:]):
        intake.run(part)
    held = L.as_observed(L.observation_current(L.observation_outcomes(spark.createDataFrame(rows, OBS))))
    batch = L.confirm_blocks(held, spark.createDataFrame([(1, *c) for c in canonical], CANONICAL), 3)
    expected = {r["tx_hash"]: (r["block_number"], r["confirmation_state"], r["is_orphaned"]) for r in batch.collect()}
    assert intake.view() == expected
    SL.process_batch(spark.createDataFrame(rows[7:], OBS), intake.batch, intake.ledger, spark.createDataFrame([(1, *c) for c in canonical], CANONICAL), 3)
    assert intake.view() == expected


def test_progress_metrics(spark, tmp_path):
    intake = Intake(spark, tmp_path, [(b, "h") for b in range(1, 6)])
    records = SL.progress_metrics(intake.run([seen(b, "h", tx=f"t{b}", at=b) for b in (1, 2)]))
    assert sum(r["input_rows"] for r in records) >= 2
    assert any(r["observed"].get("intake", {}).get("last_block") == 2 for r in records)


def run_volatility(spark, folder, schema, parts, build):
    source, out, state = (str(folder / n) for n in ("source", "out", "checkpoint"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = (
            build(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(out).orderBy("asset", "day").collect()


def test_online_ewma_equals_the_loop_and_ignores_stale_days(spark, tmp_path):
    r = garch_returns(60)
    rows = [(*x, 4e-4) for x in series(r)]
    schema = RETURNS + ", seed double"
    out = run_volatility(spark, tmp_path, schema, [rows[:20], rows[10:40], rows[40:]], lambda s: SV.ewma_stream(s, 0.9))
    v, expected = 4e-4, []
    for x in r:
        v = 0.9 * v + 0.1 * x * x
        expected.append(v)
    np.testing.assert_allclose([x["ewma_variance"] for x in out], expected, rtol=1e-12)


def test_online_garch_equals_the_loop_and_flags_a_refit(spark, tmp_path):
    r = garch_returns(50)
    rows = series(r)
    state = spark.createDataFrame(
        [("A", 1e-5, 0.1, 0.85, 0.0, rows[9][1], 3e-4, None)],
        "asset string, omega double, alpha double, beta double, mu double, latest_day date, latest_variance double, latest_eps2 double",
    )
    out = run_volatility(spark, tmp_path, RETURNS, [rows[:30], rows[25:]], lambda s: SV.garch_stream(s, state))
    assert len(out) == 40 and [x["n_updates"] for x in out] == list(range(1, 41))
    assert [x["refit_due"] for x in out] == [n >= 21 for n in range(1, 41)]
    s2, e2 = 3e-4, 0.0
    for row, x in zip(out, r[10:]):
        s2 = 1e-5 + 0.1 * e2 + 0.85 * s2
        e2 = x * x
        assert row["sigma2"] == pytest.approx(s2, rel=1e-12)

