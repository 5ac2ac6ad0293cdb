"""The re-org-safe ledger against the batch rules, for any split and order of deliveries."""

from __future__ import annotations

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.streaming import reorg as R
from test_ledger import OBS, seen

CANONICAL = "chain_id int, block_number bigint, block_hash string"


class Intake:
    def __init__(self, spark, folder, depth=2):
        self.spark, self.depth = spark, depth
        self.source, self.checkpoint = str(folder / "source"), str(folder / "checkpoint")
        self.schema = spark.createDataFrame([], OBS).schema
        self.ledger = R.Ledger(spark, str(folder / "ledger"), self.schema, depth, compact_after=2)

    def chain(self, blocks):
        return self.spark.createDataFrame([(1, *b) for b in blocks], CANONICAL)

    def run(self, rows, blocks):
        self.spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(self.schema).parquet(self.source)
        R.ledger_stream(stream, self.ledger, self.checkpoint, lambda: self.chain(blocks)).awaitTermination()

    def view(self, batch=None):
        rows = self.ledger.view(batch).collect()
        assert len({(r["tx_hash"], r["log_index"]) for r in rows}) == len(rows)
        return {r["tx_hash"]: (r["block_number"], r["confirmation_state"], r["is_orphaned"]) for r in rows}


def batch_view(spark, rows, blocks, depth):
    held = L.as_observed(L.observation_current(L.observation_outcomes(spark.createDataFrame(rows, OBS))))
    done = L.confirm_blocks(held, spark.createDataFrame([(1, *b) for b in blocks], CANONICAL), depth)
    return {r["tx_hash"]: (r["block_number"], r["confirmation_state"], r["is_orphaned"]) for r in done.collect()}


def test_any_split_and_order_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    blocks = [(b, f"h{b}") for b in range(1, 3200, 40)]
    rows = []
    for t in range(60):  # identities seen up to three times, far apart, some under hashes the chain does not have
        for _ in range(rng.choice((1, 1, 2, 3))):
            b = rng.choice(blocks)[0]
            stale = rng.random() < 0.03 and b > 2000
            rows.append(seen(b, "stale" if stale else f"h{b}", tx=f"t{t}", at=rng.randrange(1, 200), contract=f"c{t % 2}"))
    rows += rows[:5]
    rng.shuffle(rows)
    intake = Intake(spark, tmp_path)
    cuts = [0, 20, 25, 70, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        intake.run(rows[a:b], blocks)
        assert intake.view() == batch_view(spark, rows[:b], blocks, 2)


def test_mismatch_is_remembered_and_resolved(spark, tmp_path):
    blocks = [(b, "h") for b in range(1, 30)]
    intake = Intake(spark, tmp_path)
    intake.run([seen(1, "h", tx="a", at=1), seen(5, "stale", tx="b", at=2), seen(6, "h", tx="c", at=3)], blocks)
    assert intake.view() == {"a": (1, "confirmed", False), "b": (5, "observed", True), "c": (6, "observed", True)}
    # A later delivery stays behind the unresolved mismatch.
    intake.run([seen(9, "h", tx="d", at=4)], blocks)
    assert intake.view()["d"] == (9, "observed", True)
    frontier = intake.ledger.frontier(1).first()
    assert (frontier["first_bad"], frontier["last_confirmed_block"]) == (5, 4)
    # The canonical row takes over; everything up to the depth is confirmed.
    intake.run([seen(5, "h", tx="b", at=9)], blocks)
    assert set(intake.view().values()) == {(1, "confirmed", False), (5, "confirmed", False), (6, "confirmed", False), (9, "confirmed", False)}


def test_frontier_rewinds_and_observing_again_reinstates(spark, tmp_path):
    old = [(b, "h") for b in range(1, 21)]
    intake = Intake(spark, tmp_path, depth=3)
    intake.run([seen(b, "h", tx=f"t{b}", at=b) for b in (10, 17, 18, 19)], old)
    assert intake.view()["t18"] == (18, "observed", False)
    new = [(b, "h" if b < 19 else "n") for b in range(1, 31)]
    intake.run([seen(19, "n", tx="t19", at=40)], new)
    frontier = intake.ledger.frontier(1).first()
    assert frontier["reorg"] and frontier["orphan_from_block"] == 17
    assert intake.view() == {
        "t10": (10, "confirmed", False), "t17": (17, "observed", True), "t18": (18, "observed", True), "t19": (19, "confirmed", False)
    }
    intake.run([seen(b, "h", tx=f"t{b}", at=b) for b in (17, 18)], new)
    assert intake.view()["t17"] == (17, "confirmed", False) and intake.view()["t18"] == (18, "confirmed", False)
    assert intake.ledger.frontier(2).first()["reorg"] is False


def test_cycles_cost_what_they_touch_and_ranges_are_compacted(spark, tmp_path):
    blocks = [(b, "h") for b in range(1, 5001, 50)]
    intake = Intake(spark, tmp_path)
    for n in range(5):
        low = 1000 * n
        intake.run([seen(b, "h", tx=f"t{b}", at=b) for b, _ in blocks if low < b <= low + 1000], blocks)
    cycles = {r["batch_id"]: r for r in intake.ledger.cycles().collect()}
    assert len(cycles) == 5 and {r["identities"] for r in cycles.values()} == {20}
    # From the second cycle on the rows looked at do not grow with the ledger (the last range is not due yet).
    assert max(cycles[n]["rows_checked"] for n in range(2, 5)) <= 2 * cycles[1]["rows_checked"] <= 80
    for n in range(5, 9):
        intake.run([seen(2001 + 50 * (n % 3), "h", tx=f"late{n}", at=9000 + n)], blocks)
    versions = {r["rng"]: r["versions"] for r in intake.ledger.manifest(intake.ledger.last_batch()).collect()}
    assert max(map(len, versions.values())) <= 2 and any(v < 0 for some in versions.values() for v in some)
    assert len(intake.view()) == len(blocks) + 4


def test_a_repeated_cycle_ends_in_the_same_tables(spark, tmp_path):
    blocks = [(b, "h") for b in range(1, 30)]
    intake = Intake(spark, tmp_path)
    rows = [seen(b, "h", tx=f"t{b}", at=b) for b in (3, 7, 29)]
    intake.run(rows[:2], blocks)
    intake.run(rows[2:], blocks)
    before = intake.view()
    names = [*L.ARRIVAL, *[c for c in intake.schema.names if c not in (*L.IDENTITY, *L.ARRIVAL)]]
    history = spark.createDataFrame(rows[2:], OBS).selectExpr(*L.IDENTITY, f"array(struct({', '.join(names)})) AS history")
    intake.ledger.process(history, 1, intake.chain(blocks))
    assert intake.view() == before and intake.ledger.last_batch() == 1


def test_no_cycle_yet(spark, tmp_path):
    intake = Intake(spark, tmp_path)
    assert intake.ledger.last_batch() == -1 and intake.ledger.view().count() == 0


def test_deliveries_must_hold_every_row(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.plans.stream_plans import _deliver

    with pytest.raises(ValueError, match="deliveries"):
        _deliver(spark, spark.createDataFrame([(-3,)], "b bigint"), F.col("b"), str(tmp_path), lambda s: None)


def test_a_large_range_is_written_by_several_tasks(spark, tmp_path):
    ledger = R.Ledger(spark, str(tmp_path / "ledger"), spark.createDataFrame([], OBS).schema, 2)
    rows = spark.createDataFrame([seen(5, f"{i * 7919:032x}", tx=f"{i * 104729:032x}") for i in range(4000)], OBS).repartition(8)
    rows = rows.withColumn("_gone", F.lit(False)).withColumn("_chain", F.lit(1).cast("bigint")).withColumn("_range", F.lit(0).cast("bigint"))
    # As in the session of a stream, in which run-time re-planning is off.
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        assert ledger._write_rows(rows, 0) == [(1, 0, 4000)]
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list((tmp_path / "ledger/rows/_version=0/_chain=1/_range=0").glob("*.parquet"))) > 3


def test_a_single_version_is_read_without_ordering(spark, tmp_path):
    blocks = [(b, "h") for b in range(1, 30)]
    intake = Intake(spark, tmp_path)
    held = lambda: intake.ledger.rows_of(intake.ledger._ranges(intake.ledger.manifest(intake.ledger.last_batch())))
    ordered = lambda: "Window" in held()._jdf.queryExecution().executedPlan().toString()
    intake.run([seen(1, "h", tx="a", at=1), seen(1500, "h", tx="b", at=1)], blocks)
    assert not ordered()
    intake.run([seen(2, "h", tx="a", at=2), seen(2, "x", tx="a", at=3)], blocks)
    assert ordered()
    assert sorted((r["tx_hash"], r["block_number"]) for r in held().collect()) == [("a", 2), ("b", 1500)]


def _ordered(df):
    return "Window" in df._jdf.queryExecution().executedPlan().toString()


def test_versions_of_other_identities_are_read_without_ordering(spark, tmp_path):
    blocks = [(b, "h") for b in range(1, 30)]
    intake = Intake(spark, tmp_path)
    held = lambda: intake.ledger.rows_of(intake.ledger._ranges(intake.ledger.manifest(intake.ledger.last_batch())))
    intake.run([seen(1, "h", tx="a", at=1), seen(2, "h", tx="b", at=1)], blocks)
    intake.run([seen(3, "h", tx="c", at=2), seen(4, "h", tx="d", at=3)], blocks)
    assert intake.ledger.manifest(1).first()["versions"] == [0, 1]
    assert not _ordered(held()) and held().count() == 4
    intake.run([seen(5, "x", tx="a", at=4)], blocks)  # replaces a row, and the range is written whole
    assert not _ordered(held())
    intake.run([seen(6, "h", tx="b", at=5)], blocks)
    assert _ordered(held())
    assert sorted((r["tx_hash"], r["block_number"]) for r in held().collect()) == [("a", 5), ("b", 2), ("c", 3), ("d", 4)]


def test_only_rows_that_may_be_replaced_are_ordered(spark, tmp_path):
    blocks = [(b, "h") for b in range(1, 900)]
    intake = Intake(spark, tmp_path)
    intake.run([seen(b, "h", tx=f"t{b}", at=b) for b, _ in blocks], blocks)
    intake.run([seen(b, "x", tx=f"t{b + 1}", at=1000) for b in (7, 8)] + [seen(1500, "y", tx="t20", at=1000)], blocks)
    ledger = intake.ledger
    ranges = ledger._ranges(ledger.manifest(1).where("rng = 0"))
    doubted = {r["tx_hash"] for r in ledger._doubted(ranges).where("_doubted").collect()}
    assert {"t8", "t9", "t20"} <= doubted and len(doubted) < 20
    held = {r["tx_hash"]: r["block_number"] for r in ledger.rows_of(ranges).collect()}
    assert held == {f"t{b}": b for b, _ in blocks if b != 20} | {"t8": 7, "t9": 8}


def test_a_replaced_row_is_no_mismatch(spark, tmp_path):
    blocks = [(b, "h") for b in range(1, 1200)]
    intake = Intake(spark, tmp_path)
    first = [seen(5, "stale", tx="a", at=1), seen(9, "stale", tx="b", at=1), seen(4, "h", tx=None, at=1)]
    intake.run(first, blocks)
    assert intake.ledger.frontier(0).first()["first_bad"] == 5
    later = [seen(5, "h", tx="a", at=2), seen(4, "stale", tx=None, at=2)]
    intake.run(later, blocks)
    assert intake.ledger.frontier(1).first()["first_bad"] == 4
    intake.run([seen(1100, "h", tx=None, at=3), seen(1100, "h", tx="b", at=3)], blocks)
    assert intake.ledger.frontier(2).first()["first_bad"] is None
    assert intake.view() == {"a": (5, "confirmed", False), "b": (1100, "confirmed", False), None: (1100, "confirmed", False)}


def test_a_delivery_is_written_once_and_deleted_by_the_next_run(spark, tmp_path):
    from tidemark.plans.stream_plans import _deliver
    from tidemark.sources.stored import shared_dir

    tables = lambda: set((pathlib.Path(shared_dir(spark)) / "tidemark").glob("parts-*"))
    before, left, folder = tables(), [], tmp_path / "run"

    def start(stream):
        left.append(len(list((folder / "source").glob("*.parquet"))))
        return (
            stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "checkpoint"))
            .trigger(availableNow=True).start()
        )

    rows = spark.createDataFrame([(i,) for i in range(30)], "b bigint").coalesce(1)
    _deliver(spark, rows, F.col("b") % 3, str(folder), start)
    assert sorted(r["b"] for r in spark.read.parquet(str(folder / "out")).collect()) == list(range(30))
    assert tables() == before and left == [1, 2, 2]
