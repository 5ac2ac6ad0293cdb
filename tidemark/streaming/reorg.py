"""Re-org-safe event intake whose every cycle costs what its own events and blocks cost.

The observations of an identity are the keyed state of the stream (on disk, reached by key), so a cycle (one micro-batch)
gets the whole history of the identities it touches and of no others, and the row an identity holds follows from the
order in which its observations were made, not from the order in which they were delivered.

The rows held are a set of versions per block range. A cycle appends one version with the rows of its identities, and a
mark where an identity held a row before; a range with more than ``COMPACT_AFTER`` versions is written whole instead. The
manifest of a cycle lists the versions of every range and is written last but for the cycle's own figures, so a cycle that
breaks off leaves nothing behind and a repeated one ends in the same tables.

Disk is what a cycle needs most. Shuffle files and loaded histories go as soon as their job or task ends, tables are written
with zstd, and versions are ordered only where the manifest counts rows of identities that an earlier cycle touched too.

Whether a row is confirmed or orphaned is not stored but follows from its contract's frontier, which every cycle moves:

* ``first_bad`` the lowest due block whose hash is not the chain's, over the rows held now. It is kept per range; a cycle
  looks again at ranges it wrote, that became due, whose chain changed or that a rewind reached.
* ``last_scanned_block`` with its hash. If the chain has another block there, the frontier rewinds by the confirmation
  depth, and rows from there on that came in an earlier cycle are orphaned until they are observed again.

So the view equals the batch rules over all observations delivered so far, however they were split and ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.joins import spread_lookup
from tidemark.functions.ordered import with_previous
from tidemark.operators import ledger as L

RANGE_BLOCKS = 1_000
COMPACT_AFTER = 4
# A task writes straight into the ranges if its files get so many rows on average.
FILE_ROWS = 10_000
# Size of the bitmaps that tell which rows may have been replaced, in bits: for each row that may replace one, and at most
# (32 MB, broadcast).
MARKS_PER_ROW, MAX_MARKS = 8, 1 << 28

_MANIFEST = "chain_id bigint, rng bigint, versions array<int>, n_rows bigint, mark bigint, n_again bigint"
_BAD = "chain_id bigint, contract_address string, rng bigint, first_bad bigint"
_FRONTIER = (
    "chain_id bigint, contract_address string, reorg boolean, orphan_from_block bigint, last_scanned_block bigint, "
    "last_scanned_block_hash string, last_confirmed_block bigint, first_bad bigint, head_block bigint"
)
_REWINDS = "chain_id bigint, contract_address string, orphan_from_block bigint, at_batch int"
_CYCLES = (
    "batch_id int, identities bigint, rows_written bigint, ranges_written bigint, ranges_checked bigint, rows_checked bigint, reorgs bigint"
)
# Histories are kept on disk and reached by key, so a cycle does not load those it does not touch. Their number is not
# counted, for which every write would look its key up first. Executors keep no copy between tasks: every run loads them anew.
# A shuffle is deleted with the job that made it; by default it stays until the driver collects its garbage.
_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def _replanned(spark: SparkSession):
    """Run-time re-planning, which a stream switches off in its own session for the sake of its state."""
    before = spark.conf.get(_ADAPTIVE)
    spark.conf.set(_ADAPTIVE, "true")
    try:
        yield
    finally:
        spark.conf.set(_ADAPTIVE, before)


def range_of(block: Column) -> Column:
    return F.floor(block / RANGE_BLOCKS).cast("bigint")


@dataclass(frozen=True)
class Range:
    """A block range of the manifest."""

    chain: int
    number: int
    versions: tuple[int, ...]
    rows: int
    again: int


class Ledger:
    """The versioned tables under one folder; ``schema`` is that of the observations."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, depth: int, start_block: int = 0, compact_after: int = COMPACT_AFTER):
        self.spark, self.folder, self.depth, self.start_block, self.compact_after = spark, folder, depth, start_block, compact_after
        self.columns = list(schema.names)
        # ``_since``: the cycle that wrote the row; ``_gone``: the identity holds no row in this range any more; ``_again``: an
        # earlier cycle touched the identity, so an earlier version may hold a row of it.
        self.stored = StructType(schema.fields).add("_since", "integer").add("_gone", "boolean").add("_again", "boolean")
        self.stored = self.stored.add("_version", "integer").add("_chain", "long").add("_range", "long")

    # --- tables ---------------------------------------------------------------------------------------------

    def _table(self, name: str, batch: int, schema: str) -> DataFrame:
        """One cycle's version of a table; before the first cycle it is empty."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={batch}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/batch={batch}")

    def manifest(self, batch: int) -> DataFrame:
        return self._table("manifest", batch, _MANIFEST)

    def frontier(self, batch: int) -> DataFrame:
        return self._table("frontier", batch, _FRONTIER)

    def last_batch(self) -> int:
        """The newest cycle whose manifest is written; -1 before the first."""
        cycles = self.cycles()
        return -1 if cycles is None else cycles.agg(F.max("batch_id")).first()[0]

    def cycles(self) -> DataFrame | None:
        """One row per finished cycle: what came in, was read, written and checked."""
        try:
            return self.spark.read.schema(_CYCLES).parquet(f"{self.folder}/cycles/*")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":  # no cycle has finished yet
                return None
            raise

    def _ranges(self, listed: DataFrame) -> list[Range]:
        """Names of ranges; metadata of the few ranges a cycle touches."""
        return [Range(r["chain_id"], r["rng"], tuple(r["versions"]), r["n_rows"], r["n_again"]) for r in listed.collect()]

    def _versions(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).option("basePath", f"{self.folder}/rows").parquet(*paths)

    def _paths(self, ranges: Iterable[Range]) -> list[str]:
        return [f"{self.folder}/rows/_version={v}/_chain={r.chain}/_range={r.number}" for r in ranges for v in r.versions]

    def rows_of(self, ranges: Iterable[Range]) -> DataFrame:
        """The rows held in ``ranges``: of every identity the newest version, unless it has moved away."""
        ranges = list(ranges)
        # Where no version holds an identity of an earlier one, there is nothing to choose from.
        plain = self._paths(r for r in ranges if len(r.versions) == 1 or r.again == 0)
        several = [r for r in ranges if len(r.versions) > 1 and r.again != 0]
        parts = []
        if plain:
            parts.append(self._versions(plain).where(~F.col("_gone")).drop("_version"))
        if several:
            rows = self._doubted(several)
            parts.append(rows.where(~F.col("_doubted") & ~F.col("_gone")).drop("_doubted", "_version"))
            newest = W.partitionBy(*L.IDENTITY, "_range").orderBy(F.desc("_since"))
            rows = rows.where("_doubted").drop("_doubted", "_version").withColumn("_nth", F.row_number().over(newest))
            parts.append(rows.where((F.col("_nth") == 1) & ~F.col("_gone")).drop("_nth"))
        if not parts:
            return self.spark.createDataFrame([], self.stored)
        return reduce(DataFrame.unionByName, parts)

    def _doubted(self, ranges: list[Range]) -> DataFrame:
        """All versions of ``ranges`` with ``_doubted``: false only if an identity is in one of them, so its row need not travel.

        The identities that came again are marked in bitmaps by hash, so some others are doubted too.
        """
        rows = self._versions(self._paths(ranges))
        n = sum(r.rows if r.again is None else r.again for r in ranges)
        bits = min(max(MARKS_PER_ROW * n, 1 << 15), MAX_MARKS)
        place = F.pmod(F.xxhash64(*L.IDENTITY, "_range"), F.lit(bits)) + 1
        again = rows.where(F.coalesce("_again", F.lit(True))).select(place.alias("_place"))
        marks = again.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_marks")
        )
        bit = F.bitmap_bit_position(place)
        byte = F.substring("_marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
        doubted = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (bit % 8).cast("int")) == 1
        rows = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "_bucket", "left")
        return rows.withColumn("_doubted", F.coalesce(doubted, F.lit(False))).drop("_bucket", "_marks")

    # --- one cycle ------------------------------------------------------------------------------------------

    def process(self, touched: DataFrame, batch_id: int, canonical: DataFrame) -> None:
        """Write the rows of ``touched`` (identity, history), reconcile the frontier, check ranges, advance it."""
        old = self.manifest(batch_id - 1)
        written = self._write_rows(self.held_rows(touched), batch_id)
        manifest = self._compacted(self._next_manifest(old, written, batch_id), written, batch_id)
        frontier, reorgs = self._reconcile(batch_id, canonical)
        marks = canonical.groupBy(F.col("chain_id").cast("bigint").alias("chain_id"), range_of(F.col("block_number")).alias("rng")).agg(
            F.bit_xor(F.xxhash64("block_number", "block_hash")).alias("now")
        )
        marked = manifest.join(marks, ["chain_id", "rng"], "left")
        checked = self._check(marked, batch_id, canonical, written, reorgs)
        identities = self._advance(batch_id, canonical, frontier)
        self._write(marked.withColumn("mark", F.col("now")).drop("now").coalesce(1), "manifest", batch_id)
        cycle = (batch_id, identities, sum(n for _, _, n in written), len(written), len(checked), sum(r.rows for r in checked), len(reorgs))
        self._write(self.spark.createDataFrame([cycle], _CYCLES).coalesce(1), "cycles", batch_id)

    def held_rows(self, touched: DataFrame) -> DataFrame:
        """The row every identity holds: the first of the last run of observations with one block hash. It comes once for
        its own range and, marked ``_gone``, once for every other range of the history."""
        history = F.col("history")
        touched = touched.withColumn("history", F.sort_array("history"))  # its fields begin with the order of arrival
        starts = F.filter(
            history, lambda x, i: (i == 0) | ~x["block_hash"].eqNullSafe(F.get(history, i - 1)["block_hash"])
        )
        ranges = F.array_distinct(F.transform("history", lambda x: range_of(x["block_number"])))
        again = F.col("first_cycle") != F.col("last_cycle") if "first_cycle" in touched.columns else F.lit(True)
        rows = touched.select(*L.IDENTITY, F.element_at(starts, -1).alias("_row"), again.alias("_again"), F.explode(ranges).alias("_range"))
        rest = [c for c in self.columns if c not in L.IDENTITY]
        rows = rows.select(*L.IDENTITY, *[F.col("_row")[c].alias(c) for c in rest], "_again", "_range")
        gone = F.col("_range") != range_of(F.col("block_number"))
        return rows.select(*self.columns, gone.alias("_gone"), "_again", F.col("chain_id").cast("bigint").alias("_chain"), "_range")

    def _write_rows(self, rows: DataFrame, version: int) -> list[tuple[int, int, int]]:
        """Write a version of the ranges of ``rows``: ``(chain, range, rows)`` of each."""
        path, touched = f"{self.folder}/rows/_version={version}", f"{self.folder}/touched"
        for name, value in (("_since", version), ("_again", True)):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(value))
        # Written as they come first: compressed columns are a fraction of a shuffle, and their size is known.
        rows.select(*self.columns, "_since", "_gone", "_again", "_chain", "_range").write.mode("overwrite").option("compression", "zstd").parquet(touched)
        schema = StructType([f for f in self.stored.fields if f.name != "_version"])
        rows = self.spark.read.schema(schema).parquet(touched)
        written = [tuple(r) for r in rows.groupBy("_chain", "_range").agg(F.count(F.lit(1))).collect()]
        with _replanned(rows.sparkSession):
            # Tasks that read much write into every range. If that made small files, a range goes to as many tasks as its
            # measured size asks for, and small ranges share a task.
            if sum(n for _, _, n in written) < FILE_ROWS * rows.rdd.getNumPartitions() * len(written):
                rows = rows.hint("rebalance", "_chain", "_range")
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("_chain", "_range").parquet(path)
        return written

    def _compacted(self, manifest: DataFrame, written: list[tuple[int, int, int]], batch_id: int) -> DataFrame:
        """Write those ranges of this cycle whole that have too many versions, as version ``-1 - batch_id``."""
        self._write(manifest, "planned", batch_id)
        manifest = self._table("planned", batch_id, _MANIFEST)
        full = self._ranges(manifest.where(F.size("versions") > self.compact_after))
        if not full:
            return manifest
        left = {(chain, number): n for chain, number, n in self._write_rows(self.rows_of(full), -1 - batch_id)}
        rows = [(r.chain, r.number, [-1 - batch_id] if (r.chain, r.number) in left else [], left.get((r.chain, r.number), 0), 0) for r in full]
        whole = self.spark.createDataFrame(rows, "chain_id bigint, rng bigint, _versions array<int>, _n bigint, _again bigint")
        joined = manifest.join(whole, ["chain_id", "rng"], "left")
        return joined.select(
            "chain_id", "rng", F.coalesce("_versions", "versions").alias("versions"), F.coalesce("_n", "n_rows").alias("n_rows"), "mark",
            F.coalesce("_again", "n_again").alias("n_again"),
        )

    def _next_manifest(self, old: DataFrame, written: list[tuple[int, int, int]], batch_id: int) -> DataFrame:
        new = self.spark.createDataFrame([(*w, batch_id) for w in written], "chain_id bigint, rng bigint, n bigint, version int")
        again = self._versions([f"{self.folder}/rows/_version={batch_id}"]).groupBy(F.col("_chain").alias("chain_id"), F.col("_range").alias("rng"))
        new = new.join(again.agg(F.count_if(F.coalesce("_again", F.lit(True))).alias("again")), ["chain_id", "rng"], "left")
        none = F.array().cast("array<int>")
        versions = F.concat(F.coalesce("versions", none), F.when(F.col("version").isNotNull(), F.array("version")).otherwise(none))
        total = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return old.join(new, ["chain_id", "rng"], "full").select(
            "chain_id", "rng", versions.alias("versions"), total("n_rows", "n").alias("n_rows"), "mark", total(F.coalesce("n_again", "n_rows"), "again").alias("n_again")
        )

    def _reconcile(self, batch_id: int, canonical: DataFrame) -> tuple[DataFrame, list[tuple[int, str, int]]]:
        """The frontier of the cycle before, rewound where the chain left it; the rewinds are kept for good."""
        old = self.frontier(batch_id - 1)
        names = ["last_scanned_block", "last_scanned_block_hash", "last_confirmed_block"]
        now = L.reconcile_frontier(old.select(*L.CONTRACT, *names), canonical, self.depth, self.start_block)
        self._write(now, "reconciled", batch_id)
        now = self.spark.read.schema(now.schema).parquet(f"{self.folder}/reconciled/batch={batch_id}")
        rewound = now.where("reorg").select(*L.CONTRACT, "orphan_from_block", F.lit(batch_id).alias("at_batch"))
        self._write(self._table("rewinds", batch_id - 1, _REWINDS).unionByName(rewound).coalesce(1), "rewinds", batch_id)
        return now, [tuple(r)[:3] for r in rewound.collect()]

    def _rewound(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """``rows`` with ``_rewound``: whether a rewind since the row came in reaches its block."""
        # Of two rewinds the later one decides for the blocks both reach; one list per contract.
        lists = self._table("rewinds", batch_id, _REWINDS).groupBy(*L.CONTRACT).agg(
            F.collect_list(F.struct("orphan_from_block", "at_batch")).alias("_rewinds")
        )
        joined = spread_lookup(rows, lists, L.CONTRACT, "tx_hash")
        hit = F.exists("_rewinds", lambda r: (F.col("block_number") >= r["orphan_from_block"]) & (F.col("_since") < r["at_batch"]))
        return joined.withColumn("_rewound", F.coalesce(hit, F.lit(False))).drop("_rewinds")

    def _check(
        self, manifest: DataFrame, batch_id: int, canonical: DataFrame, written: list[tuple[int, int, int]], reorgs: list[tuple[int, str, int]]
    ) -> list[Range]:
        """Look for mismatches again in the ranges where there may be others than before; write them for all ranges."""
        heads = L.chain_head(canonical).select(F.col("chain_id").cast("bigint").alias("chain_id"), "head_block")
        due_before = self.frontier(batch_id - 1).groupBy("chain_id").agg(F.max("head_block").alias("_head_before"))
        ranges = manifest.join(heads, "chain_id", "left").join(due_before, "chain_id", "left")
        changed = F.lit(False)
        for chain, number, _ in written:
            changed = changed | ((F.col("chain_id") == chain) & (F.col("rng") == number))
        for chain, _, block in reorgs:
            changed = changed | ((F.col("chain_id") == chain) & (F.col("rng") >= block // RANGE_BLOCKS))
        first, last = F.col("rng") * RANGE_BLOCKS, (F.col("rng") + 1) * RANGE_BLOCKS - 1
        due = F.col("_head_before").isNull() | ((first <= F.col("head_block") - self.depth) & (last > F.col("_head_before") - self.depth))
        picked = ranges.where(changed | due | ~F.col("mark").eqNullSafe(F.col("now"))).select("chain_id", "rng", "versions", "n_rows", "n_again")
        checked = self._ranges(picked)
        bad = self._mismatched(checked, batch_id, canonical, heads).groupBy(
            F.col("chain_id").cast("bigint").alias("chain_id"), "contract_address", F.col("_range").alias("rng")
        ).agg(F.min("block_number").alias("first_bad"))
        seen = self.spark.createDataFrame([(r.chain, r.number) for r in checked], "chain_id bigint, rng bigint")
        kept = self._table("mismatches", batch_id - 1, _BAD).join(seen, ["chain_id", "rng"], "left_anti")
        self._write(kept.select("chain_id", "contract_address", "rng", "first_bad").unionByName(bad.select("chain_id", "contract_address", "rng", "first_bad")), "mismatches", batch_id)
        return checked

    def _mismatched(self, ranges: list[Range], batch_id: int, canonical: DataFrame, heads: DataFrame) -> DataFrame:
        """The rows held in ``ranges``, not rewound, whose due block has another hash than the chain's.

        Which rows are held is asked for those of such blocks alone, so only they and the rows that may have replaced them
        are shuffled.
        """
        rows = self._versions(self._paths(ranges)) if self._paths(ranges) else self.spark.createDataFrame([], self.stored)
        rows = rows.where(~F.col("_gone"))
        block = ["chain_id", "block_number", "block_hash"]
        found = rows.select(*block).distinct().join(heads, "chain_id").where(F.col("block_number") <= F.col("head_block") - self.depth)
        real = canonical.select(*L.BLOCK, F.col("block_hash").alias("_real"))
        wrong = found.join(real, list(L.BLOCK), "left").where(~F.col("block_hash").eqNullSafe(F.col("_real"))).select(*block).distinct()
        self._write(wrong, "suspected", batch_id)
        wrong = self.spark.read.schema(wrong.schema).parquet(f"{self.folder}/suspected/batch={batch_id}")
        same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
        rows = rows.join(wrong, same(rows, wrong, block), "left_semi")
        rows = self._rewound(rows, batch_id).where(~F.col("_rewound"))
        several = self._paths(r for r in ranges if len(r.versions) > 1 and r.again != 0)
        if not several:
            return rows
        newer = self._versions(several).where(F.coalesce("_again", F.lit(True))).select(*L.IDENTITY, "_range", "_since")
        return rows.join(newer, [*same(rows, newer, (*L.IDENTITY, "_range")), newer["_since"] > rows["_since"]], "left_anti")

    def _advance(self, batch_id: int, canonical: DataFrame, frontier: DataFrame) -> int:
        """Move the frontier over the cycle's blocks and up to the first mismatch or the confirmation depth; the number of
        identities of the cycle."""
        top = self._versions([f"{self.folder}/rows/_version={batch_id}"]).where("not _gone").groupBy(
            F.col("chain_id").cast("bigint").alias("chain_id"), "contract_address"
        ).agg(F.max("block_number").alias("_top"), F.count(F.lit(1)).alias("_rows"))
        hashes = canonical.select(F.col("chain_id").cast("bigint").alias("chain_id"), F.col("block_number").alias("_at"), F.col("block_hash").alias("_hash"))
        bad = self._table("mismatches", batch_id, _BAD).groupBy(*L.CONTRACT).agg(F.min("first_bad").alias("first_bad"))
        heads = L.chain_head(canonical).select(F.col("chain_id").cast("bigint").alias("chain_id"), "head_block")
        moved = frontier.join(top, list(L.CONTRACT), "full")
        ahead = F.coalesce(F.col("_top") > F.col("last_scanned_block"), F.col("_top").isNotNull())
        moved = moved.withColumn("_at", F.when(ahead, F.col("_top")).otherwise(F.col("last_scanned_block")))
        moved = moved.join(hashes, ["chain_id", "_at"], "left").join(bad, list(L.CONTRACT), "left").join(heads, "chain_id", "left")
        moved = moved.select(
            *L.CONTRACT, F.coalesce("reorg", F.lit(False)).alias("reorg"), "orphan_from_block", F.col("_at").alias("last_scanned_block"),
            F.when(ahead, F.col("_hash")).otherwise(F.col("last_scanned_block_hash")).alias("last_scanned_block_hash"),
            F.least("_at", F.col("head_block") - self.depth, F.col("first_bad") - 1).alias("last_confirmed_block"), "first_bad", "head_block",
        )
        self._write(moved.coalesce(1), "frontier", batch_id)
        return top.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]

    # --- reading --------------------------------------------------------------------------------------------

    def view(self, batch_id: int | None = None) -> DataFrame:
        """All rows held after a cycle (the last one) with ``confirmation_state`` and ``is_orphaned``."""
        batch_id = self.last_batch() if batch_id is None else batch_id
        rows = self._rewound(self.rows_of(self._ranges(self.manifest(batch_id))), batch_id)
        frontier = self.frontier(batch_id).select(*L.CONTRACT, "first_bad", "head_block")
        placed = spread_lookup(rows, frontier, L.CONTRACT, "tx_hash")
        above = F.coalesce(F.col("block_number") >= F.col("first_bad"), F.lit(False)) | F.col("_rewound")
        due = F.coalesce(F.col("block_number") <= F.col("head_block") - self.depth, F.lit(False))
        state = F.when(due & ~above, "confirmed").otherwise("observed")
        return placed.select(*self.columns, state.alias("confirmation_state"), above.alias("is_orphaned"))


def ledger_stream(logs: DataFrame, ledger: Ledger, checkpoint: str, canonical: Callable[[], DataFrame]) -> StreamingQuery:
    """Run all available files through the ledger; progress, histories and restart come from ``checkpoint``.

    ``canonical`` (chain_id, block_number, block_hash; one row per block) is read anew in every cycle.
    """
    spark = ledger.spark
    rest = [c for c in ledger.columns if c not in (*L.IDENTITY, *L.ARRIVAL)]
    logs = logs.withColumn("_cycle", F.current_timestamp())  # one value in all of a cycle
    histories = logs.groupBy(*L.IDENTITY).agg(
        F.collect_set(F.struct(*L.ARRIVAL, *rest)).alias("history"), F.min("_cycle").alias("first_cycle"), F.max("_cycle").alias("last_cycle")
    )
    before = {name: spark.conf.get(name, None) for name in _STREAM_CONF}
    for name, value in _STREAM_CONF.items():
        spark.conf.set(name, value)
    try:
        return (
            histories.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda touched, batch_id: ledger.process(touched, batch_id, canonical())).start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
