"""Event-ledger reconciliation: decoding, identity resolution, confirmation, derived state, health.

Everything is partitioned by (chain_id, contract_address). Per-contract facts are aggregates with map-side
partials; where they come back to the rows, the lookup is spread, since one contract may hold most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.literal import literal_table
from tidemark.functions.joins import spread_lookup
from tidemark.functions.ordered import with_previous
from tidemark.functions.scalars import ADDRESS_TEXT, INTEGER_TEXT
from tidemark.functions.uint256 import WORD, decimal_text

IDENTITY = ("chain_id", "tx_hash", "log_index")
CONTRACT = ("chain_id", "contract_address")
BLOCK = ("chain_id", "block_number")
# Deal ids are each contract's own counter.
DEAL = (*CONTRACT, "deal_id")
ARRIVAL = ("observed_at", "ord1", "ord2", "block_hash")
BLOCK_ORDER = ("block_number", "tx_index", "log_index", "tx_hash")
# Identities are counted in so many groups by hash; those of a group with more rows than one task should hold are busy.
IDENTITY_GROUPS = 1 << 20
BUSY_ROWS = 1_000_000

# The six indexed events, their fields in order, each field's kind and where the log keeps it
# ("t1" = first indexed topic, "d0" = first data word, "s5" = text whose offset is data word 5).
EVENT_FIELDS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "RiskEscrowCreated": (
        ("dealId", "uint", "t1"), ("quoteId", "bytes32", "t2"), ("depositor", "address", "t3"),
        ("counterparty", "address", "d0"), ("settlementAsset", "address", "d1"), ("notional", "uint", "d2"),
        ("collateralLocked", "uint", "d3"), ("settlementDeadline", "uint", "d4"), ("modelVersion", "text", "s5"),
        ("riskSnapshotHash", "bytes32", "d6"),
    ),
    "RiskEscrowSettled": (
        ("dealId", "uint", "t1"), ("counterparty", "address", "t2"), ("payout", "uint", "d0"), ("platformFee", "uint", "d1"),
        ("depositorRefund", "uint", "d2"),
    ),
    "RiskEscrowRefunded": (("dealId", "uint", "t1"), ("depositor", "address", "t2"), ("amount", "uint", "d0")),
    "RiskOracleUpdated": (("previousOracle", "address", "t1"), ("newOracle", "address", "t2")),
    "PlatformFeeUpdated": (("previousFeeBps", "uint", "d0"), ("newFeeBps", "uint", "d1")),
    "PlatformWalletUpdated": (("previousWallet", "address", "d0"), ("newWallet", "address", "d1")),
}
DEAL_EVENTS = ("RiskEscrowCreated", "RiskEscrowSettled", "RiskEscrowRefunded")
TERMINAL_EVENTS = {"RiskEscrowSettled": "settled", "RiskEscrowRefunded": "refunded"}
RPC_STALE_SECONDS = 60
LAG_SLACK_BLOCKS = 10


# --- decoding -------------------------------------------------------------------------------------------------


def _word(where: str) -> str:
    index = int(where[1:])
    return f"substring(topics[{index}], 3, {WORD})" if where[0] == "t" else f"substring(data, {3 + WORD * index}, {WORD})"


def _decode(kind: str, where: str) -> str:
    """SQL text of one decoded field other than a number."""
    word = _word(where)
    if kind == "address":
        return f"concat('0x', right({word}, 40))"
    if kind == "bytes32":
        return f"concat('0x', {word})"
    # Dynamic text: the head word is a byte offset to (length, bytes).
    number = lambda w: f"cast(conv(right({w}, 8), 16, 10) as int)"
    start = f"(3 + 2 * {number(word)})"
    length = number(f"substring(data, {start}, {WORD})")
    return f"decode(unhex(substring(data, {start} + {WORD}, 2 * {length})), 'UTF-8')"


def _per_event(build) -> str:
    """SQL text choosing ``build(fields)`` by event name."""
    return "case event_name " + " ".join(f"when '{event}' then {build(fields)}" for event, fields in EVENT_FIELDS.items()) + " end"


def decode_logs(logs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Raw logs (identity, block columns, topics ARRAY<STRING>, data STRING) to named events with a field map.

    ``signatures`` is the short table (topic0, event_name); logs with another topic0 are dropped. Adds ``event_name``,
    ``decoded`` MAP<STRING,STRING> and ``deal_id`` (only for the three deal events). No Python is involved.
    """
    named = logs.withColumn("topic0", F.lower(F.get("topics", F.lit(0)))).join(signatures, "topic0").drop("topic0")
    # All numbers of a row are gathered and decoded by one lambda: spelled out per field, the generated code would
    # outgrow what the JVM compiles.
    words = _per_event(lambda fields: "array(" + ", ".join(_word(where) for _, kind, where in fields if kind == "uint") + ")")
    numbers = F.expr(f"transform({words}, w -> {decimal_text('w')})")

    def entries(fields) -> str:
        position, parts = 0, []
        for name, kind, where in fields:
            parts.append(f"'{name}', " + (f"_numbers[{position}]" if kind == "uint" else _decode(kind, where)))
            position += kind == "uint"
        return "map(" + ", ".join(parts) + ")"

    named = named.withColumn("_numbers", numbers)
    decoded = F.expr(_per_event(entries))
    rest = [c for c in logs.columns if c not in ("topics", "data")]
    return with_deal_id(named.withColumn("decoded", decoded).select(*rest, "event_name", "decoded"))


def with_deal_id(events: DataFrame) -> DataFrame:
    number = F.col("decoded")["dealId"].try_cast("bigint")
    return events.withColumn("deal_id", F.when(F.col("event_name").isin(*DEAL_EVENTS), number))


def event_fields(events: DataFrame, json_col: str = "decoded_json") -> DataFrame:
    """The stored JSON text as a string map.

    The parsed map is generated, not projected: a later filter on many of its fields is then not pushed below the
    parsing and does not parse the text once per field.
    """
    return events.withColumn("decoded", F.explode(F.array(F.from_json(json_col, "map<string,string>"))))


def field_error() -> Column:
    """The first missing or malformed field of ``decoded`` for the row's event, null when complete."""

    def check(name: str, kind: str) -> Column:
        value = F.col("decoded")[name]
        missing = F.when(value.isNull(), F.lit(f'missing field "{name}"'))
        said = lambda what: F.concat(F.lit(f'field "{name}": invalid {what} "'), value, F.lit('"'))
        if kind == "uint":
            return F.coalesce(missing, F.when(~value.rlike(INTEGER_TEXT), said("decimal integer")))
        if kind == "address":
            return F.coalesce(missing, F.when(~value.rlike(ADDRESS_TEXT), said("address")))
        if kind == "bytes32":
            return F.coalesce(missing, F.when(~value.rlike("^(0[xX])?[0-9a-fA-F]{64}$"), said("bytes32")))
        return missing

    error = F.lit(None).cast("string")
    for event, fields in EVENT_FIELDS.items():
        error = F.when(F.col("event_name") == event, F.coalesce(*[check(n, k) for n, k, _ in fields])).otherwise(error)
    return error


def invalid_events(events: DataFrame) -> DataFrame:
    return events.withColumn("reason", field_error()).where(F.col("reason").isNotNull())


def valid_events(events: DataFrame) -> DataFrame:
    return events.where(field_error().isNull())


# --- identity -------------------------------------------------------------------------------------------------


def observation_outcomes(observations: DataFrame, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """What each observation did, in arrival order per identity: inserted, updated_reorg or duplicate_ignored.

    A different block hash than the row held before replaces it. Exact copies of an observation collapse first and
    are reported as one row with ``n_observations``.

    Rows travel once, to their identity, and all that follows per identity finds them there. Identities of groups with more
    than ``busy_rows`` rows are left out of that: their copies collapse before they travel, and they are ordered by day.
    """
    columns = observations.columns
    group = F.pmod(F.xxhash64(*IDENTITY), F.lit(IDENTITY_GROUPS))
    # At most one number per ``busy_rows`` rows.
    sizes = observations.groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    busy = [r["_group"] for r in sizes.where(F.col("_n") > busy_rows).collect()]
    copies = lambda rows: rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    arrival = W.partitionBy(*IDENTITY).orderBy(*ARRIVAL)
    usual = observations.where(~group.isin(busy)) if busy else observations
    outcomes = _outcomes(copies(usual.repartition(*IDENTITY)).withColumn("_held", F.lag("block_hash").over(arrival)), columns)
    if not busy:
        return outcomes
    by_day = with_previous(copies(observations.where(group.isin(busy))), IDENTITY, F.to_date("observed_at"), ARRIVAL, "block_hash", "_held")
    return outcomes.unionByName(_outcomes(by_day, columns))


def _outcomes(stepped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Outcomes of distinct observations with their number ``_n`` and the hash ``_held`` before them."""
    first = (
        F.when(F.col("_held").isNull(), "inserted")
        .when(F.col("_held") != F.col("block_hash"), "updated_reorg")
        .otherwise("duplicate_ignored")
    )
    ignored = F.lit("duplicate_ignored")
    split = F.filter(
        F.array(
            F.when(first != ignored, F.struct(first.alias("outcome"), F.lit(1).cast("bigint").alias("n_observations"))),
            F.when(
                (first == ignored) | (F.col("_n") > 1),
                F.struct(ignored.alias("outcome"), (F.col("_n") - F.when(first == ignored, 0).otherwise(1)).alias("n_observations")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return stepped.select(*columns, F.inline(split))


def mark_current(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` with ``is_current``: the last accepted observation of its identity."""
    accepted = F.col("outcome") != "duplicate_ignored"
    newest = W.partitionBy(*IDENTITY).orderBy(accepted.desc(), *[F.desc(c) for c in ARRIVAL])
    return outcomes.withColumn("is_current", accepted & (F.row_number().over(newest) == 1))


def current_rows(marked: DataFrame) -> DataFrame:
    """The marked rows without what they did."""
    rest = [c for c in marked.columns if c not in (*IDENTITY, "outcome", "n_observations", "is_current")]
    return marked.where("is_current").select(*IDENTITY, *rest)


def observation_current(outcomes: DataFrame) -> DataFrame:
    """The row each identity holds now: its last accepted observation."""
    return current_rows(mark_current(outcomes))


# --- scanning and re-organisations ----------------------------------------------------------------------------


def split_range(ranges: DataFrame, max_blocks: int, max_scans: int) -> DataFrame:
    """Block ranges (contract, from_block, to_block) into chunks of ``max_blocks``, at most ``max_scans`` per cycle."""
    size = max(max_blocks, 1)
    capped = ranges.withColumn("batch_end", F.least("to_block", F.col("from_block") + size * max_scans - 1))
    chunks = capped.where(F.col("from_block") <= F.col("batch_end")).select(
        *CONTRACT, "batch_end", F.explode(F.sequence("from_block", "batch_end", F.lit(size).cast("bigint"))).alias("chunk_from")
    )
    return chunks.withColumn("chunk_to", F.least(F.col("chunk_from") + size - 1, F.col("batch_end")))


def reconcile_frontier(checkpoints: DataFrame, canonical: DataFrame, depth: int, start_block: int) -> DataFrame:
    """Compare each checkpoint's stored hash with its canonical chain (chain_id, block_number, block_hash); rewind on a mismatch."""
    window = max(depth, 1)
    last = F.col("last_scanned_block")
    known = (last != 0) & (F.coalesce(F.col("last_scanned_block_hash"), F.lit("")) != "")
    target = F.when(last <= window, F.lit(start_block)).otherwise(F.greatest(last - window, F.lit(start_block))).cast("bigint")
    at = lambda name: canonical.select("chain_id", F.col("block_number").alias(f"_{name}"), F.col("block_hash").alias(f"_{name}_hash"))
    checked = (
        checkpoints.withColumn("_now", last).join(at("now"), ["chain_id", "_now"], "left")
        .withColumn("reorg", known & ~F.col("_now_hash").eqNullSafe(F.col("last_scanned_block_hash")))
        .withColumn("_to", F.when(F.col("reorg"), target).otherwise(last))
    )
    rewound = checked.join(at("to"), ["chain_id", "_to"], "left")
    return rewound.select(
        *CONTRACT, "reorg",
        F.when(F.col("reorg"), F.col("_to") + 1).alias("orphan_from_block"),
        F.col("_to").alias("last_scanned_block"),
        F.when(F.col("reorg"), F.when(F.col("_to") != 0, F.col("_to_hash"))).otherwise(F.col("last_scanned_block_hash")).alias("last_scanned_block_hash"),
        F.least("last_confirmed_block", F.when(F.col("reorg"), F.col("_to")).otherwise(F.col("last_confirmed_block"))).alias("last_confirmed_block"),
    )


def orphan_from(events: DataFrame, frontier: DataFrame) -> DataFrame:
    """Flag every non-orphaned row at or above its contract's ``orphan_from_block``; confirmed ones too."""
    marks = frontier.where(F.col("orphan_from_block").isNotNull()).select(*CONTRACT, "orphan_from_block")
    joined = spread_lookup(events, marks, CONTRACT, "tx_hash")
    hit = F.coalesce(F.col("block_number") >= F.col("orphan_from_block"), F.lit(False))
    return joined.withColumn("is_orphaned", F.col("is_orphaned") | hit).drop("orphan_from_block")


def chain_head(canonical: DataFrame) -> DataFrame:
    """The highest known block of every chain."""
    return canonical.groupBy("chain_id").agg(F.max("block_number").alias("head_block"))


def pending_blocks(events: DataFrame, canonical: DataFrame, depth: int) -> DataFrame:
    """Distinct (contract, block, hash) still to be confirmed at or below the head of their chain - depth."""
    return _due_blocks(events, canonical, depth).drop("head_block")


def _due_blocks(events: DataFrame, canonical: DataFrame, depth: int) -> DataFrame:
    """Waiting blocks with the head of their chain. They are made distinct first, so the lookup sees blocks and not events."""
    waiting = events.where((F.col("confirmation_state") == "observed") & ~F.col("is_orphaned"))
    blocks = waiting.select(*CONTRACT, "block_number", "block_hash").distinct()
    headed = spread_lookup(blocks, chain_head(canonical), ["chain_id"], "block_hash", how="inner")
    return headed.where(F.col("block_number") <= F.col("head_block") - depth)


def first_mismatch(events: DataFrame, canonical: DataFrame, depth: int) -> DataFrame:
    """Per contract with due blocks: the lowest one whose hash is not its chain's (null if none), and the chain's head."""
    real = canonical.select(*BLOCK, F.col("block_hash").alias("_real"))
    checked = _due_blocks(events, canonical, depth).join(real, list(BLOCK), "left")
    bad = ~F.col("block_hash").eqNullSafe(F.col("_real"))
    return checked.groupBy(*CONTRACT).agg(
        F.min(F.when(bad, F.col("block_number"))).alias("first_bad"), F.max("head_block").alias("head_block")
    )


def confirm_blocks(events: DataFrame, canonical: DataFrame, depth: int, mismatch: DataFrame | None = None) -> DataFrame:
    """Confirm pending rows up to their chain's head - depth, stopping at a contract's first mismatching block.

    That block and everything above it is orphaned, rows confirmed earlier included (``was_confirmed`` tells). A
    contract without due blocks has nothing to confirm. ``mismatch`` is the ``first_mismatch`` of the same arguments where
    the caller has written it: its size is then known beforehand, and the events are not shuffled to meet a few rows.
    """
    mismatch = first_mismatch(events, canonical, depth) if mismatch is None else mismatch
    joined = spread_lookup(events, mismatch, CONTRACT, "tx_hash")
    block = F.col("block_number")
    above = F.coalesce(block >= F.col("first_bad"), F.lit(False))
    waiting = (F.col("confirmation_state") == "observed") & ~F.col("is_orphaned")
    confirmed = waiting & ~above & F.coalesce(block <= F.col("head_block") - depth, F.lit(False))
    return (
        joined.withColumn("was_confirmed", F.col("confirmation_state") == "confirmed")
        .withColumn("confirmation_state", F.when(confirmed, "confirmed").otherwise(F.col("confirmation_state")))
        .withColumn("is_orphaned", F.col("is_orphaned") | above)
        .drop("first_bad", "head_block")
    )


def as_observed(current: DataFrame) -> DataFrame:
    """Freshly resolved rows enter confirmation as observed and not orphaned."""
    return current.withColumn("confirmation_state", F.lit("observed")).withColumn("is_orphaned", F.lit(False))


# --- derived state --------------------------------------------------------------------------------------------


def derive_deals(
    events: DataFrame, pending: DataFrame, order: Sequence[str], facts: Sequence[str], end_facts: Sequence[str] = ()
) -> DataFrame:
    """Deal rows from confirmed events, merged with pending rows of the application.

    Per quote the last Created wins; per deal of a contract the first terminal event after it decides the status.
    ``facts`` are the Created columns that overwrite the pending row's columns of the same name, ``end_facts`` the
    columns of the terminal event kept as ``terminal_<name>``. Pending rows without events stay.
    """
    place = F.struct(*order)
    created = (
        events.where(F.col("event_name") == "RiskEscrowCreated").groupBy("quote_id")
        .agg(F.max_by(F.struct(*DEAL, *facts, place.alias("_at")), place).alias("_c"))
        .select("quote_id", *[F.col("_c")[f].alias(f) for f in (*DEAL, *facts, "_at")])
    )
    terminal = events.where(F.col("event_name").isin(*TERMINAL_EVENTS)).select(
        *DEAL, place.alias("_end_at"), F.struct("event_name", *end_facts).alias("_end")
    )
    last_start = created.groupBy(*DEAL).agg(F.max("_at").alias("_at"))
    ended = (
        terminal.join(last_start, list(DEAL)).where(F.col("_end_at") > F.col("_at"))
        .groupBy(*DEAL).agg(F.min_by("_end", "_end_at").alias("_t"))
        .select(*DEAL, F.col("_t.event_name").alias("terminal_event"), *[F.col("_t")[f].alias(f"terminal_{f}") for f in end_facts])
    )
    status = F.lit("active")
    for event, name in TERMINAL_EVENTS.items():
        status = F.when(F.col("terminal_event") == event, name).otherwise(status)
    on_chain = created.drop("_at").join(ended, list(DEAL), "left").withColumn("_status", status)
    kept = pending.select(*[F.col(c).alias(f"_p_{c}") if c in (*facts, "status") else F.col(c) for c in pending.columns])
    merged = on_chain.join(kept, "quote_id", "full_outer")
    fallback = lambda f: F.coalesce(F.col(f), F.col(f"_p_{f}")) if f in pending.columns else F.col(f)
    extra = [c for c in pending.columns if c not in (*facts, "status", "quote_id")]
    return merged.select(
        "quote_id", *DEAL, *[fallback(f).alias(f) for f in facts], *extra,
        F.coalesce("_status", "_p_status").alias("status"), "terminal_event", *[f"terminal_{f}" for f in end_facts],
    )


def config_state(events: DataFrame) -> DataFrame:
    """Last oracle, fee and wallet per contract and the block of the last config event; a value never set is null."""
    place = F.struct(*BLOCK_ORDER)

    def latest(event: str, field: str, name: str) -> Column:
        value = F.col("decoded")[field]
        return F.max_by(value, F.when((F.col("event_name") == event) & value.isNotNull(), place)).alias(name)

    wanted = ("RiskOracleUpdated", "PlatformFeeUpdated", "PlatformWalletUpdated")
    return events.where(F.col("event_name").isin(*wanted)).groupBy(*CONTRACT).agg(
        latest("RiskOracleUpdated", "newOracle", "risk_oracle"),
        latest("PlatformFeeUpdated", "newFeeBps", "platform_fee_bps"),
        latest("PlatformWalletUpdated", "newWallet", "platform_wallet"),
        F.max("block_number").alias("updated_at_block"),
    )


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """One row per contract: the last write."""
    rest = [c for c in checkpoints.columns if c not in (*CONTRACT, "updated_at")]
    last = checkpoints.groupBy(*CONTRACT).agg(F.max(F.struct("updated_at", *rest)).alias("_l"))
    return last.select(*CONTRACT, F.col("_l.updated_at").alias("updated_at"), *[F.col("_l")[c].alias(c) for c in rest])


def event_state_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("confirmation_state", "is_orphaned", "event_name").agg(F.count(F.lit(1)).alias("n_events"))


def ingest_health(outcomes: DataFrame, confirmed: DataFrame, canonical: DataFrame, depth: int) -> DataFrame:
    """Per contract: head, scanned, confirmed, lag and the counters of what ingestion did."""
    counted = lambda name: F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("n_observations"))), F.lit(0))
    did = outcomes.groupBy(*CONTRACT).agg(
        F.max("block_number").alias("last_scanned_block"),
        (counted("inserted") + counted("updated_reorg")).alias("total_events_processed"),
        counted("duplicate_ignored").alias("duplicate_events_ignored"),
        counted("updated_reorg").alias("reorg_count"),
    )
    done = confirmed.groupBy(*CONTRACT).agg(
        F.coalesce(F.max(F.when((F.col("confirmation_state") == "confirmed") & ~F.col("is_orphaned"), F.col("block_number"))), F.lit(0)).alias("last_confirmed_block")
    )
    return (
        did.join(done, list(CONTRACT)).join(chain_head(canonical), "chain_id", "left")
        .withColumnRenamed("head_block", "chain_head")
        .withColumn("confirmation_depth", F.lit(depth))
        .withColumn("confirmed_lag_blocks", F.col("chain_head") - F.col("last_confirmed_block"))
    )


def classify_health(snapshots: DataFrame) -> DataFrame:
    """``health`` and ``detail`` for rows (last_successful_rpc_call, last_error, confirmed_lag_blocks, confirmation_depth, now).

    A null ``confirmation_depth`` stands for a snapshot that could not be fetched.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = (micros("now") - micros("last_successful_rpc_call")) / 1_000_000
    stale = F.col("last_successful_rpc_call").isNull() | (age > RPC_STALE_SECONDS)
    broken = stale & F.col("last_error").isNotNull() & (F.col("last_error") != "")
    lagging = F.col("confirmed_lag_blocks") > F.col("confirmation_depth") + LAG_SLACK_BLOCKS
    missing = F.col("confirmation_depth").isNull()
    said = F.concat(
        F.col("confirmed_lag_blocks").cast("string"), F.lit(" blocks behind head (expected up to ~"),
        F.col("confirmation_depth").cast("string"), F.lit(")."),
    )
    return snapshots.withColumn(
        "health", F.when(missing, "unreachable").when(stale, "degraded").when(lagging, "lagging").otherwise("healthy")
    ).withColumn(
        "detail",
        F.when(missing, "Could not reach the chain indexer’s health endpoint.")
        .when(broken, F.concat(F.lit("Last error: "), F.col("last_error")))
        .when(stale, f"No successful RPC call in over {RPC_STALE_SECONDS}s.")
        .when(lagging, said)
        .otherwise("Synced within the expected confirmation depth."),
    )


def signature_table(spark: SparkSession, topics: dict[str, str]) -> DataFrame:
    """(topic0, event_name) from a name -> topic0 mapping; six rows."""
    unknown = set(topics) - set(EVENT_FIELDS)
    if unknown:
        raise ValueError(f"not an indexed event: {sorted(unknown)}")
    return literal_table(spark, [(t.lower(), n) for n, t in topics.items()], "topic0 string, event_name string")
