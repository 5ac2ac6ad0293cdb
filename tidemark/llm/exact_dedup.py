"""Exact deduplication against a minimal perfect hash of historical digests.

The distinct digests seen earlier are cut into shards by their own bits. Each shard gets a minimal perfect hash: ``n``
digests map onto slots ``0..n-1`` without a gap, steered by one small pilot per bucket of about two digests. A slot holds
the full 32-byte digest and the locator of the row that won its group. A new digest is sent to its shard, evaluated,
and compared byte by byte with the digest in its slot: equal means repeat, unequal means nonmember. Nonmembers are
grouped among themselves.

Copies collapse before anything is shuffled (one row per digest and task), so a group holding a third of all rows costs
as much as any other, and a shard is bounded because digests are uniform.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import attach, digest_of, keep_marked, settle

SHARD_DIGESTS = 16_384
_INDEX = "shard int, n bigint, pilots binary, digests binary, winners binary, sizes binary"
_FOUND = "digest binary, winner bigint, size bigint, member boolean"


def digest_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest)`` per row: SHA-256 of the whole text in UTF-8, null text as empty."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), digest_of(text).alias("digest"))


def distinct_digests(digests: DataFrame) -> DataFrame:
    """One row per digest: the winning (largest) id and how many rows share it; a null id wins only alone."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.reshape(-1, 32).view("<u8").reshape(-1, 4)


def _slots(words: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slot of each digest under its bucket's pilot."""
    pilot = pilots[(words[:, 1] % np.uint64(len(pilots))).astype(np.int64)].astype(np.uint64)
    step = words[:, 3] | np.uint64(1)
    mixed = (words[:, 2] ^ (pilot * np.uint64(0x9E3779B97F4A7C15))) * step
    return ((mixed >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def build_pilots(digests: np.ndarray) -> np.ndarray:
    """Pilots that make the slots of distinct ``digests`` (n x 32 bytes) a permutation of ``0..n-1``.

    Buckets are placed from the fullest down, each taking the first pilot whose slots are all free. When the remaining
    buckets hold one digest each, the search goes on over many pilots at once.
    """
    words = _words(digests)
    n = len(words)
    buckets = max(1, (n + 1) // 2)
    pilots = np.zeros(buckets, np.uint32)
    of = (words[:, 1] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    taken = np.zeros(n, bool)
    tries = 32
    for bucket in np.argsort(-sizes, kind="stable"):
        size = int(sizes[bucket])
        if not size:
            break
        own = words[order[starts[bucket] : starts[bucket] + size]]
        base, tries = 0, 32 if size > 1 else tries
        while True:
            some = np.arange(base, base + tries, dtype=np.uint64)[:, None]
            mixed = (own[:, 2][None, :] ^ (some * np.uint64(0x9E3779B97F4A7C15))) * (own[:, 3] | np.uint64(1))[None, :]
            at = ((mixed >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            fits = ~taken[at].any(axis=1)
            if size > 1:
                ranked = np.sort(at, axis=1)
                fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            found = np.flatnonzero(fits)
            if len(found):
                pilots[bucket] = base + int(found[0])
                taken[at[found[0]]] = True
                break
            base += tries
            tries = min(tries * 2, 1 << 15)
            if base > 0xFFFF0000:
                raise ValueError("two digests of one shard are equal; the history must be distinct")
    return pilots


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(frame["digest"]), np.uint8).reshape(-1, 32)
    pilots = build_pilots(digests)
    at = _slots(_words(digests), pilots, len(digests))
    slots, winners, sizes = np.empty_like(digests), np.zeros(len(at), "<i8"), np.zeros(len(at), "<i8")
    # A null winner is stored as the least long.
    slots[at] = digests
    winners[at] = [np.iinfo("i8").min if pd.isna(w) else int(w) for w in frame["winner"]]
    sizes[at] = frame["size"].to_numpy()
    row = {"shard": int(frame["shard"].iloc[0]), "n": len(at), "pilots": pilots.tobytes(), "digests": slots.tobytes()}
    return pd.DataFrame([row | {"winners": winners.tobytes(), "sizes": sizes.tobytes()}])


def _shard(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of ``history`` (digest, winner, size; digests distinct): one row per shard, storable as a table."""
    return history.select(_shard(shards), "digest", "winner", "size").groupBy("shard").applyInPandas(_build, _INDEX)


def _look_up(index: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    if not len(fresh):
        return pd.DataFrame({"digest": [], "winner": [], "size": [], "member": []})
    winner = fresh["winner"].astype("Int64")
    size, member = fresh["size"].to_numpy(copy=True), np.zeros(len(fresh), bool)
    if len(index):
        shard = index.iloc[0]
        digests = np.frombuffer(b"".join(fresh["digest"]), np.uint8).reshape(-1, 32)
        at = _slots(_words(digests), np.frombuffer(shard["pilots"], np.uint32), int(shard["n"]))
        member = (np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)[at] == digests).all(axis=1)
        size = size + np.where(member, np.frombuffer(shard["sizes"], "<i8")[at], 0)
        old = np.frombuffer(shard["winners"], "<i8")[at]
        own = winner.fillna(np.iinfo("i8").min).to_numpy("i8")
        best = np.where(member, np.maximum(old, own), own)
        winner = pd.Series(best, dtype="Int64").mask(best == np.iinfo("i8").min)
    return pd.DataFrame({"digest": fresh["digest"].to_numpy(), "winner": winner.to_numpy(), "size": size, "member": member})


def look_up(index: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """Every row of ``fresh`` (digest, winner, size) with ``member`` and, for members, winner and size of both sides."""
    routed = fresh.select(_shard(shards), "digest", "winner", "size")
    return index.groupBy("shard").cogroup(routed.groupBy("shard")).applyInPandas(_look_up, _FOUND)


def shard_count(*digest_tables: DataFrame) -> int:
    return max(1, *(-(-table.count() // SHARD_DIGESTS) for table in digest_tables))


def groups(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(digest, winner, size)`` of every digest in either table of ids and digests, through the index of ``history``."""
    old, new = settle(distinct_digests(history), "history"), settle(distinct_digests(fresh), "fresh")
    shards = shard_count(old, new)
    index = settle(build_index(old, shards), "mph")
    found = settle(look_up(index, new, shards), "found")
    repeats = found.where("member").select(F.col("digest").alias("_seen"))
    alone = old.join(repeats, F.col("digest") == F.col("_seen"), "left_anti")
    return alone.unionByName(found.select("digest", "winner", "size"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The ids up to the middle of the id range act as history, the rest as newly arrived. Arrivals with one digest are
    collapsed before the look-up, so nonmembers come grouped out of it. Of equal texts the row with the largest id stays.
    Null text equals empty text. Rows that repeat id and text are all marked kept, as they cannot be told apart. A null id is kept only where no row of the group has an id. An empty
    table gives an empty result.
    """
    rows = settle(digest_table(docs, doc_id, text), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    all_groups = settle(groups(rows.where(old), rows.where(~old)), "groups")
    named = attach(rows, all_groups, "digest", "size")
    return named.select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, with all their columns; of rows repeating id and text, one."""
    return keep_marked(docs, dedup(docs).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"))
