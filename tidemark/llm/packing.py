"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most ``CAPACITY`` tokens. Planning sees only how many pieces there are of each length, at
most ``CAPACITY`` numbers whatever the corpus. The sums of one and of two available lengths are indexed under their value;
triples are one length and an indexed pair. Working down from the longest length, the gap it leaves is looked up in the
index; a combination that fills the gap is consumed as often as the availability counts allow. What finds no complement
goes, longest first, into the open sequence with the least room that still fits.

Several plans are made: with exact complements only or with ones that leave a few tokens open, with all lengths in them or
with the short ones spared for the last gaps, behind all lengths or behind long ones only; and with best fit alone. The first
with the fewest sequences is taken, so there are never more of them than best fit needs.

The plan is a list of rank ranges: pieces of one length, ranked, go to consecutive sequences, in each as many as fit. Ranks are
counted per (length, slice) and shifted by the slices before, so a length that a third of all pieces share is ranked by
many tasks; the ranges are joined by a broadcast whose size is bounded by the capacity.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import settle, text_of

CAPACITY = 2_048
# The plans that compete, by shares of the capacity and tokens: the least length in a complement, the tokens a complement
# may leave open, the least length whose gap is filled. None is best fit alone, which is taken only where it needs fewer sequences.
PLANS = ((2048, 0, 2), (2048, 0, 2048), (32, 0, 4), (2048, 8, 2), (2048, 8, 2048), None)
# Pieces ranked by one task.
SLICE_ROWS = 1 << 16
END_ID = 0
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Encoder:
    """Token ids of whole texts as little-endian bytes, equal to the tokenizers library with the same file.

    A text is one call and its ids stay one buffer. Nothing is kept from text to text: corpora have more words than a worker
    could remember, and a word on its own costs more than it does within its text.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _byte_table()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte_of for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {k: i for k, i in ranks.items() if i not in special.values()}
        self.library = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        return self.library.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def _byte_table() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


@lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def cuts(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all of ``capacity`` but the first, which takes the remainder."""
    head = (total - 1) % capacity + 1
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))]


def _cutter(path: str, capacity: int, with_ids: bool):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        end = END_ID.to_bytes(4, "little")
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                ids = memoryview(encode(text) + end)
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part), *([bytes(part)] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64"})

    return cut


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's ids followed by id 0, in pieces of at most ``capacity``; ``ids`` holds them where asked for.

    Null text is empty and gives one piece of one token. Repeated rows give repeated pieces.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(_cutter(path, capacity, with_ids), _PIECES + (", ids binary" if with_ids else ""))


class _Stock:
    """How many pieces of each length are left and handed out, and which available lengths add up to a sum."""

    def __init__(self, counts: dict[int, int], capacity: int, least: int, slack: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.used = np.zeros(capacity + 1, np.int64)
        self.slack = slack
        lengths = np.flatnonzero(self.left)
        self.single = lengths[lengths >= least]
        # Pair sums in one array, ordered by sum and then by the larger part from above; ``at`` is where a sum begins.
        i, j = np.tril_indices(len(self.single))
        large, sums = self.single[i], self.single[i] + self.single[j]
        large, sums = large[sums < capacity], sums[sums < capacity]
        order = np.lexsort((-large, sums))
        self.large, self.at = large[order], np.searchsorted(sums[order], np.arange(capacity + 2))

    def most(self, lengths: tuple[int, ...]) -> int:
        """How often this combination can be taken."""
        need = np.unique(lengths, return_counts=True)
        return int((self.left[need[0]] // need[1]).min())

    def take(self, length: int, count: int) -> int:
        first = int(self.used[length])
        self.left[length] -= count
        self.used[length] += count
        return first

    def complement(self, length: int) -> tuple[int, ...] | None:
        """Up to three available lengths that fill the gap behind ``length`` but for the slack; the fullest first, then
        fewest pieces, then longest."""
        gap = len(self.left) - 1 - length
        if gap <= self.slack:
            return ()
        self.left[length] -= 1
        try:
            for total in range(gap, max(gap - self.slack, 1) - 1, -1):
                found = self._one(total) or self._pair(total, total) or self._triple(total)
                if found:
                    return found
            return None
        finally:
            self.left[length] += 1

    def _one(self, total: int) -> tuple[int] | None:
        at = np.searchsorted(self.single, total)
        return (total,) if at < len(self.single) and self.single[at] == total and self.left[total] else None

    def _pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The pair with this sum whose larger part is largest, at most ``most``."""
        large = self.large[self.at[total] : self.at[total + 1]]
        large = large[large <= most]
        fits = np.flatnonzero((self.left[large] > 0) & (self.left[total - large] > np.where(2 * large == total, 1, 0)))
        return (int(large[fits[0]]), total - int(large[fits[0]])) if len(fits) else None

    def _triple(self, total: int) -> tuple[int, int, int] | None:
        first = self.single[(3 * self.single >= total) & (self.single < total)]
        first = first[(self.left[first] > 0) & (self.at[total - first] < self.at[total - first + 1])]
        for longest in first[::-1].tolist():
            self.left[longest] -= 1
            pair = self._pair(total - longest, longest)
            self.left[longest] += 1
            if pair:
                return (longest, *pair)
        return None


def blocks(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rank ranges ``(length, first_rank, count, first_sequence, offset, across)`` for ``counts`` pieces of each length.

    A range fills ``across`` consecutive sequences, one piece in each and then, ``length`` further on, one more in each.
    The number of ranges depends on the number of distinct lengths, not on the number of pieces: every step uses up a
    length or a kind of open sequence. Of ``PLANS`` the first with the fewest sequences is taken.
    """
    bound = -(-sum(length * count for length, count in counts.items()) // capacity)
    best, fewest = [], None
    for kind in PLANS:
        ranges, sequences = _blocks(counts, capacity, kind)
        if fewest is None or sequences < fewest:
            best, fewest = ranges, sequences
        if fewest == bound:
            break
    return best


def _blocks(counts: dict[int, int], capacity: int, kind: tuple[int, int, int] | None) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """One plan and its number of sequences."""
    stock = _Stock(counts, capacity, max(1, capacity // kind[0]) if kind else capacity + 1, kind[1] if kind else 0)
    out, sequences = [], 0
    rest: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while kind and length >= capacity // kind[2] and stock.left[length]:
            mates = stock.complement(length)
            if mates is None:
                break
            combination = (length, *mates)
            times, offset = stock.most(combination), 0
            for part in combination:
                out.append((part, stock.take(part, times), times, sequences, offset, times))
                offset += part
            sequences += times
        if stock.left[length]:
            rest.append((length, int(stock.left[length])))
            stock.left[length] = 0
    # Open sequences by the room they have: (first sequence, count) runs of equal filling.
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, count in rest:
        while count:
            room = next((r for r in range(length, capacity) if open_runs[r]), capacity)
            each = room // length
            if room < capacity:
                first, runs = open_runs[room].pop()
            else:
                first, runs = sequences, -(-count // each)
                sequences += runs
            # Best fit puts the next piece of the length where the last one went while there is room.
            full = min(runs, count // each)
            for times, pieces in ((full, each), (1 if full < runs else 0, count - full * each)):
                if times and pieces:
                    out.append((length, stock.take(length, times * pieces), times * pieces, first, capacity - room, times))
                    open_runs[room - pieces * length].append((first, times))
                    first, runs, count = first + times, runs - times, count - times * pieces
            if runs:
                open_runs[room].append((first, runs))
    return out, sequences


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``blocks`` place by place: rank ranges ``(length, first_rank, count, first_sequence, offset)`` of one piece per sequence."""
    return [
        (length, first + place * across, across, sequence, offset + place * length)
        for length, first, count, sequence, offset, across in blocks(counts, capacity) for place in range(count // across)
    ]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows with doc_id, piece and length, best a written table) with ``sequence_id`` and ``offset``."""
    slices = max(1, -(-cut.count() // SLICE_ROWS))
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    per = settle(sliced.groupBy("length", "_slice").agg(F.count("*").alias("n")), "slices")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("length", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("_rank", F.row_number().over(own) - 1).join(shift, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_shift"))
    schema = "_length bigint, _first bigint, _count bigint, _sequence bigint, _offset bigint, _across bigint"
    ranges = cut.sparkSession.createDataFrame(blocks(counts, capacity), schema)
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    placed = ranked.join(F.broadcast(ranges), here)
    sequence = F.col("_sequence") + (F.col("_rank") - F.col("_first")) % F.col("_across")
    offset = F.col("_offset") + F.expr("(_rank - _first) div _across") * F.col("length")
    return placed.select(*cut.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: the columns of ``pieces``, sequence_id and offset."""
    return pack(settle(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
