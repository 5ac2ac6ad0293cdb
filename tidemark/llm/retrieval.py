"""Lexical retrieval packing: every window is filled with the documents that BM25 finds nearest to its first one.

Terms are token ids, so the statistics of the whole corpus (documents per term, mean length) are tables bounded by the
vocabulary. Documents are dealt into shards by their heaviest term, with a term's rank in the vocabulary standing for its
rarity (ids follow the order of merging), so that dealing needs no statistics: documents about the same thing meet, light
terms share a shard, and a term that is the heaviest of very many documents has several shards.
A shard holds about ``SHARD_TOKENS`` tokens whatever the corpus. It builds an inverted index of its documents and packs
them: a seed document opens a window, the index returns the unused documents by falling score, and they fill the window
greedily: those that fit whole go in, and the nearest that does not fit is cut once no whole one of at least
``WHOLE_SHARE`` of its score is left. The rest of a cut document is the next seed.

What a shard has left at its end, less than a window, is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.bpe import vocabulary
from tidemark.llm.common import settle, text_of
from tidemark.llm.tokens import array_encoder

CAPACITY = 4_096
SHARD_TOKENS = 1 << 21
END_ID = 2
WHOLE_SHARE = 0.5
K1, B = 1.2, 0.75
# Terms that more than this share of a shard's documents hold are scored by dense rows instead of lists.
DENSE_SHARE = 1 / 8
# Ids travel as text through pandas, which would turn long nullable numbers into floating point.
_ENCODED = "doc_id string, ids binary, doc_tokens bigint, term int"
_PIECES = "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def squeezed(ids: bytes, squeezer: zstandard.ZstdCompressor) -> bytes:
    """Ids as one compressed block: first all lowest bytes, then the next ones, as the higher ones are mostly alike."""
    return squeezer.compress(np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes())


def expanded(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, term, occurrences)`` of the distinct terms of each document, in this order."""
    lengths = [len(d) for d in docs]
    if not sum(lengths):
        return (np.zeros(0, np.int64),) * 3
    keys = np.sort(np.repeat(np.arange(len(docs), dtype=np.uint64) << np.uint64(32), lengths) | np.concatenate(docs).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def heaviest_terms(docs: list[np.ndarray]) -> np.ndarray:
    """The term of each document (none is empty) with the largest weight by rank and occurrences, the least of equal ones."""
    doc, term, tf = term_counts(docs)
    weight = np.log1p(term) * tf / (tf + K1)
    order = np.lexsort((-term, weight, doc))
    return term[order[np.append(np.flatnonzero(np.diff(doc)), len(doc) - 1)]] if len(doc) else term


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, doc_tokens, term)`` per row: the text's ids and the end id, squeezed, and the heaviest term."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, squeezer = array_encoder(path), zstandard.ZstdCompressor(level=1)
        for frame in frames:
            found = [np.append(ids, np.uint32(END_ID)) for ids in encode(frame["text"].tolist())]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "ids": [squeezed(f.astype("<u4").tobytes(), squeezer) for f in found],
                "doc_tokens": [len(f) for f in found], "term": heaviest_terms(found),
            })

    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(run, _ENCODED)


def document_counts(coded: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the ``size`` ids: every task sends one count per id, so does the result."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(size, np.int64)
        for frame in frames:
            held += np.bincount(term_counts([expanded(i) for i in frame["ids"]])[1], minlength=size)
        term = np.flatnonzero(held)
        yield pd.DataFrame({"term": term, "n": held[term]})

    summed = coded.select("ids").mapInPandas(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in summed.collect():
        out[row["term"]] = row["n"]
    return out


def inverse_frequency(held: np.ndarray, documents: int) -> np.ndarray:
    """BM25's idf of every term; positive."""
    return np.log1p((documents - held + 0.5) / (held + 0.5))


def shards_of(tokens: np.ndarray, size: int = SHARD_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of every heaviest term, from the tokens of its documents.

    Terms follow one another into a shard while it holds ``size`` tokens; one with more has shards of its own.
    """
    first, count = np.zeros(len(tokens), np.int64), np.ones(len(tokens), np.int64)
    shard = filled = 0
    for term in np.flatnonzero(tokens):
        own = int(tokens[term])
        if filled and filled + own > size:
            shard, filled = shard + 1, 0
        first[term] = shard
        if own > size:
            count[term] = -(-own // size)
            shard, filled = shard + int(count[term]), 0
        else:
            filled += own
    return first, count


class Index:
    """An inverted index of a shard: per term the documents that hold it with their weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.size = len(docs)
        doc, term, tf = term_counts(docs)
        length = np.array([len(d) for d in docs])[doc] if len(doc) else doc
        weights = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(docs))))
        held = np.bincount(term, minlength=len(idf))
        self.row = np.where(held > max(8, DENSE_SHARE * len(docs)), np.cumsum(held > max(8, DENSE_SHARE * len(docs))) - 1, -1)
        self.dense = np.zeros((int(self.row.max(initial=-1)) + 1, len(docs)))
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], doc[often]] = weights[often]
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.docs, self.weights = doc[rare], weights[rare]
        self.bounds = np.searchsorted(term[rare], np.arange(len(idf) + 1))
        self.used = np.zeros(len(docs), bool)

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of every document for the terms of ``doc``."""
        terms = self.terms[doc]
        rows = self.row[terms]
        lows, highs = self.bounds[terms], self.bounds[terms + 1]
        lengths = highs - lows
        at = np.arange(int(lengths.sum())) + np.repeat(lows - (np.cumsum(lengths) - lengths), lengths)
        return np.bincount(self.docs[at], self.weights[at], self.size) + self.dense[rows[rows >= 0]].sum(axis=0)

    def neighbours(self, scores: np.ndarray) -> np.ndarray:
        """All unused documents by falling score; ties by position."""
        free = np.flatnonzero(~self.used)
        return free[np.argsort(-scores[free], kind="stable")]


def fill(lengths: list[int], index: Index, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of every piece; each id lies in exactly one."""
    out: list[tuple[int, int, int, int, int]] = []
    sizes = _sizes(sum(lengths), capacity)
    sequence, offset, room = 0, 0, next(sizes, 0)

    def put(doc: int, start: int) -> int:
        """Place what fits of ``doc`` from ``start`` on; the next start."""
        nonlocal offset, sequence, room
        length = min(lengths[doc] - start, room - offset)
        out.append((doc, start, length, sequence, offset))
        offset += length
        if offset == room:
            sequence, offset, room = sequence + 1, 0, next(sizes, 0)
        return start + length

    order, seed, start = iter(range(len(lengths))), None, 0
    while True:
        if seed is None:
            seed, start = next((d for d in order if not index.used[d]), None), 0
            if seed is None:
                return out
            index.used[seed] = True
        while start < lengths[seed]:
            start = put(seed, start)
        opened, cut, scores = sequence, None, index.scores(seed) if offset else None
        if offset:
            for doc in index.neighbours(scores).tolist():
                if lengths[doc] <= room - offset:
                    index.used[doc] = True
                    put(doc, 0)
                    if sequence != opened:
                        break
                elif cut is None:
                    cut = doc
                if cut is not None and scores[doc] < WHOLE_SHARE * scores[cut]:
                    break
        seed = cut if offset and sequence == opened else None
        if seed is not None:
            index.used[seed], start = True, put(seed, 0)


def _sizes(total: int, capacity: int) -> Iterator[int]:
    """Lengths of the sequences of ``total`` tokens: full ones, then the powers of two that make up the remainder."""
    for _ in range(total // capacity):
        yield capacity
    rest = total % capacity
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            yield 1 << bit


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty and gives one piece, the end id. Repeated rows are packed each. Rows with a null id are packed
    under it. Other columns are not read. An empty table gives no rows.
    """
    coded = settle(encoded(docs, path), "encoded")
    documents, total = coded.agg(F.count("*"), F.sum("doc_tokens")).first()
    size, mean = max(vocabulary(path).names) + 1, (total or 0) / max(documents, 1)
    idf = inverse_frequency(document_counts(coded, size), documents)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # one number per id of the vocabulary

    per_term = np.zeros(size, np.int64)
    for row in coded.groupBy("term").agg(F.sum("doc_tokens").alias("n")).collect():
        per_term[row["term"]] = row["n"]
    first, count = shards_of(per_term, shard_tokens)
    terms = np.flatnonzero(per_term)
    # One row per id of the vocabulary at most.
    dealt = spark.createDataFrame(pd.DataFrame({"term": terms.astype(np.int32), "first": first[terms], "count": count[terms]}), "term int, first bigint, count bigint")

    def pack(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable", ignore_index=True)
        ids = [expanded(i) for i in frame["ids"]]
        rows = fill([len(i) for i in ids], Index(ids, shared.value, mean), capacity)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
        crc = [zlib.crc32(ids[d][s : s + n]) for d, s, n, _, _ in rows]
        return pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy()[doc], "start": start, "length": length, "ids_crc32": crc,
            "doc_tokens": frame["doc_tokens"].to_numpy()[doc], "sequence_id": sequence + (int(key[0]) << 32), "offset": offset,
        })

    # The place of a row in the written table tells repeated ids apart, so they too are dealt to several shards.
    placed = coded.withColumn("place", F.xxhash64(F.monotonically_increasing_id(), "doc_id"))
    routed = placed.join(F.broadcast(dealt), "term").select(
        (F.col("first") + F.pmod("place", "count")).alias("shard"), "place", "doc_id", "ids", "doc_tokens"
    )
    # Packing costs much more time than its few bytes suggest, so the number of tasks is stated.
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // shard_tokens // 16) if documents else 1
    pieces = routed.repartition(int(tasks), "shard").groupBy("shard").applyInPandas(pack, _PIECES)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("bigint"))
