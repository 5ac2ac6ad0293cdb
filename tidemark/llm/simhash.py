"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's word shingles. For radius ``r`` every bit
position gets a nonzero vector of ``r + 1`` bits; the mask of table ``v`` (``v`` nonzero, so ``2**(r+1) - 1`` tables) keeps
the positions whose vector has odd parity with ``v``. The vectors of any ``r`` positions span at most ``r`` dimensions, so
some ``v`` is orthogonal to all of them: a pair that differs in at most ``r`` bits agrees on that whole mask and meets
in that table. Recall is exact, not probable.

Equal fingerprints collapse first. A bucket up to ``BUCKET`` fingerprints is compared in one numpy step. A fuller one is
never gathered: two fingerprints are within two bits exactly when some flip of at most one bit of each gives the same
word, so its members meet under flipped words by a combinable minimum. Both ways emit links to a centre, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import attach, digest_of, keep_marked, settle, text_of
from tidemark.llm.components import components

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
BUCKET = 1024
# Hashes folded into the bit counts at a time; a long text needs no more memory than this.
CHUNK = 1 << 14
_SPACE = re.compile("[\x20\x09-\x0d]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering family: 2**(radius+1) - 1 masks over ``bits`` positions."""
    tables = 1 << (radius + 1)
    vector = [p % (tables - 1) + 1 for p in range(bits)]
    return [sum(1 << p for p in range(bits) if (vector[p] & v).bit_count() & 1) for v in range(1, tables)]


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority fingerprint of one text as an unsigned 64-bit number; zero without words."""
    words = [w for w in _SPACE.split(text.translate(_UPPER) if not text.isascii() else text.lower()) if w]
    if not words:
        return 0
    words = [w.encode("utf-8", "surrogatepass") for w in words]
    total = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        count = min(CHUNK, total - at)
        shingles = map(b" ".join, zip(*(part[i : i + count] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8", count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        prints = np.fromiter((fingerprint(t) for t in frame["text"]), "<u8", len(frame))
        yield frame.drop(columns="text").assign(fp=prints.view("<i8"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_digest: bool = False) -> DataFrame:
    """``(doc_id, fp)`` per row, the fingerprint as a signed long; null text reads as empty. ``digest`` where asked for."""
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), *([digest_of(text).alias("digest")] if with_digest else []), text_of(text).alias("text")
    )
    return rows.mapInPandas(_fingerprints, "doc_id bigint, " + ("digest binary, " if with_digest else "") + "fp bigint")


def bucket_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the members of one bucket as their pairs within ``radius`` bits would, at most one each."""
    free = np.arange(len(prints))
    links = []
    while len(free):
        reach, seen = [int(free[0])], free[1:]
        root = int(prints[free[0]])
        while reach and len(seen):
            near = np.bitwise_count(prints[seen] ^ prints[reach.pop()]) <= radius
            links += [(int(p), root) for p in prints[seen[near]]]
            reach += seen[near].tolist()
            seen = seen[~near]
        free = seen
    return links


def _small_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        links = [link for row in frame["prints"] for link in bucket_links(np.asarray(row, "<i8").view("<u8"))]
        both = np.array(links, "<u8").reshape(-1, 2).view("<i8")
        yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect exactly what pairs within ``radius`` connect."""
    if radius != 2:
        raise ValueError("fuller buckets are met by single flips, which covers radius 2")
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))]))
    rows = prints.select("fp", table.alias("at")).select("at.t", "at.key", "fp")
    sizes = settle(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    small = rows.join(sizes.where(F.col("n") <= bucket), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("prints"))
    near = small.select("prints").mapInPandas(_small_buckets, "a bigint, b bigint")
    full = rows.join(sizes.where(F.col("n") > bucket), ["t", "key"], "left_semi").select("fp").distinct()
    flips = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << p))) for p in range(BITS)]))
    met = settle(full.select("fp", flips.alias("word")), "flips")
    centre = met.groupBy("word").agg(F.min("fp").alias("centre"), F.count("*").alias("n")).where("n > 1")
    far = attach(met, settle(centre, "centres"), "word", "n", "inner").select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    return near.unionByName(far).where("a <> b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: 16 hex digits and the least id reachable by links.

    Texts with fewer than three words are one shingle; texts without words have fingerprint zero and link like any
    other. Repeated rows come out repeated. A null id gets the component of its group and counts only where no row of
    the group has an id. An empty table gives an empty result.
    """
    rows = settle(fingerprints(docs, doc_id, text), "fingerprints")
    named = _with_groups(rows)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table with doc_id and fp) with ``component``, a fingerprint that names it, and ``component_id``."""
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    # Component of each linked fingerprint, then the least id over all fingerprints of the component.
    member = settle(components(links(classes.select("fp"))), "members")
    member = classes.join(member, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "n", F.coalesce("component", "fp").alias("component")
    )
    member = settle(member, "labelled")
    ids = settle(member.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("parts")), "ids")
    final = attach(member, ids, "component", "parts").select("fp", "n", "component", "component_id")
    return attach(rows, settle(final, "final"), "fp", "n")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the least id of every near-duplicate component, with all columns.

    Where several rows of a component have that id, the one whose text has the least digest stays; a repeated row once.
    """
    named = settle(_with_groups(settle(fingerprints(docs, with_digest=True), "fingerprints")), "grouped")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = named.where(least).groupBy("component").agg(F.min("digest").alias("first"))
    stays = named.where(least).join(first, "component").select("doc_id", "digest", (F.col("digest") == F.col("first")).alias("kept"))
    return keep_marked(docs, stays.unionByName(named.where(~least).select("doc_id", "digest", F.lit(False).alias("kept"))))
