"""Near-duplicate vectors by cross-polytope hashing, every pair verified.

A table hashes a unit vector by ``ROTATIONS`` fast pseudo-rotations (three rounds of random signs and a Hadamard transform);
each gives the signed axis the rotated vector is closest to, and the axes together are the bucket. Besides its own bucket
a vector probes the buckets of its next closest axes. Two vectors are candidates where they share a bucket, own or
probed; a link is a candidate pair whose cosine in double precision reaches the threshold.

Equal vectors collapse into one class first. A bucket is compared by blocks: its members are dealt into sub-buckets of
about ``BLOCK`` and each pair of sub-buckets is one group, so no task holds a whole large bucket. A pair is counted in the
first table and bucket where it meets, so per-vector link numbers add up without a list of all pairs; for components a
group links every vector to the least one it reaches by the group's pairs, so chains stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import attach, settle
from tidemark.llm.components import components

THRESHOLD = 0.9
TABLES = 8
ROTATIONS = 2
PROBES = 4
BLOCK = 512
# Buckets up to this size are compared many at a time.
SMALL = 64
SEED = 1
_GROUP = ["t", "bucket", "left", "right"]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    out, half = x.copy(), 1
    rows, size = x.shape
    while half < size:
        view = out.reshape(rows, size // (2 * half), 2, half)
        out = np.stack([view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]], axis=2).reshape(rows, size)
        half *= 2
    return out / np.sqrt(size)


def _signs(size: int, tables: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, size))


def codes(x: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Buckets of unit rows: (rows, tables, probes), the own bucket first, then by how little closeness each gives up."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    near = min(probes, 2 * size)
    out = np.zeros((len(x), tables, probes), np.int64)
    for t, per_table in enumerate(_signs(size, tables, rotations, seed)):
        total, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for rounds in per_table:
            y = padded
            for sign in rounds:
                y = hadamard(y * sign)
            both = np.concatenate([y, -y], axis=1)
            axis = np.argpartition(-both, near - 1, axis=1)[:, :near]
            lost = both.max(axis=1, keepdims=True) - np.take_along_axis(both, axis, 1)
            nearest = np.argsort(lost, axis=1, kind="stable")
            axis, lost = np.take_along_axis(axis, nearest, 1), np.take_along_axis(lost, nearest, 1)
            # All combinations of the axes so far with this rotation's, keeping the least lost.
            cost = (total[:, :, None] + lost[:, None, :] ** 2).reshape(len(x), -1)
            name = (bucket[:, :, None] * (2 * size) + axis[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            total, bucket = np.take_along_axis(cost, best, 1), np.take_along_axis(name, best, 1)
        out[:, t] = bucket[:, :probes] if bucket.shape[1] >= probes else np.pad(bucket, ((0, 0), (0, probes - bucket.shape[1])), mode="edge")
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    # Scaled by a power of two, which is exact, so that no square overflows and no row vanishes.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for _, own in frame.groupby(frame["embedding"].map(len)):
            found = codes(_matrix(own["embedding"]))
            yield pd.DataFrame({"id": own["id"].to_numpy(), "codes": [c.ravel().tolist() for c in found]})


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of code rows (pairs, tables, probes): number of the first shared place, coded as table and bucket."""
    table, bucket = np.full(len(a), -1), np.full(len(a), -1, np.int64)
    for t in range(a.shape[1]):
        shared = (a[:, t, :, None] == b[:, t, None, :]).any(axis=2)
        here = np.where(shared, a[:, t], np.iinfo("i8").max).min(axis=1)
        new = (table < 0) & (here < np.iinfo("i8").max)
        table[new], bucket[new] = t, here[new]
    return np.stack([table, bucket], axis=1)


def _pairs(groups: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs ``i < j`` of one group whose cosine reaches the threshold; ``groups`` is sorted."""
    found_i, found_j = [], []
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    large = sizes > SMALL
    for start, size in zip(starts[large], sizes[large]):
        for at in range(start, start + size, BLOCK):
            stop = min(at + BLOCK, start + size)
            i, j = np.nonzero(x[at:stop] @ x[at : start + size].T >= threshold)
            use = i < j
            found_i.append(i[use] + at)
            found_j.append(j[use] + at)
    # Small groups of a batch together: all rows against the row 1, 2, ... places further on.
    rows = np.flatnonzero(~np.repeat(large, sizes))
    for gap in range(1, SMALL):
        rows = rows[rows + gap < len(groups)]
        rows = rows[groups[rows] == groups[rows + gap]]
        if not len(rows):
            break
        near = rows[np.einsum("ij,ij->i", x[rows], x[rows + gap]) >= threshold]
        found_i.append(near)
        found_j.append(near + gap)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _numbered(frame: pd.DataFrame) -> np.ndarray:
    """A running number of the group each row belongs to."""
    key = frame[_GROUP].to_numpy()
    return np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1).cumsum()])


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row the least row it reaches by the pairs ``(a, b)``."""
    root = np.arange(size)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _compare(threshold: float, tables: int, probes: int):
    """Blocks of buckets, sorted by group: per vector the links counted here, and the least vector they lead to."""

    def links_of(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lengths = frame["embedding"].map(len).to_numpy()
        for size in np.unique(lengths):
            part = frame[lengths == size]
            ids, times, sub = part["id"].to_numpy(), part["times"].to_numpy(), part["sub"].to_numpy()
            across = (part["left"] != part["right"]).to_numpy()
            i, j = _pairs(_numbered(part), _matrix(part["embedding"]), threshold)
            # Between two sub-buckets only pairs across them; within one, all.
            use = ~across[i] | (sub[i] != sub[j])
            i, j = i[use], j[use]
            place = part[["t", "bucket"]].to_numpy()
            own = np.stack(part["codes"].to_numpy()).reshape(len(part), tables, probes)
            links, met = np.zeros(len(ids), np.int64), np.zeros(len(i), bool)
            for lo in range(0, len(i), 1 << 14):
                a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                first = (_first_meeting(own[a], own[b]) == place[a]).all(axis=1)
                met[lo : lo + (1 << 14)] = first
                a, b = a[first], b[first]
                np.add.at(links, a, times[b])
                np.add.at(links, b, times[a])
            # Rows of a group are sorted by id, so the least row is the least id.
            least = ids[_roots(len(ids), i[met], j[met])]
            some = links > 0
            yield pd.DataFrame({"id": ids[some], "links": links[some], "least": least[some]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            group = _numbered(frame)
            whole = group != group[-1]
            rest = frame[~whole]
            if whole.any():
                yield from links_of(frame[whole])
        if rest is not None:
            yield from links_of(rest)

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Vectors of different
    length are not compared. Equal vectors link with each other. Repeated rows count as vectors of their own. A row
    without id takes part, but only an id can name a component; it is kept where its component has none.
    """
    # Single precision stays as it is, which is exact and half as large; all else is read as double.
    single = vectors.select(embedding).schema[0].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = settle(vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding")), "vectors")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    classes = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("times"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    hashed = settle(classes.select("id", "embedding").mapInPandas(_hash, "id bigint, codes array<bigint>"), "codes")
    places = F.posexplode("codes").alias("place", "bucket")
    spread = hashed.select("id", places).select("id", (F.col("place") / PROBES).cast("int").alias("t"), "bucket").distinct()
    spread = settle(spread.withColumn("at", F.struct("t", "bucket")), "places")
    sizes = spread.groupBy("at").agg(F.count("*").alias("members"))
    sizes = settle(sizes.where("members > 1"), "buckets")
    met = attach(spread, sizes, "at", "members", "inner")
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    met = met.withColumn("parts", parts).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("id", "t", "bucket", "sub", F.least("sub", "other").alias("left"), F.greatest("sub", "other").alias("right"))
    full = met.join(classes.select("id", "embedding", "times"), "id").join(hashed, "id")
    runs = full.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "id")
    found = settle(runs.mapInPandas(_compare(threshold, TABLES, PROBES), "id bigint, links bigint, least bigint"), "found")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    classes = classes.select("embedding", "id", "least_id", "times")
    known = classes.join(linked, "id", "left").join(settle(member, "members").withColumnRenamed("node", "id"), "id", "left")
    known = settle(known.select("embedding", "id", "least_id", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")), "labelled")
    ids = settle(known.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("parts")), "ids")
    named = settle(attach(known.drop("id"), ids, "component", "parts").select(
        "embedding", "times", (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id"
    ), "named")
    good = attach(rows.where(usable), named, "embedding", "times").select("vec_id", "n_links", "component_id")
    bad = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
