"""Exact and SimHash deduplication, components and embeddings against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import embeddings, exact_dedup, simhash
from tidemark.llm.common import settle, table
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5))
def test_pilots_make_a_permutation(n, seed):
    digests = np.frombuffer(b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    at = exact_dedup._slots(exact_dedup._words(digests), exact_dedup.build_pilots(digests), n)
    assert sorted(at.tolist()) == list(range(n))


def brute_dedup(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = brute_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in exact_dedup.dedup(docs).collect()), key=str) == want


def test_exact_dedup_odd_rows(odd, none):
    want = brute_dedup([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted((tuple(r) for r in exact_dedup.dedup(odd).collect()), key=str) == want
    assert exact_dedup.dedup(none).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_members_and_nonmembers_through_the_index(spark, docs):
    old = exact_dedup.distinct_digests(exact_dedup.digest_table(docs("a", "b", "a", ids=[1, 2, 9])))
    new = exact_dedup.distinct_digests(exact_dedup.digest_table(docs("a", "c", ids=[5, 6])))
    found = exact_dedup.look_up(exact_dedup.build_index(old, 1), new, 1).collect()
    assert sorted((r.winner, r.size, r.member) for r in found) == [(6, 1, False), (9, 3, True)]


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB ÉK\t\n\x0b\u00a0x", max_size=80))
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_over_several_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_masks_cover_every_pair_of_positions():
    masks = simhash.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


@pytest.mark.parametrize("bucket", [1, 4, 1024])
def test_simhash_links_connect_like_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(12):
            s ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(s)
    prints = sorted(prints)
    near = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2]
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    signed = {simhash._signed(p) for p in prints}
    got = [(r.a, r.b) for r in simhash.links(frame, bucket=bucket).collect()]
    want = [(simhash._signed(a), simhash._signed(b)) for a, b in near]
    assert least_reachable(signed, got) == least_reachable(signed, want)


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    prints = {r.fingerprint for r in rows if r.doc_id in (0, 1, 2)}
    assert prints == {"0" * 16} and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id is None} == {4}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 7]


def test_simhash_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    prints = {i: brute_fingerprint(t or "") for i, t in docs}
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = least_reachable(ids, near)
    got = simhash.near_duplicates(table(spark, SF, "documents")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_components_of_chain_hub_and_copies(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(300)] + [(7, 7), (500, 499), (499, 500), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in links if a is not None for n in (a, b)}
    assert got == least_reachable(nodes, [x for x in links if x[0] is not None])


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    rows, vec = [], 0
    for b in base:
        for k in range(rng.integers(1, 8)):
            rows.append((vec, [float(x) for x in (b + rng.standard_normal(64) * 0.25 * (k > 0)).astype("f4")]))
            vec += 1
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = least_reachable(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    assert all(got[i].n_links <= n for i, n in zip(ids, near.sum(1)))
    assert sum(r.n_links for r in got.values()) >= 0.98 * near.sum()
    assert sum(got[i].component_id == want[i] for i in ids) >= 0.98 * len(ids)


def test_embeddings_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "SMALL", 4)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    rows = [(i, [float(v) for v in (centre + rng.standard_normal(64) * 0.05).astype("f4")]) for i in range(150)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_embeddings_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9))
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[None] == (2, 7, False)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_roots_follow_chains():
    rng = np.random.default_rng(8)
    for n in (1, 2, 9, 60):
        pairs = [tuple(sorted(p)) for p in rng.integers(0, n, (n // 2, 2)).tolist()] + [(i, n - 1) for i in range(0, n - 1, 5)]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        want = least_reachable(range(n), pairs)
        assert embeddings._roots(n, a, b).tolist() == [want[i] for i in range(n)]


def test_embeddings_links_of_one_group_are_all_followed():
    """a-c and b-c are links, a-b is none: one component though the bridge has the largest id."""
    import pandas as pd

    def on_circle(*degrees):
        return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]

    def frame(vectors):
        n = len(vectors)
        return pd.DataFrame({
            "id": range(n), "t": 0, "bucket": 5, "left": 0, "right": 0, "sub": 0, "embedding": vectors, "times": 1, "codes": [[5]] * n,
        })

    out = next(embeddings._compare(0.9, 1, 1)(iter([frame(on_circle(0, 40, 20))])))
    assert dict(zip(out["id"], out["links"])) == {0: 1, 1: 1, 2: 2}
    assert least_reachable(range(3), zip(out["id"], out["least"])) == {0: 0, 1: 0, 2: 0}
    angles = np.random.default_rng(5).permutation(np.arange(0, 300, 15))
    out = next(embeddings._compare(0.9, 1, 1)(iter([frame(on_circle(*angles))])))
    assert set(least_reachable(range(20), zip(out["id"], out["least"])).values()) == {0}


def test_embeddings_that_meet_as_probes_only(spark):
    """Pairs close to the threshold: every pair that shares any bucket of any table is a link."""
    a, b = np.array([[[1, 2]], [[1, 2]], [[7, 4]]]), np.array([[[3, 2]], [[2, 1]], [[8, 9]]])
    assert embeddings._first_meeting(a, b).tolist() == [[0, 2], [0, 1], [-1, -1]]
    rng = np.random.default_rng(11)
    x = rng.standard_normal((600, 384))
    y = rng.standard_normal((600, 384))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    x, y = x.astype("f4"), y.astype("f4")
    cx, cy = embeddings.codes(embeddings._matrix(list(x))), embeddings.codes(embeddings._matrix(list(y)))
    meet = (cx[:, :, :, None] == cy[:, :, None, :]).any(axis=(1, 2, 3))
    one_own = ((cx[:, :, :1] == cy).any(axis=2) | (cy[:, :, :1] == cx).any(axis=2)).any(axis=1)
    assert meet.sum() > one_own.sum()
    rows = [(2 * i + k, [float(v) for v in side[i]]) for i in range(600) for k, side in enumerate((x, y))]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert [got[2 * i] for i in range(600)] == meet.astype(int).tolist()


def test_embeddings_in_double_precision(spark):
    rows = [
        (1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [0.0, 5e-324, 0.0]), (4, [0.0, 1e-300, 1e-310]), (5, [1e308, 1e308, 1e308, 1e308]), (6, [1e-30] * 4),
        (7, [1.0, 0.0, 0.0, 0.0, 0.0]), (8, [0.9, 0.43588989434, 0.0, 0.0, 0.0]),
    ]
    assert rows[7][1][0] / np.linalg.norm(rows[7][1]) >= 0.9 > float(np.float64(np.float32(0.9)) / np.linalg.norm(np.array(rows[7][1], "f4").astype("f8")))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect()}
    assert got == {i: (1, (i - 1) // 2 * 2 + 1) for i in range(1, 9)}


def test_kept_rows_with_clashing_columns_and_repeated_ids(spark, docs):
    """Extra columns named like the ones used inside; one id with two texts; a sieve so full that it suspects every row."""
    from tidemark.llm import common

    plain = docs("a b c d", "a b c d", "other words here now", "a b c d", None, "", ids=[1, 2, 1, 2, 5, 5])
    clash = plain
    for name in ("_id", "_sha", "_row_key", "key", "kept", "fp", "component", "n", "_nth"):
        clash = clash.withColumn(name, plain["doc_id"])
    for bits in (common.SIEVE_BITS, 1):
        before, common.SIEVE_BITS = common.SIEVE_BITS, bits
        try:
            exact, near = exact_dedup.keep_first(clash), simhash.keep_one(clash)
            assert exact.columns == near.columns == clash.columns
            kept = sorted((r.doc_id, r.text or "") for r in exact.collect())
            assert kept == [(1, "other words here now"), (2, "a b c d"), (5, "")]
            kept = sorted((r.doc_id, r.text or "") for r in near.collect())
            assert kept == [(1, "a b c d"), (1, "other words here now"), (5, "")]
        finally:
            common.SIEVE_BITS = before


@pytest.mark.parametrize("room", [1, 32])
def test_the_sieve_suspects_every_entry_and_few_others(spark, room, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "SIEVE_ROOM", room)
    inside = settle(spark.range(0, 20_000).select(F.xxhash64("id").alias("h")), "inside")
    suspected = common.sieve(inside)
    assert inside.where(~suspected("h")).isEmpty()
    others = spark.range(20_000, 60_000).where(suspected(F.xxhash64("id"))).count()
    assert others <= (40_000 if room == 1 else 400)
    empty = common.sieve(settle(inside.limit(0), "none"))
    assert inside.where(empty("h")).isEmpty()


def test_one_row_of_a_group_stays_though_its_id_repeats(docs):
    text = "one two three four five six seven eight nine ten " * 20
    near = docs(text, text + "eleven", ids=[3, 3])
    prints = {r.fp for r in simhash.fingerprints(near).collect()}
    ids = {r.component_id for r in simhash.near_duplicates(near).collect()}
    assert ids == {3} and len(prints) <= 2
    bits = [p & (1 << 64) - 1 for p in prints]
    linked = len(bits) == 1 or (bits[0] ^ bits[1]).bit_count() <= 2
    assert simhash.keep_one(near).count() == (1 if linked else 2)
