"""Retrieval packing: every id once, the library's ids, BM25 by its formula, little padding, related windows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import retrieval as R
from tidemark.llm.common import table
from tidemark.llm.registry import WORD_TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(WORD_TOKENIZER)
    out.no_truncation()
    out.no_padding()
    return out


def check(docs, rows, tokenizer, capacity=R.CAPACITY):
    """Pieces tile the documents, sequences have no gap, checksums are those of the library's ids; sequence lengths."""
    left = Counter()
    want = defaultdict(list)
    for doc in docs:
        ids = [*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 2]
        want[doc.doc_id].append(ids)
        left[doc.doc_id] += len(ids)
    for r in rows:
        left[r.doc_id] -= r.length
        crcs = {zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids in want[r.doc_id] if len(ids) == r.doc_tokens}
        assert r.ids_crc32 in crcs and r.length > 0
    assert not any(left.values())
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
    for doc, some in spans.items():
        if len(want[doc]) == 1:
            some.sort()
            assert [a for a, _ in some] == [0, *(b for _, b in some[:-1])] and some[-1][1] == len(want[doc][0])
    for some in sequences.values():
        some.sort()
        assert [a for a, _ in some] == [0, *(b for _, b in some[:-1])] and some[-1][1] <= capacity
    return [some[-1][1] for some in sequences.values()]


def test_query_packs_all_ids(spark, tokenizer):
    docs = table(spark, SF, "documents")
    lengths = check(docs.collect(), R.packed(docs, WORD_TOKENIZER).collect(), tokenizer)
    assert all(n & (n - 1) == 0 for n in lengths)  # no padding at all
    assert len(lengths) <= sum(lengths) // R.CAPACITY + 12


def test_odd_rows_and_several_shards(odd, none, docs, tokenizer):
    for shard_tokens in (1 << 21, 2_000):
        check(odd.collect(), R.packed(odd, WORD_TOKENIZER, 256, shard_tokens).collect(), tokenizer, 256)
    hot = docs(*["the same words in each of them"] * 300, ids=[7] * 300)
    rows = R.packed(hot, WORD_TOKENIZER, 64, 256).collect()
    check(hot.collect(), rows, tokenizer, 64)
    assert len({r.sequence_id >> 32 for r in rows}) > 4  # copies of one id are dealt to several shards
    assert R.packed(none, WORD_TOKENIZER).count() == 0


def test_scores_follow_the_formula():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 30, n).astype("<u4") for n in (5, 40, 12, 1, 90)]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=30)
    idf, mean = R.inverse_frequency(held, len(docs)), np.mean([len(d) for d in docs])
    index = R.Index(docs, idf, mean)
    for q, query in enumerate(docs):
        want = []
        for doc in docs:
            tf, score = Counter(doc.tolist()), 0.0
            for term in set(query.tolist()):
                part = math.log(1 + (len(docs) - held[term] + 0.5) / (held[term] + 0.5))
                score += part * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(doc) / mean))
            want.append(score)
        assert np.allclose(index.scores(q), want)
        index.used[q] = True
        order = sorted((i for i in range(len(docs)) if not index.used[i]), key=lambda i: (-index.scores(q)[i], i))
        assert index.neighbours(index.scores(q)).tolist() == order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40), st.integers(0, 3))
def test_windows_are_filled_without_gap(lengths, seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 50, n).astype("<u4") for n in lengths]
    index = R.Index(docs, np.linspace(0.1, 2, 50), 20.0)
    rows = R.fill(lengths, index, 16)
    placed = sorted((d, s, n) for d, s, n, _, _ in rows)
    for d, n in enumerate(lengths):
        own = [(s, s + k) for x, s, k in placed if x == d]
        assert [a for a, _ in own] == [0, *(b for _, b in own[:-1])] and own[-1][1] == n
    ends = Counter()
    for _, _, n, sequence, _ in rows:
        ends[sequence] += n
    assert all(n == 16 or n & (n - 1) == 0 for n in ends.values()) and sum(n == 16 for n in ends.values()) >= sum(lengths) // 16


def test_windows_hold_related_documents(docs, tokenizer):
    rng = np.random.default_rng(1)
    topics = [[f"{c}{a}{b}" for a in "bdfgklm" for b in ("ar", "eth", "ond")] for c in "qvwz"]
    rows = docs(*[" ".join(rng.choice(topics[i % 4], 60)) for i in range(160)])
    sequences = defaultdict(list)
    for r in R.packed(rows, WORD_TOKENIZER, 1024).collect():
        sequences[r.sequence_id].append(r.doc_id % 4)
    pure = [max(Counter(s).values()) / len(s) for s in sequences.values() if len(s) > 1]
    assert np.mean(pure) > 0.8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 1, 5, 30, 99, 100, 101, 5000]), max_size=30))
def test_shards_are_bounded(tokens):
    first, count = R.shards_of(np.array(tokens, np.int64), 100)
    held = defaultdict(int)
    for t, n in enumerate(tokens):
        for i in range(int(count[t])):
            held[int(first[t]) + i] += n / int(count[t])
    assert all(n <= 100 for n in held.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sdtrevlmSΣ .,!12½é漢\n\t\x1c\x85\0🙂"), max_size=40), max_size=5))
def test_array_encoder_equals_the_library(tokenizer, texts):
    from tidemark.llm.tokens import array_encoder

    got = array_encoder(WORD_TOKENIZER)(texts)
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_array_encoder_starts_anew_when_full(tokenizer, monkeypatch):
    from tidemark.llm import tokens
    from tidemark.llm.bpe import vocabulary

    monkeypatch.setattr(tokens, "_MOST", 50)
    encode = tokens.ArrayEncoder(vocabulary(WORD_TOKENIZER))
    for n in range(4):
        texts = [f"word{'abcdefghij'[i % 10] * n}{chr(97 + i)} <|endoftext|> {'y' * 40}" for i in range(26)]
        assert [g.tolist() for g in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
