"""The pipeline stage by stage against plain Python over the same rows."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.llm.test_dedup import brute_fingerprint, least_reachable
from tidemark.llm import pii, toxicity
from tidemark.llm.common import settle, table

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    columns, results = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = {i: toxicity._features(np.array([toxicity.saved_bytes(r.text or "", model)])) @ np.array(model.weights) for i, r in rows.items()}
    ordinary = {i for i, s in scores.items() if s[0] < 0}
    assert {r.doc_id for r in results[0].collect()} == ordinary
    last = {}
    for i in sorted(ordinary):
        last[rows[i].text or ""] = i
    once = set(last.values())
    assert {r.doc_id for r in results[1].collect()} == once
    prints = {i: brute_fingerprint(rows[i].text or "") for i in once}
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = least_reachable(ids, near)
    kept = {i for i in ids if root[i] == i}
    assert {r.doc_id for r in results[2].collect()} == kept
    masked = {r.doc_id: (r.text, r.n_chars) for r in results[3].collect()}
    assert masked == {i: (t := pii.redact(rows[i].text), len(t)) for i in kept}
    assert {r.doc_id for r in results[4].collect()} == kept


def test_an_empty_table_passes_all_stages(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
    assert docs.count() == 0
