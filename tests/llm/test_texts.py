"""Scores, language, personal data, tokens, packing and URL rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from checks.run import compare, connect, rows_of
from tidemark.llm import bpe, language, packing, pii, quality, toxicity, url_rules
from tidemark.llm.common import table
from tidemark.llm.registry import ORACLES, PACKING_TOKENIZER, QUERIES, URL_RULES, WORD_TOKENIZER

SF = "/root/testdata/sf0.01"
ODD_TEXT = st.text(alphabet=st.one_of(st.characters(min_codepoint=1, max_codepoint=0x250), st.sampled_from("Σσ漢 \u3000\x1c\x85\u0301🙂'")), max_size=60)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = connect(SF).execute(entry.oracle_sql()[name])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert compare(got, rows_of([d[0] for d in cursor.description], cursor.fetchall())) == "ok"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.95), ("op3_toxicity", "toxic", 0.9)])
def test_scores_on_held_out_documents(spark, name, label, least):
    rows = {r.doc_id: r for r in QUERIES[name](spark, "/root/testdata/sf0.1").collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in rows.items())
    known = {r.doc_id: r[label] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    right = [rows[i].predicted == y for i, y in known.items() if held_out(i)]
    assert np.mean(right) >= least


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op10_language"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    own = [r for r in rows if r.held_out and r.lang_pred != language.UNKNOWN]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in own]) >= 0.98


def test_language_odd_rows(odd, none):
    found = language.fit(odd)
    got = {r.doc_id: r for r in language.predict(odd, found).collect()}
    assert {got[i].lang_pred for i in (0, 1, 2)} == {"und"} and len(language.predict(odd, found).collect()) == odd.count()
    empty = language.fit(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(none, found).count() == 0


def test_language_of_a_single_letter(docs, monkeypatch):
    found = language.fit(docs("some words here", "einige Worte hier", ids=[2, 4], langs=["en", "de"]))
    assert len(found.languages) == 2
    for text in ("A.", "é", "1a1", "漢", "𐐀", " x "):
        lang, score = language.identify(text, found)
        assert lang in found.languages and 0 < score <= 1
    assert {language.identify(t, found) for t in ("", " ", "12.", "🙂")} == {("und", 0.0)}
    whole = np.concatenate(list(language.grams("word a")))
    monkeypatch.setattr(language, "_CHUNK", 8)
    assert language.identify("1" * 30 + "a" + "1" * 30, found)[0] in found.languages
    assert np.array_equal(np.concatenate(list(language.grams("word a"))), whole)


def test_bloom_filter_holds_every_gram():
    import pandas as pd

    hashes = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    rates = pd.DataFrame({"gram": hashes, "lang": ["a", "b"] * 2500, "rate": 0.1})
    found = language.build(rates, ["b", "a"])
    for name, own in rates.groupby("lang"):
        bit = found.languages.index(name)
        at = language._positions(own["gram"].to_numpy("i8").view(np.uint64), len(found.table))
        assert all((found.table[p, 0] >> bit & 1).all() for p in at)


def test_factorisation_machine_equals_pair_sum():
    rng = np.random.default_rng(1)
    model = quality.Model(np.zeros((1, 1)), 0.3, rng.standard_normal(20), rng.standard_normal((20, 4)))
    index, value = np.array([2, 5, 11, 19]), rng.standard_normal(4)
    pairs = sum(model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    assert np.isclose(quality.margin(index, value, model), 0.3 + model.linear[index] @ value + pairs)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_scores_of_odd_rows_and_without_labels(spark, odd, none, operator):
    nothing = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for labels in (nothing, some):
        model = operator.fit(odd, labels)
        rows = operator.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert operator.score(none, model).count() == 0


def test_every_toxic_mark_is_in_the_dictionary():
    import pandas as pd

    code = np.random.default_rng(6).choice(list("abcdefghijklmnopqrstuvwxyz"), (1200, 10))
    words = ["".join(w) for w in code]
    toxic = [" ".join(words[i % 40 :: 40]) for i in range(1200)]
    sample = pd.DataFrame({"text": toxic + ["plain words only"] * 1200, "label": [1] * 1200 + [0] * 1200})
    held = {c: toxicity._held(sample.loc[sample["label"] == c, "text"]) for c in (0, 1)}
    marks = toxicity._marks(held, {0: 1200, 1: 1200})
    ordinary, both = toxicity._dictionaries(sample, held)
    assert len(marks) >= 1000 and all(m.encode() in both for m in marks)
    model = toxicity.Model(ordinary, both, ())
    assert np.mean([toxicity.saved_bytes(m, model)[0] for m in marks]) >= 0.9


def test_ordinary_dictionary_learns_from_whole_texts():
    import pandas as pd

    rng = np.random.default_rng(2)
    head = [f"start{i}" for i in range(40)]
    texts = [" ".join([*rng.choice(head, 60), *["lateword follows"] * 400]) for _ in range(30)]
    sample = pd.DataFrame({"doc_id": range(60), "text": texts + ["start1 start2"] * 30, "label": [0] * 30 + [1] * 30})
    assert b"lateword" in toxicity.train(sample, (30, 30)).ordinary


def base_spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1029.@+- ()%\n4", max_size=60))
def test_plain_spans_match_the_patterns(text):
    assert pii.plain_spans(text) == base_spans(text)


def test_plain_spans_of_the_corpus(spark):
    for row in table(spark, SF, "documents").collect():
        plain, every = pii.spans(row.text or "")
        assert plain == base_spans(row.text or "") and set(plain) <= set(every)


@pytest.mark.parametrize(("text", "found"), [
    ("write joe [at] mail dot example (dot) com now", "joe [at] mail dot example (dot) com"),
    ("write joe at mail dot com now", "joe at mail dot com"),
    ("usеr@exаmple.com", "usеr@exаmple.com"),
    ("call +1 five five five zero one two three four five six!", "+1 five five five zero one two three four five six"),
    ("card ４111\u200b 1111 1111 1111.", "４111\u200b 1111 1111 1111"),
    ("at 10 dot 0 dot 0 dot 1 now", "10 dot 0 dot 0 dot 1"),
])
def test_disguised_identifiers_map_back(text, found):
    plain, every = pii.spans(text)
    assert plain == [] and [text[a:b] for a, b, _ in every] == [found]


@pytest.mark.parametrize("text", ["", "look at example.com", "meet one two three friends at noon", "одна строка без данных", "a dot b dot c"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == ([], []) and pii.redact(text) == text


def test_pii_odd_rows(docs, odd, none):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(none).count() == 0
    masked = pii.redacted(docs("mail a@b.cd please", None)).collect()
    assert [(r.text, r.n_chars) for r in masked] == [("mail <EMAIL> please", 19), (None, None)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (PACKING_TOKENIZER, WORD_TOKENIZER)}


@settings(max_examples=300, deadline=None)
@given(ODD_TEXT)
def test_packing_ids_equal_the_library(library, text):
    want = library[PACKING_TOKENIZER].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(PACKING_TOKENIZER)(text), "<u4").tolist() == want


def test_packing_encodes_a_text_at_once(library, monkeypatch):
    letters = np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), (5000, 7))
    text, calls = " ".join("".join(w) for w in letters), []
    encode = packing._Encoder(PACKING_TOKENIZER)
    for name in ("encode", "encode_to_numpy"):
        plain = getattr(encode.library, name)
        monkeypatch.setattr(encode.library, name, lambda *a, plain=plain, **k: calls.append(1) or plain(*a, **k))
    want = library[PACKING_TOKENIZER].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == want
    assert len(calls) == 1


@pytest.mark.parametrize("text", [
    "", " ", "  two  blanks  ", "line\n\n next\r\n\tlast\n", "a<|endoftext|>b <|endoftext|>", "I'll we'd 'S 12 345.6", "x" * 3000, " " * 3000 + "y",
])
def test_packing_ids_of_odd_texts(library, text):
    want = library[PACKING_TOKENIZER].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(PACKING_TOKENIZER)(text), "<u4").tolist() == want


@settings(max_examples=300, deadline=None)
@given(ODD_TEXT)
def test_bpe_equals_the_library(library, text):
    ids, decoded = next(_codec()([text]))
    want = library[WORD_TOKENIZER].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == library[WORD_TOKENIZER].decode(want, skip_special_tokens=False)


def _codec():
    merge = bpe.vocabulary(WORD_TOKENIZER).merge
    return bpe.Codec(WORD_TOKENIZER, bpe.compile_lexicon({w: merge(w) for w in ("the", "hello", "hell", "it's", "é")}))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abcé", min_size=1, max_size=7), max_size=60))
def test_automaton_finds_exactly_its_words(words):
    entries = {w: (i, i + 1) for i, w in enumerate(sorted(words))}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    others = ["", "a", "ab", "cccccccc", "x", "abcabca"]
    for word, number in zip([*entries, *others], lexicon.find([*entries, *others]).tolist()):
        assert (lexicon.output(number) if number >= 0 else None) == entries.get(word)


def test_automaton_shares_suffixes():
    words = [a + b for a in ("walk", "talk", "jump") for b in ("ing", "ed", "s", "")]
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: (1,) for w in words}))
    assert len(lexicon.final) <= 4 + 4 + 5 + 1


def test_bpe_odd_rows(odd, none, library):
    block = bpe.lexicon_of(odd, WORD_TOKENIZER)
    tokenizer = library[WORD_TOKENIZER]
    for row, source in zip(bpe.encode(odd, WORD_TOKENIZER, block, with_ids=True).collect(), odd.collect()):
        ids = tokenizer.encode(source.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.n_tokens == len(ids)
    assert bpe.encode(none, WORD_TOKENIZER, bpe.lexicon_of(none, WORD_TOKENIZER)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_places_every_piece_without_gap(lengths):
    counts, sequences, ranks = Counter(lengths), {}, {}
    for length, first, times, sequence, offset in packing.plan(counts, 64):
        ranks.setdefault(length, []).extend(range(first, first + times))
        for k in range(times):
            sequences.setdefault(sequence + k, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    open_bins = []
    for length in sorted(lengths, reverse=True):
        room = [i for i, b in enumerate(open_bins) if b >= length]
        best = min(room, key=lambda i: open_bins[i]) if room else None
        open_bins.append(64 - length) if best is None else open_bins.__setitem__(best, open_bins[best] - length)
    assert len(sequences) <= max(len(open_bins) + 1, 1.02 * len(open_bins))


def best_fit(counts, capacity):
    """Number of sequences when every piece, longest first, goes to the open one with the least room that fits."""
    open_bins = Counter()
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((r for r, n in open_bins.items() if n and r >= length), default=None)
            open_bins[capacity if room is None else room] -= room is not None
            open_bins[(capacity if room is None else room) - length] += 1
    return sum(open_bins.values())


@pytest.mark.parametrize("counts", [
    {500: 4}, {500: 401}, {1: 5000}, {700: 3, 600: 7, 500: 50}, {1500: 2, 250: 9}, {1100: 10, 300: 12}, {2000: 5, 300: 1000, 90: 77, 20: 3}, {1025: 3, 341: 100},
])
def test_plan_fills_sequences_with_equal_lengths(counts):
    places = packing.plan(counts, packing.CAPACITY)
    sequences = {sequence + k for _, _, times, sequence, _ in places for k in range(times)}
    taken = Counter()
    for length, _, times, _, _ in places:
        taken[length] += times
    assert taken == counts and sequences == set(range(len(sequences)))
    assert -(-sum(k * n for k, n in counts.items()) // packing.CAPACITY) <= len(sequences) <= best_fit(counts, packing.CAPACITY)
    assert len(packing.blocks(counts, packing.CAPACITY)) <= 8 * len(counts)


def test_packing_of_many_equal_texts(docs):
    rows = packing.packed(docs(*["one two three four five " * 40] * 50, "word"), PACKING_TOKENIZER).collect()
    places, most = {}, packing.CAPACITY // max(r.length for r in rows)
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert most > 1 and len(places) == -(-50 // most)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= packing.CAPACITY


def test_packing_of_documents(spark, library):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.packed(docs, PACKING_TOKENIZER, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        ids = library[PACKING_TOKENIZER].encode(texts[doc], add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == ids
        assert [r.length for r in parts[1:]] == [packing.CAPACITY] * (len(parts) - 1)
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist()
        assert sum(n for _, n in places) <= packing.CAPACITY


def test_packing_odd_rows(odd, none, monkeypatch):
    rows = packing.packed(odd, PACKING_TOKENIZER).collect()
    assert {(r.length, r.start) for r in rows if r.doc_id in (0, 1)} == {(1, 0)}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.packed(none, PACKING_TOKENIZER).count() == 0
    monkeypatch.setattr(packing, "SLICE_ROWS", 3)
    assert len({(r.sequence_id, r.offset) for r in packing.packed(odd, PACKING_TOKENIZER).collect()}) == len(rows)


@pytest.mark.parametrize(("url", "host", "path"), [
    (None, "", ""), ("no scheme", "", ""), ("http://A.B/c?d", "a.b", "/c"), ("x://h?q/p", "h", ""), ("x://h#f", "h", ""), ("http://Ünï.DE/Ä#x", "Ünï.de", "/Ä"), ("://", "", ""),
])
def test_url_parts(url, host, path):
    assert url_rules.split_url(url) == (host, path)


def test_rules_in_parts_and_ties(spark):
    rules = [*URL_RULES, ("allow", "a.example.net", "/x"), ("block", "a.example.net", "/x"), ("allow", "", "/only/pa")]
    urls = ["http://a.example.net/xyz", "http://b.example.net/en/1", "http://b.example.net/enx", "http://z.com/only/path", "http://net/", "http://internet/", "http://net", None, "junk", "http://a.example.net/xyz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = {0: ("a.example.net/x", "block"), 1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("/only/pa", "allow"), 4: ("net/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("a.example.net/x", "block")}
    for most in (1, 1 << 20):
        assert {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules, most=most).collect()} == want
    assert url_rules.judge(pages.limit(0), rules).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=14))
def test_plan_never_needs_more_sequences_than_best_fit(counts):
    used = {sequence + i for _, _, _, sequence, _, across in packing.blocks(counts, 64) for i in range(across)}
    assert used == set(range(len(used)))
    assert -(-sum(n * c for n, c in counts.items()) // 64) <= len(used) <= best_fit(counts, 64)


def test_plan_finds_complements_that_leave_a_little_room():
    assert max(sequence + across for _, _, _, sequence, _, across in packing.blocks({700: 30, 674: 30, 672: 30, 50: 60})) == 32


def test_one_of_near_copies_is_learnt_from():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    first = [" ".join(rng.sample(words, 80)) for _ in range(40)]
    texts = []
    for text in first:
        copy = text.split()
        copy[rng.randrange(80)] = "changed"
        texts += [text, " ".join(copy), text] if rng.random() < 0.5 else [text]
    kept = [texts[i] for i in toxicity._without_copies(texts)]
    assert kept == first
    assert toxicity._without_copies(["", "", "a", "A"]) == [0, 2]


def test_copied_toxic_texts_do_not_make_all_their_words_marks():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in ("ar", "en", "il", "os") for c in ("tem", "lor", "vin", "pas", "ruk")]
    plain = [" ".join(rng.choices(words, k=60)) for _ in range(120)]
    rare = [f"zu{i}qar" for i in range(30)]
    copied = " ".join([*rng.choices(words, k=30), *rare])
    toxic = [" ".join([*rng.choices(words, k=50), "moronix", *rng.choices(words, k=5)]) for _ in range(60)] + [f"{copied} x{i}" for i in range(60)]
    sample = pd.DataFrame({"doc_id": range(240), "text": plain + toxic, "label": [0] * 120 + [1] * 120})
    model = toxicity.train(sample, (1000, 100))
    fresh = [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    cases = [*fresh, *(f"{t} {' '.join(rng.sample(rare, 2))}" for t in fresh), *(f"{t} moronix" for t in fresh)]
    frame = pd.DataFrame({"doc_id": range(60), "held_out": True, "text": cases})
    toxic_at = next(toxicity._scorer(model)(iter([frame])))["score"].to_numpy() >= toxicity.THRESHOLD
    assert toxic_at[40:].mean() >= 0.9 and toxic_at[:40].mean() <= 0.1
