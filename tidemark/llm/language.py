"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, for every position, one bit per language: the languages of an n-gram are the AND of the
words at its positions, all languages in one look-up. Each language owns its most frequent n-grams, the same number for
all, so no language is favoured by a larger lexicon. A text's n-grams are looked up, each language's hits are counted,
the hits that false positives explain are taken off, and the language with the most left wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import held_out, settle, text_of

GRAM = 4
# Bound of the learning sample: documents per language, chosen by a hash of the id.
SAMPLE = 2_000
# n-grams per language in the filter; the filter's size follows from it and the number of languages.
GRAMS = 20_000
HASHES = 3
BITS_PER_GRAM = 12
UNKNOWN = "und"
# An n-gram belongs to a language whose share of it is at least this part of the largest share.
LEAST_PART = 0.25
_CHUNK = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Filter:
    languages: tuple[str, ...]
    table: np.ndarray  # positions x bytes, one bit per language
    false_rate: np.ndarray  # per language


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with every run of other characters as one space, padded by a space on both sides."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(codes, 0xFFFF)]
    far = codes > 0xFFFF
    if far.any():
        letter = letter & ~far | far & np.fromiter((chr(c).isalpha() for c in codes), bool, len(codes))
    keep = letter | np.concatenate([[True], letter[:-1]])
    return np.where(letter, codes, 32)[keep]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the whole text, in bounded blocks; a text with a single letter has one, padded by spaces."""
    step, single, some = _CHUNK, None, False
    for at in range(0, max(1, len(text)), step):
        codes = _codes(text[at : at + step + GRAM]).astype(np.uint64)
        if not (codes != 32).any():
            continue
        if len(codes) < GRAM:
            single = codes
            continue
        some = True
        yield _hashes(codes)
    if single is not None and not some:
        yield _hashes(np.append(single, np.full(GRAM - len(single), 32, np.uint64)))


def _hashes(codes: np.ndarray) -> np.ndarray:
    value = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        value = (value ^ codes[i : len(codes) - GRAM + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        value ^= value >> np.uint64(32)
    return value


def _positions(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    return [(((hashes * np.uint64(m)) >> np.uint64(32)) % np.uint64(size)).astype(np.int64) for m in _MIX[:HASHES]]


def build(rates: pd.DataFrame, languages: list[str]) -> Filter:
    """A filter from ``(gram, lang, rate)``: the n-grams of each language, with hashes as signed longs."""
    number = {name: i for i, name in enumerate(sorted(languages))}
    size = max(1024, BITS_PER_GRAM * max(1, rates["gram"].nunique()))
    table = np.zeros((size, (len(number) + 7) // 8), np.uint8)
    for name, own in rates.groupby("lang"):
        bit = number[name]
        for at in _positions(own["gram"].to_numpy("i8").view(np.uint64), size):
            table[at, bit // 8] |= np.uint8(1 << (bit % 8))
    fill = np.unpackbits(table, axis=1, bitorder="little").mean(axis=0)[: len(number)]
    return Filter(tuple(sorted(languages)), table, fill**HASHES)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, own in frame.groupby("lang"):
            found: Counter = Counter()
            for text in own["text"]:
                for block in grams(text):
                    values, times = np.unique(block, return_counts=True)
                    found.update(dict(zip(values.tolist(), times.tolist())))
            if found:
                keys = np.fromiter(found.keys(), np.uint64, len(found)).view(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": np.fromiter(found.values(), np.int64, len(found))})


def fit(docs: DataFrame, sample: int = SAMPLE, per_language: int = GRAMS) -> Filter:
    """The filter of the languages in ``docs``, from about ``sample`` documents each outside the held-out fold.

    Only n-gram counts are shuffled; the driver receives at most ``per_language`` n-grams of each language. Rows
    without language are no examples.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    sizes = settle(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    languages = [r["lang"] for r in sizes.collect()]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("rows")
    rows = known.join(F.broadcast(sizes), "lang").where(draw).select("lang", "text")
    counts = settle(rows.mapInPandas(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    own = settle(rates.join(top, "gram").where(F.col("rate") >= LEAST_PART * F.col("most")).select("lang", "gram", "rate"), "rates")
    best = [own.where(F.col("lang") == lang).orderBy(F.desc("rate"), "gram").limit(per_language).toPandas() for lang in languages]
    return build(pd.concat(best) if best else pd.DataFrame({"lang": [], "gram": [], "rate": []}), languages)


def identify(text: str, found: Filter) -> tuple[str, float]:
    """Language and score of one text: the share of its n-grams that the language explains beyond chance."""
    hits, total = np.zeros(len(found.languages)), 0
    letters = False
    for block in grams(text):
        letters = True
        mask = None
        for at in _positions(block, len(found.table)):
            mask = found.table[at] if mask is None else mask & found.table[at]
        hits += np.unpackbits(mask, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[: len(hits)]
        total += len(block)
    if not letters or not len(hits):
        return UNKNOWN, 0.0
    left = np.clip((hits / total - found.false_rate) / np.maximum(1 - found.false_rate, 1e-9), 0, 1)
    best = int(np.argmax(left))
    return found.languages[best], float(left[best] / left.sum()) if left.sum() else 1 / len(left)


def predict(docs: DataFrame, found: Filter) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row; ``und`` with score 0 for a null text or one without a letter.

    Of languages with equally many hits the first in alphabetical order is given; so it is, with an even score, for a
    text none of whose n-grams is known. Without any learnt language everything is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((found.languages, found.table, found.false_rate))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Filter(*shared.value)
        for frame in frames:
            rows = [identify(t, own) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
